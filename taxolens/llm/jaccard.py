"""Exact links between texts by the Jaccard similarity of their shingle sets.

Two sets with a similarity of SHARE (4/5) or more hold a common member among the
first s - ceil(4s/5) + 1 of each, in any order that is the same for all (prefix
filter).  The order here is rarest first: shingles that many texts of some chunk
hold come last, by their count; all others come first, by hash.  Prefixes are dealt by member, and
members that more than LARGE sets turn out to share, over all tasks, are moved back by that count and prefixes
taken anew, ORDERS times at most.  Counts only speed things up: links don't depend on them.

Texts that share a prefix member are candidates if sizes, its places in both orders (what comes before the first
shared member isn't shared) and bitmaps of parities (a lower bound of the symmetric difference) allow the overlap;
then both texts' sets are intersected.  Where more than `hot` texts share a member, pairs aren't formed at once:
in rounds, every text is compared with one other that it shares members with and isn't
joined to yet (the one that most of them offer), and members whose texts have all come together are closed.  That goes on
while it finds links (and ROUNDS times at most).  Afterwards pairs are formed of those
texts only that share an open member and aren't joined yet; so a large group of near
copies costs no square, and no link between groups is lost.

Sets hold 64-bit hashes; equal sets are one node, named by a 64-bit hash.  Of a node
one text stands for all.

Null, blank and empty texts have the empty set and are one node, so of them one row stays. Rows with a null id
stay and never stand for others. Ties go to the least id, then the least hash of the text; of rows equal in id and text one stays. Texts
are read whole, a long one alone in its piece. An empty table gives none; further columns of any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taxolens.llm import op6_simhash
from taxolens.llm.common import remove_path, spread_join, store, stored
from taxolens.llm.components import components
from taxolens.llm.textkit import text_chunks

#: Similarity from which texts link, as a fraction.
SHARE = 4, 5
#: Members that more texts than this share go through rounds of single comparisons first.
HOT, ROUNDS = 1, 2
#: Members that more sets than LARGE share go back in the order; prefixes are taken ORDERS times at most.
LARGE, ORDERS = 24, 3
#: Shingles of so many texts' sets are counted together; those in fewer than COMMON texts and a thousandth aren't frequent.
COUNTED, COMMON, MOST_FREQUENT = 1 << 18, 4, 200_000
#: Bytes of text that a worker takes at a time.
CHUNK = 1 << 18
#: Fewest classes of hashes whose parities are compared; a set of more members has as many, in powers of two.
LEAST_CLASSES = 512
#: Keys that are sent to all executors at once; more are joined.
BROADCAST_KEYS = 2_000_000


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(np.array(op6_simhash.shingle_hashes(text, size), np.uint64))


def set_key(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes())


def parities(members: np.ndarray) -> np.ndarray:
    """For each class of hashes, whether an odd number is in the set; as bytes."""
    classes = max(LEAST_CLASSES, 1 << max(len(members) - 1, 0).bit_length())
    odd = np.bincount((members & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8))


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Members at least that only one of two sets has, by their parities; the longer ones are folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefix(members: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The members that come first, rarest first, of which similar sets share at least one."""
    n = len(members)
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        rank = np.where(frequent[at] == members, counts[at], 0)
    return members[np.lexsort((members, rank))[: n - -(-SHARE[0] * n // SHARE[1]) + 1]] if n else members


def described(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, node, size, text_key, bits, token, n) of every row; token and n: frequent shingles, here and there.

    A task's last row holds nothing but such shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text"), CHUNK):
                raw, at = data.tobytes(), offsets.tolist()
                each = [np.array(op6_simhash.shingle_hashes(raw[a:b], shingle), np.uint64) for a, b in zip(at, at[1:], strict=False)]
                fp = op6_simhash.fingerprint_bits(np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))).view(np.int64)
                sets = [np.unique(x) for x in each]
                held += sets
                total += sum(len(x) for x in sets)
                token, n = [None] * len(sets), [None] * len(sets)
                if total >= COUNTED:
                    token[-1], n[-1] = often(held)
                    held, total = [], 0
                keys = np.array([set_key(x) for x in sets], np.uint64).view(np.int64)
                bits = pa.array([parities(x).tobytes() for x in sets], pa.binary())
                ids, text_key = (batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key"))
                columns = [ids, pa.array(fp), pa.array(keys), pa.array([len(x) for x in sets], pa.int32()), text_key, bits]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(token, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))], ["doc_id", "fp", "node", "size", "text_key", "bits", "token", "n"])
        if held:
            token, n = often(held)
            yield pa.RecordBatch.from_arrays([pa.array([None], kind) for kind in kinds[:-2]] + [pa.array([x], pa.list_(pa.int64())) for x in (token, n)], ["doc_id", "fp", "node", "size", "text_key", "bits", "token", "n"])

    def often(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        every, n = np.unique(np.concatenate(sets), return_counts=True)
        some = n >= max(COMMON, len(sets) // 1000)
        return every[some].view(np.int64).tolist(), n[some].tolist()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = [to_arrow_type(rows.schema["doc_id"].dataType), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), None, None]
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint, node bigint, size int, text_key bigint, bits binary, token array<bigint>, n array<bigint>")


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in order, and their counts."""
    each = rows.where("token IS NOT NULL").select(F.explode(F.arrays_zip("token", "n")).alias("x")).groupBy("x.token").agg(F.sum("x.n").alias("n"))
    top = each.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, shingle: int, often: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """(token, node, size, place): the prefix of every set in order, members that no other set shares left out; dealt once, by member."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text"), CHUNK):
                raw, at = data.tobytes(), offsets.tolist()
                firsts, nodes, sizes = [], [], []
                for a, b in zip(at, at[1:], strict=False):
                    members = shingle_set(raw[a:b], shingle)
                    key = set_key(members)
                    if key not in seen and len(members):
                        seen.add(key)
                        firsts.append(prefix(members, *shared.value))
                        nodes.append(key)
                        sizes.append(len(members))
                if nodes:
                    each = np.array([len(x) for x in firsts])
                    places = np.concatenate([np.arange(n, dtype=np.int32) for n in each])
                    columns = np.concatenate(firsts).view(np.int64), np.repeat(np.array(nodes, np.uint64).view(np.int64), each), np.repeat(np.array(sizes, np.int32), each), places
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "size", "place"])

    dealt = docs.select(F.col(text).alias("text")).mapInArrow(run, "token bigint, node bigint, size int, place int").repartition("token")
    many = dealt.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("token")
    return dealt.join(many.hint("shuffle_hash"), "token").dropDuplicates(["token", "node"])


def _sizes_fit(a: str, b: str) -> Column:
    return SHARE[1] * F.least(a, b) >= SHARE[0] * F.greatest(a, b)


def _places_fit() -> Column:
    """Whether two sets whose first shared member this is can overlap in 4/9 of both sizes together."""
    left = F.least(*[F.col(f"{s}_size") - F.col(f"{s}_place") for s in "ab"])
    return (SHARE[0] + SHARE[1]) * left >= SHARE[0] * (F.col("a_size") + F.col("b_size"))


def _ordered(docs: DataFrame, shingle: int, often: tuple[np.ndarray, np.ndarray], text: str) -> tuple[DataFrame, str]:
    """Prefixes, stored, in an order that has put the members that many sets share last; and their path."""
    spark = docs.sparkSession
    for turn in range(ORDERS):
        rows, at = store(prefixes(docs, shingle, often, text), "shared")
        if turn + 1 == ORDERS:
            break
        large = rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
        token, n = large["token"].to_numpy(np.int64).view(np.uint64), large["n"].to_numpy(np.int64)
        if np.isin(token, often[0]).all():
            break
        every = np.concatenate([often[0], token])
        most = np.concatenate([often[1], n])
        order = np.lexsort((-most, every))
        every, most = every[order], most[order]
        first = np.concatenate(([True], every[1:] != every[:-1]))
        often = every[first], most[first]
        remove_path(spark, at)
    return rows, at


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs whose sizes and parities allow similar sets, which overlap in 4/9 of both sizes together at least."""
    p, q = SHARE
    for batch in batches:
        kept = []
        for n, m, x, y in zip(batch.column("a_size").to_pylist(), batch.column("b_size").to_pylist(), batch.column("a_bits"), batch.column("b_bits"), strict=True):
            most = n + m - 2 * -(-p * (n + m) // (p + q))
            kept.append(q * min(n, m) >= p * max(n, m) and apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= most)
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def linked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are similar."""
    spark = docs.sparkSession
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("bits").alias(f"{s}_bits"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit("a_size", "b_size"))
    near, near_at = store(both.select("a", "b", "a_size", "b_size", "a_bits", "b_bits").mapInArrow(_possible, "a bigint, b bigint"), "near")
    asked = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked, asked_at = store(nodes.join(asked, "node").select("node", "text_key", F.col("least.doc_id").alias("at")), "asked")
    on = asked.hint("shuffle_hash") if asked.count() > BROADCAST_KEYS else F.broadcast(asked)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    texts = rows.join(on, (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("at"))).select("node", "text").dropDuplicates(["node"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def members(node: int, body: pa.Scalar) -> np.ndarray:
            if node not in held:
                if len(held) == 2:
                    held.pop(next(iter(held)))
                held[node] = shingle_set(body.as_buffer().to_pybytes(), shingle)
            return held[node]

        for batch in batches:
            kept = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                q, p = members(b, y), members(a, x)
                kept.append((SHARE[0] + SHARE[1]) * len(np.intersect1d(p, q, assume_unique=True)) >= SHARE[0] * (len(p) + len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    found = stored(both.select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint"), "similar")
    for at in (near_at, asked_at):
        remove_path(spark, at)
    return found


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, node, size, place, root) of members whose texts aren't all joined."""
    rows = rows.select("token", "node", "size", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    return rows.join(apart, "token").select("token", "node", "size", "place", "root")


def _singles(rows: DataFrame, turn: int, hot: int) -> DataFrame:
    """(a, b): for every node one other that shares a member with it and has another root.

    Each member offers two nodes, of the roots that most and fewest of its texts have. In the first turn it offers the text in which
    it comes first, as that one has the fewest members of its own, later any by a hash. A node takes what most of its members offer.
    """
    mixed = lambda c: F.xxhash64(c, F.lit(turn))
    own = F.struct(F.col("place") if turn == 0 else F.lit(0).alias("place"), mixed("node").alias("mixed"))
    each = rows.groupBy("token", "root").agg(F.min_by(F.struct("node", "root", "size"), own).alias("end"), F.min(own).alias("own"), F.count("*").alias("n"))
    most, fewest = F.struct("n", -F.col("own.place"), mixed("root")), F.struct("n", mixed("root"))
    ends = each.groupBy("token").agg(F.max_by("end", most).alias("hi"), F.min_by("end", fewest).alias("lo"), F.sum("n").alias("n")).where((F.col("n") > hot) & (F.col("hi.root") != F.col("lo.root")))
    offered = spread_join(rows, ends, ["token"]).withColumn("end", F.when(F.col("hi.root") != F.col("root"), F.col("hi")).otherwise(F.col("lo"))).where(_sizes_fit("size", "end.size"))
    votes = offered.groupBy("node", F.col("end.node").alias("other")).agg(F.count("*").alias("n"))
    chosen = votes.groupBy("node").agg(F.max_by("other", F.struct("n", mixed("other"))).alias("other"))
    return chosen.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, often: tuple[np.ndarray, np.ndarray], shingle: int, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(a, b): joins all nodes whose sets are similar, directly or through others that are."""
    spark = docs.sparkSession
    rows, at = _ordered(docs, shingle, often, text)
    rows = rows.withColumn("root", F.col("node"))
    found = None
    for turn in range(ROUNDS):
        one = linked(docs, _singles(rows, turn, hot), nodes, shingle, doc_id, text)
        found = one if found is None else found.union(one)
        if one.isEmpty():
            break
        before, (rows, at) = at, store(_open(rows, components(found).select("node", "root")), "open")
        remove_path(spark, before)
    one, two = (rows.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "place", "root")]) for s in "ab")
    fit = (F.col("a_node") > F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & _sizes_fit("a_size", "b_size") & _places_fit()
    pairs, pairs_at = store(one.join(two, "token").where(fit).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "pairs")
    found = found.union(linked(docs, pairs, nodes, shingle, doc_id, text))
    for path in (at, pairs_at):
        remove_path(spark, path)
    return found


def _named(docs: DataFrame, shingle: int, radius: int, doc_id: str, text: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, node); and (node, n, keep) with keep, the least (doc_id, text_key) of the node's component."""
    every = stored(described(docs, shingle, doc_id, text), "described")
    rows = every.where("node IS NOT NULL")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))
    nodes = stored(rows.groupBy("node").agg(least.alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "text_key", "bits")]).withColumn("text_key", F.coalesce("least.text_key", "text_key")), "nodes")
    pairs = stored(rows.select("fp", "node").distinct(), "pairs")
    prints = stored(pairs.groupBy("fp").agg(F.min("node").alias("at"), F.count("*").alias("n")), "prints")
    by_print = spread_join(pairs, prints, ["fp"]).select(F.col("node").alias("a"), F.col("at").alias("b")).where("a != b")
    near = op6_simhash.links(prints.select("fp"), radius)
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("at").alias("to_a")), "a").join(prints.select(F.col("fp").alias("b"), F.col("at").alias("to_b")), "b")
    joined = links(docs, nodes, frequent(every), shingle, doc_id, text, hot).union(by_print).union(near.select("to_a", "to_b"))
    placed = nodes.select("node", "n", "least").join(components(joined), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min("least").alias("keep"), F.count("*").alias("members"))
    return rows.select("doc_id", "text_key", "node"), spread_join(placed.select("root", "node", "n"), best, ["root"], "members").select("node", "n", "keep")


def group(docs: DataFrame, shingle: int, radius: int, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, component_id): texts whose sets are similar or whose fingerprints lie within radius, directly or through others."""
    rows, named = _named(docs, shingle, radius, doc_id, text, hot)
    return spread_join(rows.select("doc_id", "node"), named.select("node", "n", F.col("keep.doc_id").alias("component_id")), ["node"]).select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, shingle: int, radius: int, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row of each component, with its own columns: the least id, and for one id the least hash of the text.

    Of rows with equal id and text one stays; rows with a null id stay as they are. Texts are shuffled
    once, by id and hash of the text.
    """
    _, named = _named(docs, shingle, radius, doc_id, text, hot)
    keep = named.where("keep IS NOT NULL").select("keep.*").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("key"))
    kept = rows.join(keep, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_semi").dropDuplicates(["id", "key"])
    return kept.select("row.*").union(rows.where("id IS NULL").select("row.*"))
