"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has bit k set if more than half of its shingles' 64-bit
hashes have it set.  Two fingerprints link at `radius` or fewer differing bits.

Candidates come from covering tables (Pagh, "Locality-sensitive hashing without
false negatives", SODA 2016): each of the 64 bits gets a vector m(k) of
radius + 1 bits, and for each vector v but zero there is a table whose mask holds
the bits k with <m(k), v> odd.  For any `radius` differing bits some v is
orthogonal to all their vectors, so the two fingerprints agree under that mask:
every linked pair meets in some table.  A fingerprint that is alone in its bucket
of every table has no link.

Others are verified without forming pairs: two fingerprints lie within 2t bits if
and only if they share a point within t bits of both, so each candidate states
the points within radius / 2 of it, and whoever shares a point is linked to the
least of those who do (for an odd radius one side goes one bit further).  A point
has a bounded number of neighbours, so no group grows with the data.  Links then
go through distributed components.

Null and empty texts have no words and fingerprint zero, which links like any
other.  Equal texts share one fingerprint, which is handled once.  A null id is
kept in the result and never names a component unless all members are null.
Only ids and texts are read, so further columns of any name do no harm; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import bound_batches, spread_join, stored
from taxolens.llm.components import components
from taxolens.llm.textkit import text_chunks

SEED = 42
SHINGLE = 3
RADIUS = 2


def fingerprint_bits(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its shingles' hashes, as unsigned 64-bit numbers."""
    out = np.zeros(len(ptr) - 1, np.uint64)
    sizes = np.diff(ptr)
    full = np.flatnonzero(sizes)
    step = 1 << 13  # hashes unpacked at a time
    sums = np.zeros((len(ptr) - 1, 64), np.int64)
    for lo in range(0, len(hashes), step):
        part = hashes[lo : lo + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = int(np.searchsorted(ptr, lo, side="right")) - 1
        begins = np.unique(np.clip(ptr[first:], lo, lo + len(part)) - lo)
        begins = begins[begins < len(part)]
        rows = np.searchsorted(ptr, begins + lo, side="right") - 1
        sums[rows] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    set_ = (2 * sums[full] > sizes[full, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of `size` words; of all words if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=False)]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp: the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text"), 1 << 18):
                raw = data.tobytes()
                at = offsets.tolist()
                each = [shingle_hashes(raw[a:b], shingle) for a, b in zip(at, at[1:], strict=False)]
                ptr = np.concatenate(([0], np.cumsum([len(x) for x in each])))
                hashes = np.fromiter((h for x in each for h in x), np.uint64, int(ptr[-1]))
                fp = fingerprint_bits(hashes, ptr).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(fp)], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius + 1) - 1 masks; any `radius` bits are all outside at least one of them.

    The vectors of the bits go round through all but zero, so that masks are nearly even in size.
    """
    size = (1 << (radius + 1)) - 1
    vector = [1 + k % size for k in range(bits)]
    return [sum(1 << k for k in range(bits) if (vector[k] & v).bit_count() % 2) for v in range(1, size + 1)]


def flips(within: int) -> list[int]:
    """All 64-bit numbers with at most so many bits set."""
    return [sum(1 << k for k in x) for n in range(within + 1) for x in combinations(range(64), n)]


def _points(fp: str, within: int) -> Column:
    return F.transform(F.array(*[F.lit(_signed(x)) for x in flips(within)]), lambda x: F.col(fp).bitwiseXOR(x))


def candidates(fps: DataFrame, radius: int) -> DataFrame:
    """Those of the distinct fingerprints fp that share a bucket of some covering table with another."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(covering_masks(radius))])
    keyed = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    return keyed.join(shared, ["t", "key"]).select("fp").distinct()


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): joins all distinct fingerprints within `radius`, directly or through others within it.

    For an even radius; odd ones state both sides of each point.
    """
    near, far = radius // 2, radius - radius // 2
    some = candidates(fps, radius)
    points = some.select("fp", F.explode(_points("fp", near)).alias("at"))
    if near == far:
        met = points.groupBy("at").agg(F.collect_set("fp").alias("who")).where("size(who) > 1")
        return met.select(F.explode("who").alias("a"), F.array_min("who").alias("b")).where("a != b").distinct()
    reach = some.select(F.col("fp").alias("other"), F.explode(_points("fp", far)).alias("at"))
    return points.join(reach, "at").where("fp < other").select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def group(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp)."""
    fps = stored(fps, "fingerprints")
    kinds = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "kinds")
    roots = components(links(kinds.select("fp"), radius))
    placed = kinds.join(roots, kinds.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = spread_join(placed, first, ["root"], "size").select("fp", "n", "component_id")
    return spread_join(fps, named, ["fp"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    got = group(fingerprints(docs, doc_id, text, shingle), radius)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
