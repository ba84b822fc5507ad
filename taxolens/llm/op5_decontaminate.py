"""Benchmark decontamination by a prefix-filtered join of shingles.

Words are runs of a-z (A-Z lower-cased), digits and everything beyond ASCII.  An
item's windows are its runs of WINDOW words; an item of fewer words, but not none,
is one window.  A document word within any occurrence of any window is hit.

A window is a set of shingles (runs of SHINGLE words) with places.  As a document
has to hold all of them, the prefix that has to be looked for is one shingle: the
rarest, by counts over all documents.  Document shingles are joined to these
prefixes; the place of the shingle in the window bounds where the window begins,
the lengths of window and document cut what would not fit, the whole window's hash
drops nearly all others, and the window's bytes are compared for the rest.

Executors cut the items into distinct windows, a stored table with the items of each.
It is worked through in blocks of BLOCK_BYTES of item text, chosen by hash: a block's
windows come to the driver as arrays (some 25 times the items' text), get their
prefixes by the counts, and go to the executors (some 15 times), for one pass over the
documents; then the next follows.  Hits of several blocks are merged by document.  One
block (the usual case) needs no shuffle of documents at all.

Null and empty texts have no words: zero counts, the hash of the empty list, not
contaminated.  Items with equal texts are all counted; repeated documents are
judged alike; null item ids are left out of lists but their windows still hit.
With no items nothing is hit.  A text is never split over workers: one takes some 60
times the bytes of its longest text, or of a chunk of 1 MiB.  Only ids and texts are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import bound_batches, remove_path, store, stored
from taxolens.llm.textkit import ALNUM, LOWER, ngrams, row_of, row_sums, runs, span_hashes, text_chunks

WINDOW = 10
SHINGLE = 3
#: Bytes of item text that one block of the index is made of.
BLOCK_BYTES = 2 << 20

RESULT = "n_words bigint, n_hit bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def _words(texts: pa.Array, limit: int | None = None) -> Iterator[tuple]:
    """(first row, end row, bytes, starts, ends, where each text's words begin, hashes) by chunk."""
    for lo, hi, data, offsets in text_chunks(texts) if limit is None else text_chunks(texts, limit):
        data = LOWER[data]
        starts, ends, ptr = runs(ALNUM[data], offsets)
        yield lo, hi, data, starts, ends, ptr, span_hashes(data, starts, ends)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(w1, w2, size, k, body, shingles, items): each distinct window by a 128-bit hash; words, shingle size, bytes, shingles in order, ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, starts, ends, ptr, words in _words(batch.column("text")):
                again = span_hashes(data, starts, ends, 1)
                length = ends - starts
                joined_at = np.concatenate(([0], np.cumsum(length + 1)))  # where each word begins with one space between
                joined = np.full(int(joined_at[-1]), 0x20, np.uint8)
                before, each_byte = np.cumsum(length) - length, np.arange(int(length.sum()))
                joined[np.repeat(joined_at[:-1] - before, length) + each_byte] = data[np.repeat(starts - before, length) + each_byte]
                many = np.diff(ptr)
                for size in np.unique(np.minimum(many[many > 0], window)).tolist():
                    own = (many >= window) if size == window else (many == size)
                    begins = np.where(own, np.maximum(many - size + 1, 0), 0)
                    item = np.repeat(np.arange(hi - lo), begins)
                    at = ptr[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(begins) - begins, begins)
                    k = min(shingle, size)
                    each = _placed(words, ptr, k)[at[:, None] + np.arange(size - k + 1)]
                    stop = joined_at[at + size] - 1
                    wide = stop - joined_at[at]
                    ends_ = np.concatenate(([0], np.cumsum(wide)))
                    body = joined[np.repeat(joined_at[at] - ends_[:-1], wide) + np.arange(int(ends_[-1]))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(_placed(words, ptr, size)[at].view(np.int64)),
                            pa.array(_placed(again, ptr, size)[at].view(np.int64)),
                            pa.array(np.full(len(at), size, np.int32)),
                            pa.array(np.full(len(at), k, np.int32)),
                            pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends_.astype(np.int32)), pa.py_buffer(body)]),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (size - k + 1), pa.int32()), pa.array(each.ravel().view(np.int64))),
                            batch.column("item").slice(lo, hi - lo).take(pa.array(item)),
                        ],
                        ["w1", "w2", "size", "k", "body", "shingles", "item"],
                    )

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    cuts = rows.mapInArrow(cut, "w1 bigint, w2 bigint, size int, k int, body binary, shingles array<bigint>, item string")
    return cuts.groupBy("w1", "w2").agg(*[F.first(c).alias(c) for c in ("size", "k", "body", "shingles")], F.collect_set("item").alias("items"))


def _placed(words: np.ndarray, ptr: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; 0 where the text has fewer."""
    h, at = ngrams(words, ptr, n)
    out = np.zeros(len(words), np.uint64)
    many = np.diff(at)
    out[np.arange(len(h)) + np.repeat(ptr[:-1] - at[:-1], many)] = h
    return out


@dataclass
class Windows:
    """The windows of a block as arrays."""

    body: np.ndarray
    at: np.ndarray  # where each window's bytes begin
    sizes: np.ndarray
    hashes: np.ndarray  # of the whole window
    item: np.ndarray  # places in names, one window after another
    item_at: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: pa.Table) -> Windows:
        body = pa.concat_arrays(rows["body"].chunks) if len(rows) else pa.array([], pa.binary())
        items = pa.concat_arrays(rows["items"].chunks) if len(rows) else pa.array([], pa.list_(pa.string()))
        named = items.flatten().dictionary_encode()
        at = np.concatenate(([0], np.cumsum(pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64))))
        return cls(
            np.frombuffer(b"".join(body.to_pylist()), np.uint8), at, rows["size"].to_numpy().astype(np.int64), rows["w1"].to_numpy().view(np.uint64),
            named.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate(([0], np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)))), named.dictionary.to_pylist(),
        )


def _shingles(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, its size, its window and its place there, one window after another."""
    each = pa.concat_arrays(rows["shingles"].chunks) if len(rows) else pa.array([], pa.list_(pa.int64()))
    many = pc.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
    window = np.repeat(np.arange(len(rows)), many)
    return each.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), rows["k"].to_numpy().astype(np.int64)[window], window, np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)


class _Lookup:
    """Finds the places of sorted keys; a table of low bits drops nearly all that aren't there."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = np.uint64(min(22, max(10, int(len(keys)).bit_length() + 4)))
        self.there = np.zeros(1 << int(self.bits), bool)
        self.there[(keys & np.uint64((1 << int(self.bits)) - 1)).astype(np.int64)] = True

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in probes, first place in keys) of those that are keys."""
        at = np.flatnonzero(self.there[(probes & np.uint64(len(self.there) - 1)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.searchsorted(self.keys, probes[at])
        place[place == len(self.keys)] = 0
        same = self.keys[place] == probes[at]
        return at[same], place[same]


def shingle_counts(docs: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of the sorted shingles of each size occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {k: _Lookup(v) for k, v in shared.value.items()}
        totals = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            for *_, ptr, words in _words(batch.column("text")):
                for k, lookup in lookups.items():
                    _, place = lookup.find(ngrams(words, ptr, k)[0])
                    totals[k] += np.bincount(place, minlength=len(totals[k]))
        for k, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], ["k", "at", "n"])

    got = docs.select(F.col(text).alias("text")).mapInArrow(count, "k int, at bigint, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    sizes, at, n = (got[c].to_numpy() for c in ("k", "at", "n"))
    out = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
    for k, counts in out.items():
        counts[at[sizes == k]] = n[sizes == k]
    return out


@dataclass
class Prefixes:
    """The rarest shingle of each window, sorted, with the window's number and the shingle's place in it."""

    keys: dict[int, np.ndarray]
    window: dict[int, np.ndarray]
    place: dict[int, np.ndarray]

    @classmethod
    def choose(cls, rows: pa.Table, docs: DataFrame, text: str) -> Prefixes:
        shingle, size, window, place = _shingles(rows)
        wanted = {int(k): np.unique(shingle[size == k]) for k in np.unique(size)}
        out = cls({}, {}, {})
        for k, counts in (shingle_counts(docs, text, wanted) if wanted else {}).items():
            own = size == k
            s, w, p = shingle[own], window[own], place[own]
            order = np.lexsort((p, s, counts[np.searchsorted(wanted[k], s)], w))
            s, w, p = s[order], w[order], p[order]
            rarest = np.concatenate(([True], w[1:] != w[:-1]))
            s, w, p = s[rarest], w[rarest], p[rarest]
            order = np.argsort(s, kind="stable")
            out.keys[k], out.window[k], out.place[k] = s[order], w[order], p[order]
        return out


def occurrences(data, starts, ends, ptr, words, windows: Windows, prefixes: Prefixes, lookups: dict[int, _Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in a chunk of texts."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    whole: dict[int, np.ndarray] = {}
    for k, lookup in lookups.items():
        grams, at = ngrams(words, ptr, k)
        pos, first = lookup.find(grams)
        if not len(pos):
            continue
        # a gram's own first word, from its number among the chunk's grams
        row = np.searchsorted(at, pos, side="right") - 1
        pos = pos - at[row] + ptr[row]
        keys, window, place = prefixes.keys[k], prefixes.window[k], prefixes.place[k]
        many = np.searchsorted(keys, keys[first], side="right") - first
        rep = np.repeat(np.arange(len(pos)), many)
        each = np.repeat(first, many) + (np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many))
        begin, who = pos[rep] - place[each], window[each]
        fits = (begin >= ptr[row[rep]]) & (begin + windows.sizes[who] <= ptr[row[rep] + 1])
        begin, who = begin[fits], who[fits]
        for size in np.unique(windows.sizes[who]).tolist():
            if size not in whole:
                whole[size] = _placed(words, ptr, size)
            here = np.flatnonzero(windows.sizes[who] == size)
            here = here[whole[size][begin[here]] == windows.hashes[who[here]]]
            exact = [i for i in here.tolist() if _joined(data, starts[begin[i] : begin[i] + size], ends[begin[i] : begin[i] + size]) == windows.body[windows.at[who[i]] : windows.at[who[i] + 1]].tobytes()]
            found.append((begin[exact], who[exact]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _scan(rows: DataFrame, shared) -> DataFrame:
    """rows (with a column _body) with the result columns of one block, (Windows, Prefixes) as sent, in place of _body."""
    carry = [f for f in rows.schema.fields if f.name != "_body"]
    names = [f.name for f in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = shared.value
        lookups = {k: _Lookup(v) for k, v in prefixes.keys.items()}
        for batch in batches:
            for lo, hi, data, starts, ends, ptr, words in _words(batch.column("_body")):
                begin, who = occurrences(data, starts, ends, ptr, words, windows, prefixes, lookups)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + windows.sizes[who], -1)
                hit = np.cumsum(step[:-1]) > 0
                s, e, at = runs(hit, ptr)
                s, e = s - np.repeat(ptr[:-1], np.diff(at)), e - np.repeat(ptr[:-1], np.diff(at))
                spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["start", "stop"]))
                held: list[set] = [set() for _ in range(hi - lo)]
                n = max(len(windows.sizes), 1)
                pairs = np.unique((np.searchsorted(ptr, begin, side="right") - 1) * n + who)
                for row, w in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
                    held[row].update([windows.names[i] for i in windows.item[windows.item_at[w] : windows.item_at[w + 1]].tolist()])
                own = [batch.column(c).slice(lo, hi - lo) for c in names]
                counts = [pa.array(np.diff(ptr)), pa.array(row_sums(hit.astype(np.int64), ptr))]
                yield pa.RecordBatch.from_arrays([*own, *counts, spans, pa.array([sorted(x) for x in held], pa.list_(pa.string()))], [*names, "n_words", "n_hit", "spans", "items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carry)
    return rows.mapInArrow(run, f"{fields}{', ' if fields else ''}{RESULT}")


def hits(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (a struct of carry), n_words, n_hit, spans (of hit words, from 0, end exclusive) and items of every document.

    With more than one block, rows of equal (carry, text) are merged by a hash of their text and
    counted, then given back as many times. The first block states all documents, the others only those
    that it hits; each block's rows are stored, and its windows leave the executors before the next come.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).alias("_body"))
    cut, at = store(item_windows(benchmark, item_id, item_text, window, shingle), "windows")
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def block(i: int) -> tuple[Windows, Prefixes]:
        held = cut.where(F.pmod("w1", F.lit(blocks)) == i).toArrow()
        return Windows.of(held), Prefixes.choose(held, docs, text)

    if blocks == 1:
        index = block(0)
        remove_path(docs.sparkSession, at)
        return _scan(rows, docs.sparkSession.sparkContext.broadcast(index))
    keyed = rows.select("row", F.sha2(F.coalesce("_body", F.lit("")), 256).alias("_key"), F.lit(0).alias("_block"), "_body")
    every = None
    for i in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block(i))
        one = _scan(keyed.withColumn("_block", F.lit(i)), shared)
        one = stored(one.where("_block = 0 OR n_hit > 0"), "hits")
        shared.destroy()
        every = one if every is None else every.unionByName(one)
    remove_path(docs.sparkSession, at)
    merged = every.groupBy("row", "_key").agg(
        F.sum(F.when(F.col("_block") == 0, 1).otherwise(0)).alias("_times"),
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("stop"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("done"))

    def join_spans(s, x):
        apart = x["start"] > s["stop"]
        closed = F.when(apart & (s["stop"] >= 0), F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))).otherwise(s["done"])
        return F.struct(F.when(apart, x["start"]).otherwise(s["start"]).alias("start"), F.greatest(s["stop"], x["stop"]).alias("stop"), closed.alias("done"))

    flat = F.aggregate(F.array_sort("spans"), zero, join_spans, lambda s: F.when(s["stop"] >= 0, F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))).otherwise(s["done"]))
    merged = merged.withColumn("spans", flat).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"]))
    return merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("row", "n_words", "n_hit", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = hits(docs, benchmark, (doc_id,), text, item_id, item_text, **kw)
    return found.select(
        F.col("row")[doc_id].alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no window of the benchmark, with their own columns."""
    return hits(docs, benchmark, tuple(docs.columns), text, item_id, item_text).where("n_hit = 0").select("row.*")


#: What items_sha256 is for a document without items.
NO_ITEMS_SHA256 = hashlib.sha256(b"").hexdigest()


def oracle_sql() -> str:
    """The query's result as DuckDB SQL over documents and benchmark."""
    lower = lambda c: f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: rf"regexp_extract_all({lower(c)}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT g.r, g.i, g.n, win.item FROM g JOIN win ON win.n = g.n AND win.g = g.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
