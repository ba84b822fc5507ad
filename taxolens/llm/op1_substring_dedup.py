"""Substring dedup by content-defined chunking.

A gear rolling hash runs over a text's bytes: each byte shifts the hash left and
adds a keyed random number, so its low 16 bits depend on the last 16 bytes alone.
Chunks may end where a word begins (in runs of over LONG_RUN bytes without white
space: at any character).  They end where the hash is lower than at the REACH
words before and not higher than at the REACH words after, and at MAX_CHUNK bytes
at the latest.  So boundaries follow the content: they are REACH + 1 words apart
or more, 2 REACH + 1 on average, whatever the length of the words, and an insertion
moves those within REACH words of it.  Chunks are compared by a 128-bit digest of
their bytes.

A chunk is a repeat if it lies in two places: in documents with different ids, in two
texts of one id, or twice in one text.  Its first place is in the document with the
least id, there where the text first has it.  (Several texts of one id: if no other id
holds the chunk, the first is the text with the least hash; else each of the least id's
texts has a first place.)  Neighbouring repeats form a run; runs of MIN_SPAN_WORDS words
or more are reported, with the id of the first document that holds them.  A passage of over 50 words loses about REACH words
and 16 bytes at either end and the chunks that its ends cut, which leaves more than
MIN_SPAN_WORDS (over 0.99 of such passages for words of any length; tests measure
it).  Spans are whole chunks: a little less than the passage, never more.  Parts of
a run that have an earlier place are reported apart from those that are first here.  A passage that is itself periodic for over MAX_CHUNK bytes lines up only if
its beginning is shared too.

Every text is chunked once; digests and places are stored.  Shuffles carry these, never
texts; what tells a digest's places apart is combined on the map side, and digests that
very many chunks share are joined by broadcast.

Null and empty texts have no chunk.  Rows with a null id can't be named and are
left out; rows with one id and one text count once, and never repeat each other.
Equal documents are reported as spans over their whole text if that has
MIN_SPAN_WORDS words.  A text is never split over workers: one takes some 30 times
the bytes of its longest text, or of a chunk of 1 MiB.  Only ids and texts are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from taxolens.llm.common import bound_batches, spread_join, stored
from taxolens.llm.textkit import NOT_SPACE, mix, text_chunks

#: Words on either side that a boundary is compared with.
REACH = 3
#: Bytes; below 1024.
MAX_CHUNK = 256
LONG_RUN = 32
MIN_SPAN_WORDS = 20
GEAR_SEED = 2026

#: The gear: a keyed random number for each byte.
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(GEAR_SEED << 20)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, begun anew for each text.

    The hash is the sum of the last 32 gears, each shifted by its distance; sums over 2, 4, ... 32
    bytes are built from those over half as many.
    """
    h = GEAR[data]
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    reach = 1
    while reach < 32:
        before = np.zeros_like(h)
        before[reach:] = h[:-reach] << np.uint32(reach)
        before[since < reach] = 0
        h = h + before
        reach *= 2
    return h


def places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin; in runs of over LONG_RUN bytes without white space, further characters too."""
    member = NOT_SPACE[data]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = member[first]
    at = np.arange(len(data))
    since = at - np.maximum.accumulate(np.where(begins, at, 0))
    return np.flatnonzero(begins | (member & (since > LONG_RUN) & ((data & 0xC0) != 0x80)))


def cuts(data: np.ndarray, offsets: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of all texts, and where each text's begin."""
    words = places(data, offsets) if words is None else words
    text = np.searchsorted(offsets, words, side="right")
    inner = words > offsets[text - 1]
    p, text = words[inner], text[inner]
    v = (mix((rolling(data, offsets)[p - 1] & np.uint32(0xFFFF)).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    low = np.ones(len(p), bool)
    for i in range(1, REACH + 1):
        other = text[i:] != text[:-i]
        low[i:] &= other | (v[i:] < v[:-i])
        low[:-i] &= other | (v[:-i] <= v[i:])
    bounds = np.unique(np.concatenate([offsets, p[low]]))
    sizes = np.diff(bounds)
    pieces = -(-sizes // MAX_CHUNK)
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    ends = np.minimum(np.repeat(bounds[:-1], pieces) + (number + 1) * MAX_CHUNK, np.repeat(bounds[1:], pieces))
    return ends, np.searchsorted(ends, offsets, side="right")


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, place, d1, d2): the chunks of every text with their digests; place: see `_start` and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                words = places(data, offsets)
                ends, ptr = cuts(data, offsets, words)
                starts = np.concatenate((offsets[:1], ends[:-1])) if len(ends) else ends
                raw = memoryview(data.tobytes())
                digest = xxhash.xxh3_128_digest
                keys = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                pair = np.frombuffer(keys, "<i8").reshape(-1, 2)
                row = np.repeat(np.arange(hi - lo), np.diff(ptr))
                n_words = np.searchsorted(words, ends) - np.searchsorted(words, starts)
                order = np.lexsort((pair[:, 1], pair[:, 0], row))
                again = np.zeros(len(row), np.int64)
                again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (pair[order[1:]] == pair[order[:-1]]).all(1)
                place = (starts - offsets[:-1][row]) << 21 | again << 20 | (ends - starts) << 10 | n_words
                of = pa.array(row)
                ids, whole = (batch.column(c).slice(lo, hi - lo).take(of) for c in ("doc_id", "text_key"))
                yield pa.RecordBatch.from_arrays([ids, whole, pa.array(place), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["doc_id", "text_key", "place", "d1", "d2"])

    bound_batches(docs.sparkSession)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key bigint, place bigint, d1 bigint, d2 bigint")


def _start() -> Column:
    return F.shiftright("place", 21)


def _again() -> Column:
    """Whether the chunk has an earlier place in the same text."""
    return F.shiftright("place", 20).bitwiseAND(1) == 1


def _stop() -> Column:
    return _start() + F.shiftright("place", 10).bitwiseAND(1023)


def _words() -> Column:
    return F.col("place").bitwiseAND(1023)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_span_words: int = MIN_SPAN_WORDS) -> DataFrame:
    """doc_id, text_key, start, stop (bytes), n_chunks, n_words, first_doc_id, first_here of every repeated span.

    A run of repeats of min_span_words or more is reported in parts: those whose chunks have an earlier place,
    and those that are first here.  first_doc_id: the first document with the part's most particular
    chunk, which is the largest of its chunks' least ids; it equals doc_id in the parts that are first here, and in
    those whose earlier place is in the same text or id.
    """
    every = stored(chunks(docs, doc_id, text), "chunks")
    held = every.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("text_key").alias("key"), F.max("text_key").alias("last_key"), F.max(_again()).alias("again"), F.count("*").alias("n")
    )
    one_id = F.col("least") == F.col("most")
    held = held.where(~one_id | (F.col("key") != F.col("last_key")) | F.col("again"))
    held = stored(held.select("d1", "d2", "least", F.when(one_id, F.col("key")).alias("key"), "n"), "held")
    found = spread_join(every, held, ["d1", "d2"], hint="shuffle_hash").select("doc_id", "text_key", "place", "least", "key")
    found = found.repartition("doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "place"])
    first = (F.col("least") == F.col("doc_id")) & ~_again() & (F.col("key").isNull() | (F.col("key") == F.col("text_key")))
    found = found.select("doc_id", "text_key", _start().alias("start"), _stop().alias("stop"), _words().alias("words"), first.alias("first_here"), "least")
    own = Window.partitionBy("doc_id", "text_key").orderBy("start")
    fresh = lambda c: F.coalesce(c, F.lit(True)).cast("int")
    marked = found.withColumn("apart", fresh(F.lag("stop").over(own) != F.col("start"))).withColumn("part", F.greatest("apart", fresh(F.lag("first_here").over(own) != F.col("first_here"))))
    numbered = marked.withColumns({"run": F.sum("apart").over(own), "part": F.sum("part").over(own)})
    parts = numbered.groupBy("doc_id", "text_key", "run", "part").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_chunks"), F.sum("words").alias("n_words"), F.max("least").alias("first_doc_id"), F.first("first_here").alias("first_here")
    )
    whole = F.sum("n_words").over(Window.partitionBy("doc_id", "text_key", "run"))
    return parts.withColumn("_run_words", whole).where(F.col("_run_words") >= min_span_words).select("doc_id", "text_key", "start", "stop", "n_chunks", "n_words", "first_doc_id", "first_here")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_span_words: int = MIN_SPAN_WORDS) -> DataFrame:
    """The rows with their own columns, every chunk of a repeated span left only in its first place.

    Rows with a null id are kept as they are.  A text that a cut would leave with broken UTF-8 at an
    end loses the broken bytes.  Texts are shuffled once, by id and text, to meet their spans.
    """
    drop = repeats(docs, doc_id, text, min_span_words).where("not first_here")
    drop = drop.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cut"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("body"), F.xxhash64(F.col(f"`{text}`")).alias("key"))
    joined = rows.join(drop, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left").select("row", "body", "cut")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, holes in zip(batch.column("body").to_pylist(), batch.column("cut").to_pylist(), strict=True):
                if holes:
                    raw, last, kept = body.encode(), 0, []
                    for h in holes:
                        kept.append(raw[last : h["start"]].decode(errors="ignore"))
                        last = h["stop"]
                    body = "".join([*kept, raw[last:].decode(errors="ignore")])
                texts.append(body)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "body"])

    got = joined.mapInArrow(cut, StructType([joined.schema["row"], StructField("body", StringType())]))
    return got.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
