"""Ranked lexical search over all documents, an impact at a time.

Terms are runs of ASCII letters and digits and everything beyond ASCII, A-Z lower-cased.  A posting's
impact is (10^9 tf) div (1000 tf + 20 m), m following the document's length; a term's weight follows
from how many documents hold it; a document's score is the sum of weight times impact over the
item's terms.

One pass over the texts writes an index of the items' terms: per document its length, terms and
counts.  Sizes, lengths and document frequencies are aggregates of it.  A second pass reads the index
in blocks of documents (an Arrow batch, bounded in bytes).  In a block each term's postings lie
grouped by exact impact, highest first.  For an item the groups of its terms are added to accumulators
in descending order of weight times impact; what is left of each term bounds what any document can
still gain.  The walk stops only when at most `top` documents can still reach the scores that `top`
others have for certain, those of the task's earlier blocks included; then the scores of the documents left are
completed from their own terms.  Otherwise it goes to the end.  Each block gives up to `top`
documents an item, and two windows (by item and part, then by item) keep the best of all.

Items are taken in blocks of ITEMS items and ITEM_BYTES of text, so what is broadcast (the terms of a
block) is bounded; usually all items are one block.  Every term found by its 64-bit hash is
confirmed by its bytes.

A document that is null, empty or without terms isn't counted and never found.  An item that is null, empty or without terms
has no rows.  Each row of either table is a document or an item of its own: repeated rows of documents take
ranks of their own, repeated items repeat their rows.  Equal scores rank by ascending id, null ids last.
Empty tables give no rows; other columns of any name are left out.  Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from taxolens.llm.common import bound_batches, stored
from taxolens.llm.textkit import ALNUM, LOWER, row_of, runs, span_hashes, text_chunks

#: Documents returned for each item.
TOP = 50
#: Items, and bytes of their texts, that are searched at once.
ITEMS, ITEM_BYTES = 10_000, 32 << 20
#: Postings added before the first test whether the walk may stop; the next tests follow at twice as many each.
FIRST_STEP = 2_048
#: Parts in which each item's rows are ranked before they meet.
PARTS = 64


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first and last + 1, lower-cased bytes, where terms begin and end, where each text's terms begin."""
    for lo, hi, data, offsets in text_chunks(column):
        low = LOWER[data]
        yield lo, hi, low, *runs(ALNUM[low], offsets)


@dataclass(frozen=True)
class Vocabulary:
    """Distinct terms in the order of their hashes: their bytes, one after another, and where each begins."""

    hashes: np.ndarray
    data: np.ndarray
    at: np.ndarray
    repeats: int

    @staticmethod
    def of(terms: set[bytes]) -> Vocabulary:
        every = sorted(terms)
        at = np.concatenate(([0], np.cumsum([len(t) for t in every], dtype=np.int64)))
        hashes = span_hashes(np.frombuffer(b"".join(every), np.uint8), at[:-1], at[1:])
        order = np.argsort(hashes, kind="stable")
        every, hashes = [every[i] for i in order], hashes[order]
        at = np.concatenate(([0], np.cumsum([len(t) for t in every], dtype=np.int64)))
        return Vocabulary(hashes, np.frombuffer(b"".join(every), np.uint8), at, int(np.unique(hashes, return_counts=True)[1].max(initial=0)))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term at each span, -1 if it is none."""
        found = np.full(len(starts), -1, np.int64)
        if not len(self.hashes):
            return found
        h = span_hashes(data, starts, ends)
        place = np.searchsorted(self.hashes, h)
        for back in range(self.repeats):  # terms of equal hash lie side by side
            at = np.minimum(place + back, len(self.hashes) - 1)
            sizes = self.at[at + 1] - self.at[at]
            maybe = np.flatnonzero((self.hashes[at] == h) & (sizes == ends - starts) & (found < 0))
            own, first, size = starts[maybe], self.at[at[maybe]], sizes[maybe]
            same = np.ones(len(maybe), bool)
            for i in range(int(size.max(initial=0))):
                left = np.flatnonzero(same & (size > i))
                if not len(left):
                    break
                same[left] = data[own[left] + i] == self.data[first[left] + i]
            found[maybe[same]] = at[maybe[same]]
        return found


def _index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (of the vocabulary) of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        many = max(1, len(known.hashes))
        for batch in batches:
            for lo, hi, data, starts, ends, ptr in _terms(batch.column("text")):
                term = known.find(data, starts, ends)
                keys, tfs = np.unique(row_of(ptr)[term >= 0] * many + term[term >= 0], return_counts=True)
                at = np.searchsorted(keys // many, np.arange(hi - lo + 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v in (keys % many, tfs)]
                n = pa.array(np.diff(ptr), pa.int64())
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), n, *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pc.greater(n, 0))

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, terms array<int>, tfs array<int>")


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with n terms: 100 - 50 + (50 n N) div L."""
    every, place = np.unique(n, return_inverse=True)
    return np.array([50 + 50 * int(x) * n_docs // total for x in every], np.int64)[place]


class Block:
    """Postings of some documents, by term and then by exact impact, highest first."""

    def __init__(self, n: np.ndarray, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray, ids: pa.Array, n_terms: int, n_docs: int, total: int) -> None:
        self.size, self.at, self.terms = len(n), at, terms
        m = np.repeat(lengths(n, n_docs, total), np.diff(at))
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 20 * m)
        order = np.lexsort((-self.impacts, terms))
        term, impact = terms[order], self.impacts[order]
        self.docs = row_of(at)[order]
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (term[1:] != term[:-1]) | (impact[1:] != impact[:-1]))))
        self.group_impact, self.group_term = impact[begin], term[begin]
        self.group_at = np.append(begin, len(order))
        self.term_at = np.searchsorted(self.group_term, np.arange(n_terms + 1))
        self.id_rank = np.empty(self.size, np.int64)
        self.id_rank[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(self.size)

    def search(self, terms: np.ndarray, weights: np.ndarray, sure: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best `top`, at most that many, best first, and their scores.

        weights: by term, 0 for those that aren't the item's; sure: scores that earlier blocks hold.
        """
        firsts, lasts = self.term_at[terms], self.term_at[terms + 1]
        here = lasts > firsts
        firsts, lasts = firsts[here], lasts[here]
        if not len(firsts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = lasts - firsts
        group = np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        gain = weights[self.group_term[group]] * self.group_impact[group]
        order = np.argsort(-gain, kind="stable")
        group, gain, own = group[order], gain[order], np.repeat(np.arange(len(firsts)), counts)[order]
        sizes = self.group_at[group + 1] - self.group_at[group]
        reach = np.cumsum(sizes)
        next_gain = np.append(weights[self.group_term] * self.group_impact, 0)
        score = np.zeros(self.size, np.int64)
        seen = np.zeros(len(firsts), np.int64)
        done, step = 0, FIRST_STEP
        while True:
            until = min(len(group), int(np.searchsorted(reach, step, side="right")) + 1)
            some = sizes[done:until]
            at = np.repeat(self.group_at[group[done:until]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            np.add.at(score, self.docs[at], np.repeat(gain[done:until], some))
            seen += np.bincount(own[done:until], minlength=len(firsts))
            done, step = until, 2 * step
            rest = int(np.where(seen < counts, next_gain[np.minimum(firsts + seen, len(self.group_term))], 0).sum())
            least = self._least(score, sure, top)
            left = np.flatnonzero(score + rest >= least)
            if not rest or done == len(group):
                break
            if len(left) <= top:
                score[left] = [int((weights[self.terms[a:b]] * self.impacts[a:b]).sum()) for a, b in zip(self.at[left].tolist(), self.at[left + 1].tolist(), strict=True)]
                left = left[score[left] >= least]
                break
        best = left[np.lexsort((self.id_rank[left], -score[left]))][:top]
        return best, score[best]

    @staticmethod
    def _least(score: np.ndarray, sure: np.ndarray, top: int) -> int:
        """The score that `top` documents have for certain; 1 if there are fewer."""
        have = np.concatenate((sure, score[score > 0]))
        return max(1, int(np.partition(have, len(have) - top)[len(have) - top])) if len(have) >= top else 1


def _search(index: DataFrame, item_terms: list[np.ndarray], ids: pa.Array, weights: np.ndarray, n_docs: int, total: int, top: int, item_type: str) -> DataFrame:
    """item, item_id, doc_id, score, part: the best documents of each block of the index."""
    shared = index.sparkSession.sparkContext.broadcast((item_terms, weights, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, item_ids = shared.value
        sure = [np.zeros(0, np.int64)] * len(wanted)
        own = np.zeros(len(weight), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("terms"), batch.column("tfs")
            at = np.concatenate(([0], np.cumsum(pc.list_value_length(lists[0]).to_numpy().astype(np.int64))))
            terms, tfs = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            block = Block(batch.column("n").to_numpy(), at, terms, tfs, batch.column("doc_id"), len(weight), n_docs, total)
            items, docs, scores = [], [], []
            for i, mine in enumerate(wanted):
                own[mine] = weight[mine]
                best, score = block.search(mine, own, sure[i], top)
                own[mine] = 0
                if len(best):
                    sure[i] = np.sort(np.concatenate((sure[i], score)))[-top:]
                    items.append(np.full(len(best), i))
                    docs.append(best)
                    scores.append(score)
            if items:
                item = pa.array(np.concatenate(items), pa.int32())
                yield pa.RecordBatch.from_arrays([item, item_ids.take(item), batch.column("doc_id").take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["item", "item_id", "doc_id", "score"])

    schema = f"item int, item_id {item_type}, doc_id {index.schema['doc_id'].dataType.simpleString()}, score bigint"
    return index.select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)


def _best(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, ranked; first within PARTS parts of each, so that no window takes all blocks' rows."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("rank") <= top)
    every = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= top)
    return every.select("item_id", "rank", "doc_id", "score")


def _block_of_items(docs: DataFrame, items: pa.Table, top: int, item_type: str) -> DataFrame | None:
    texts, ids = items["text"].combine_chunks(), items["item_id"].combine_chunks()
    own: list[set[bytes]] = []
    for lo, hi, data, starts, ends, ptr in _terms(texts):
        body, spans = data.tobytes(), list(zip(starts.tolist(), ends.tolist(), strict=True))
        own += [{body[a:b] for a, b in spans[ptr[i] : ptr[i + 1]]} for i in range(hi - lo)]
    vocabulary = Vocabulary.of(set().union(*own))
    index = stored(_index(docs, vocabulary), "postings")
    n_docs, total = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    frequency = np.zeros(len(vocabulary.hashes), np.int64)
    for term, df in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    number = {vocabulary.data[a:b].tobytes(): i for i, (a, b) in enumerate(zip(vocabulary.at.tolist(), vocabulary.at[1:].tolist(), strict=False))}
    wanted = [np.array(sorted(i for i in map(number.get, t) if weights[i] > 0 and frequency[i] > 0), np.int64) for t in own]
    return _best(_search(index, wanted, ids, weights, n_docs, total, top, item_type), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the `top` best documents of every item."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    item_type, doc_type = asked.schema["item_id"].dataType.simpleString(), rows.schema["doc_id"].dataType.simpleString()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    if blocks > 1:
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "items")
    found = None
    for b in range(blocks if n else 0):
        one = _block_of_items(rows, (asked.where(F.col("block") == b) if blocks > 1 else asked).select("item_id", "text").toArrow(), top, item_type)
        found = one if found is None else found if one is None else found.union(one)
    return found if found is not None else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score bigint")


def oracle_sql(top: int = TOP) -> str:
    """The query's result as DuckDB SQL over documents and benchmark."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    return f"""
WITH d AS (SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, {words} AS w FROM benchmark)),
p AS (SELECT r, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
i AS (SELECT r, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // total))) AS gain FROM p JOIN f USING (t), s),
g AS (SELECT q, item_id, r, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT * FROM k WHERE rank <= {top}"""
