"""URL filters by a sorted array of digests.

A rule list becomes one file: the rules' XXH64 digests in ascending order with
their places in a heap of strings.  Executors get the file through Spark's file
distribution and map it into memory, so a list of any size costs pages that are
touched, not a copy for each worker, and a new executor fetches its own.  A url's
candidates, every suffix of its host with every rule-path length that its path
has, are probed by one vectorised binary search a batch; a hit counts only if the
stored string equals the candidate, so collisions of digests change nothing.

Host: after the first :// up to /, ? or # or the end, A-Z lower-cased.  Path: from
there up to ? or # or the end.  A null url, or one without ://, has both empty.
The longest fitting rule wins (of equally long ones that with the longer host).
A url that no rule fits gets the default verdict.  Rows are judged one by one, so
repeats and ties are judged alike; an empty table gives an empty result and an
empty rule list the default.  Only the id and the url are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.llm.common import new_path

#: The rules of the query, (verdict, host and path).
QUERY_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DEFAULT_VERDICT = "allow"

_AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    m = _PARTS.match(url, at + 3)
    return m[1].translate(_AZ), m[2]


def _digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


ROW = np.dtype([("digest", "<u8"), ("start", "<i8"), ("stop", "<i8"), ("block", "<i8")])


def packed(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file's content: four sizes, the lengths of rule paths, the rows by digest, the heap of host/path rules.

    rules: (verdict, rule); of equal rules the last counts.
    """
    kept = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"not a rule: {verdict!r} {rule!r}")
        kept[f"{host.translate(_AZ)}/{path}".encode()] = verdict
    rows = sorted((_digest(k), k, v) for k, v in kept.items())
    heap = b"".join(k for _, k, _ in rows)
    ends = np.cumsum([len(k) for _, k, _ in rows], dtype=np.int64)
    index = np.zeros(len(rows), ROW)
    if rows:
        index["digest"], index["stop"], index["block"] = [d for d, _, _ in rows], ends, [v == "block" for _, _, v in rows]
        index["start"][1:] = ends[:-1]
    lengths = sorted({len(k.decode().partition("/")[2]) + 1 for _, k, _ in rows})
    labels = max((k.partition(b"/")[0].count(b".") + 1 for _, k, _ in rows), default=0)
    return np.array([len(rows), len(lengths), labels, len(heap), *lengths], "<i8").tobytes() + index.tobytes() + heap


def build(rules: Iterable[tuple[str, str]], file: str) -> None:
    with open(file, "wb") as f:
        f.write(packed(rules))


@dataclass
class RuleIndex:
    index: np.ndarray
    digests: np.ndarray
    heap: np.ndarray
    lengths: list[int]
    labels: int  # of the longest rule host; a longer suffix fits no rule

    @classmethod
    def open(cls, file: str) -> RuleIndex:
        whole = np.memmap(file, np.uint8, "r")
        n, n_lengths, labels, _ = whole[:32].view("<i8").tolist()
        rows = 32 + 8 * n_lengths
        heap = rows + n * ROW.itemsize
        index = whole[rows:heap].view(ROW)
        return cls(index, index["digest"], whole[heap:], whole[32:rows].view("<i8").tolist(), labels)

    def candidates(self, host: str, path: str) -> Iterator[bytes]:
        labels = host.rsplit(".", self.labels)[-self.labels :] if self.labels else []
        paths = [path[:n] for n in self.lengths if n <= len(path)]
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for p in paths:
                yield (suffix + p).encode("utf-8", "surrogatepass")

    def judge(self, parts: list[tuple[str, str]], default: str) -> tuple[list[str | None], list[str]]:
        """Rule and verdict of each (host, path)."""
        rules: list[str | None] = [None] * len(parts)
        verdicts = [default] * len(parts)
        keys, owner = [], []
        for i, (host, path) in enumerate(parts):
            if host and path:
                mine = list(self.candidates(host, path))
                keys += mine
                owner += [i] * len(mine)
        if not keys or not len(self.index):
            return rules, verdicts
        probes = np.fromiter((_digest(k) for k in keys), np.uint64, len(keys))
        lo = np.searchsorted(self.digests, probes, "left")
        hi = np.searchsorted(self.digests, probes, "right")
        best: dict[int, tuple[int, int]] = {}
        for j in np.flatnonzero(hi > lo).tolist():
            for at in range(int(lo[j]), int(hi[j])):
                row = self.index[at]
                if self.heap[row["start"] : row["stop"]].tobytes() != keys[j]:
                    continue
                rule = keys[j].decode("utf-8", "surrogatepass")
                rank = (len(rule), len(rule.partition("/")[0]))
                if best.get(owner[j], (0, 0)) < rank:
                    best[owner[j]] = rank
                    rules[owner[j]], verdicts[owner[j]] = rule, "block" if row["block"] else "allow"
        return rules, verdicts


def distribute(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Writes the file to the shared folder and hands it to Spark, which brings it to every executor; returns its name.

    It is deleted when the driver ends. The list itself is the caller's, on the driver.
    """
    path = new_path(spark, "url-rules")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(packed(rules))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = QUERY_RULES, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    name = distribute(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = RuleIndex.open(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found, verdicts = held.judge(parts, default)
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def oracle_sql() -> str:
    """The query's result as DuckDB SQL over pages."""
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in QUERY_RULES)
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.r, rules.rule, rules.verdict, row_number() OVER (PARTITION BY p.r ORDER BY length(rules.rule) DESC, length(rhost) DESC) AS k
 FROM p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, '{DEFAULT_VERDICT}') AS verdict FROM p LEFT JOIN m ON m.r = p.r AND m.k = 1"""
