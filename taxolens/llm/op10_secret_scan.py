"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  The ledger
is a table (blob, rules, findings...) with a row for each pair of blob and rule
version that has been scanned (a version is a digest of its rules); a run scans only pairs it doesn't hold, appends
their rows, and joins findings back to all paths.  Work and ledger follow the new
content: a further run over known versions scans nothing.

All of it is DataFrame operations: rules are regular expressions, and the place
of a match follows from the lengths of the matches and of what lies between them
(the text split at the same expression), counted in code points.

Null texts are empty.  Repeated rows, ties and copies share one blob and one
scan, and each row gets the findings.  Null ids stay null.  Columns other than
the id and the text are not read, so clashing names do no harm.  Copies of one
text are reduced on the map side before the shuffle, and spread when findings are joined back.  A text with very many matches
takes time in proportion to them, but for copies of short arrays (see `_spans`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import HOT_KEYS, new_path

#: Rows of one text that lie together when its findings are joined back; more are spread.
COPIES = 1000


@dataclass(frozen=True)
class SecretRule:
    """kind; pattern, whose matches count if `group` has `least` code points; hint: what any match contains."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None


#: The base kinds in their order.  Runs of hex digits are stated with their least length,
#: which finds the same maximal runs.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"([Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])",
    ),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    SecretRule("hex", r"[0-9a-f]{24,}", hint="[0-9a-f]{24}"),
)
#: Further kinds, after the base kinds.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36}", hint="gh[pousr]_"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox[abprs]-"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}", hint="AIza"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="-----BEGIN"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<start:int,rank:int,kind:string,stop:int>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _blocks(items: Column, size: Column) -> Column:
    """An array that isn't empty, cut into arrays of `size` items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, size))


def _no(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _before(totals: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What all earlier items come to, for each item."""
    zero = F.struct(F.lit(0).alias("at"), _no("int").alias("out"))
    return F.aggregate(totals, zero, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def _spans(text: str, rank: int, rule: SecretRule) -> Column:
    """Array of the rule's spans in the text, leftmost, without overlap.

    Matches are added up in blocks of the cube root of their number, as appending to an array copies it:
    the copies are a power of 4/3 of the matches, and all else is linear in the text.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    valued = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    parts = F.zip_with(F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"))), valued, lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.length(v).alias("v")))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        stop = start + x["n"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["v"] >= rule.least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["n"]))
        each = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), _no(SPAN).alias("out")), add, lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, _before(sums, lambda s, x: s + x), each))

    every = _let(parts, lambda p: F.when(F.size(p) > 0, _let(_blocks(p, F.ceil(F.cbrt(F.size(p))).cast("int")), placed)).otherwise(_no(SPAN)))
    return F.when(F.col(text).rlike(rule.hint or rule.pattern), every).otherwise(_no(SPAN))


def scan(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, spans) of (blob, body): every rule's spans, by start and then in the order of the rules."""
    each = blobs.select("blob", *[_spans("body", i, r).alias(f"_{r.kind}") for i, r in enumerate(rules)])
    return each.select("blob", F.sort_array(F.concat(*[F.col(f"_{r.kind}") for r in rules])).alias("spans"))


def blob_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def version_of(rules: tuple[SecretRule, ...], label: str = "rules") -> str:
    """Names a rule table in the ledger: any change of a rule, or of their order, makes another version."""
    return f"{label}-{hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least, r.hint) for r in rules]).encode()).hexdigest()}"


def read_ledger(spark, ledger: str) -> DataFrame:
    """The ledger's rows; none where it doesn't exist yet."""
    schema = f"blob binary, rules string, spans array<{SPAN}>"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_ledger(versions: DataFrame, text: str, ledger: str, rules: tuple[SecretRule, ...] = RULES, label: str = "rules") -> DataFrame:
    """Scans the blobs of versions that the ledger doesn't hold for these rules; returns the ledger's rows for them.

    Two jobs at once, or a job that ran again, may have appended a pair twice; equal pairs hold equal
    spans, and readers take one of them.
    """
    spark, version = versions.sparkSession, version_of(rules, label)
    known = read_ledger(spark, ledger).where(F.col("rules") == version).select("blob")
    blobs = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    unseen = blobs.groupBy("blob").agg(F.first("body").alias("body")).join(known, "blob", "left_anti")
    scan(unseen, rules).select("blob", F.lit(version).alias("rules"), "spans").write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger).where(F.col("rules") == version)


def spread(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (row, _key) with _part, found (_blob, _spans) with _own: the rows of a frequent blob lie in parts of some COPIES rows.

    All executors get the digests of the HOT_KEYS most frequent blobs and their numbers of parts, some 40 bytes
    each; findings are repeated for every part, at most a COPIES-th of the rows.
    """
    copies = rows.groupBy(F.col("_key").alias("_hot")).agg(F.count("*").alias("n")).where(F.col("n") > COPIES)
    hot = F.broadcast(copies.orderBy(F.desc("n"), "_hot").limit(HOT_KEYS).select("_hot", F.ceil(F.col("n") / COPIES).alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64("row", F.spark_partition_id()), F.col("_parts")), F.lit(0))
    rows = rows.join(hot, F.col("_key") == F.col("_hot"), "left").select("row", "_key", part.alias("_part"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_parts"), F.lit(1)).cast("bigint") - 1)
    return rows, found.join(hot, F.col("_blob") == F.col("_hot"), "left").select("_blob", "_spans", F.explode(parts).alias("_own"))


def findings(versions: DataFrame, text: str, carry: tuple[str, ...], ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES, label: str = "rules") -> DataFrame:
    """row (a struct of carry) and spans of every version; without a ledger, a new one in the shared folder is used.

    Only blobs with findings are joined; the rest get an empty list.  Copies of one text are spread (`spread`).
    """
    spark = versions.sparkSession
    held = update_ledger(versions, text, ledger or new_path(spark, "ledger"), rules, label)
    found = held.where("size(spans) > 0").groupBy(F.col("blob").alias("_blob")).agg(F.first("spans").alias("_spans"))
    rows = versions.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), blob_of(text).alias("_key"))
    rows, found = spread(rows, found)
    joined = rows.join(found, (F.col("_key") == F.col("_blob")) & (F.col("_part") == F.col("_own")), "left")
    return joined.select("row", F.coalesce("_spans", _no(SPAN)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    got = findings(rows, "text", ("doc_id",), ledger)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return got.select("row.doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced with the mark.

    spans: in order of start. Reading a place in a text means going there from its beginning, so the text
    is first cut into as many parts as each holds spans.
    """
    def closed(s: Column) -> Column:
        """Each span with the furthest stop of those before it."""
        blocks = _blocks(s, F.ceil(F.sqrt(F.size(s))).cast("int"))
        top = lambda a, b: F.greatest(a, b)

        def each(b: Column, at: Column) -> Column:
            return F.zip_with(b, _before(F.transform(b, lambda x: x["stop"]), top), lambda x, before: F.struct(F.greatest(before, at).alias("at"), x["start"].alias("start")))

        return _let(blocks, lambda bl: F.flatten(F.zip_with(bl, _before(F.transform(bl, lambda b: F.array_max(F.transform(b, lambda x: x["stop"]))), top), each)))

    def joined(gaps: Column) -> Column:
        def part(b: Column) -> Column:
            first = b[0]["at"]
            body = F.substring(text, first + 1, F.element_at(b, -1)["start"] - first)
            return _let(body, lambda t: F.array_join(F.transform(b, lambda x: F.concat(F.substring(t, x["at"] - first + 1, x["start"] - x["at"]), F.lit(mark))), ""))

        return F.array_join(F.transform(_blocks(gaps, F.ceil(F.sqrt(F.size(gaps))).cast("int")), part), "")

    last = F.array_max(F.transform(spans, lambda x: x["stop"]))
    cut = _let(F.filter(closed(spans), lambda x: x["start"] >= x["at"]), joined)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(cut, F.substring(text, last + 1, F.length(text))))


def redact(docs: DataFrame, text: str = "text", ledger: str | None = None) -> DataFrame:
    """The rows with their own columns, the text without its secrets."""
    got = findings(docs, text, tuple(docs.columns), ledger)
    return got.select(*[redacted(F.col("row")[c], F.col("spans")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def oracle_sql(rules: tuple[SecretRule, ...] = RULES) -> str:
    """The same result as DuckDB SQL over documents."""
    def one(i: int, r: SecretRule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""SELECT r, {i} AS rank, '{r.kind}' AS kind, start, start + n AS stop FROM (SELECT r, v, n, CAST(sum(gap + n) OVER (PARTITION BY r ORDER BY k) AS BIGINT) - n AS start FROM (
 SELECT r, k, length(ms[k]) AS n, length(vs[k]) AS v, length(bs[k]) AS gap FROM (SELECT r, ms, vs, bs, unnest(range(1, len(ms) + 1)) AS k FROM (
 SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {r.group}) AS vs, regexp_split_to_array(t, '{p}') AS bs FROM d)))) WHERE v >= {r.least}"""

    count = lambda kind: f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}"
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(one(i, r) for i, r in enumerate(rules))})
SELECT doc_id, {", ".join(count(r.kind) for r in BASE_RULES)}, sha256(coalesce({text} FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256, coalesce({text}, '') AS spans
FROM d LEFT JOIN s USING (r) GROUP BY d.r, doc_id"""

