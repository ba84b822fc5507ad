"""Quality rules: a table of thresholds compiled into Spark expressions.

A rule names a measure, a lower and an upper bound; a document is kept if every
measure lies within its bounds.  Measures are built-in expressions over the text
and its words (runs without space, tab, line feed, vertical tab, form feed and
carriage return): lengths, symbol, stop-word and line ratios, and repeats.
There is no user function, no shuffle and no second look at the text.  Repeated
windows of three words are told by 64-bit hashes of their words: in a text of a
million words a wrong match has odds of about one in 37 million.

Null and empty texts have no word: every count is 0, every ratio 0.0, and they
are rejected by the length rule.  Rows are judged one by one, so repeats and ties
are judged alike; further columns of any name are left alone or left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by at this have from or an not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que qui dans pour est pas sur au par avec ce "
    "el los las del y a que se con por para su al lo como más es una"
).split()

SYMBOLS = r"[#*$%&|<>]"
#: Fixed values of the base rule: fewest words, and the largest percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    measure: str
    low: float | None = None
    high: float | None = None

    def passed(self) -> Column:
        c = F.col(self.measure)
        tests = [c >= F.lit(self.low)] * (self.low is not None) + [c <= F.lit(self.high)] * (self.high is not None)
        return tests[0] & tests[1] if len(tests) == 2 else tests[0]


#: Thresholds: low and high bound of each measure.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.35),
    Rule("upper_ratio", None, 0.40),
)


def _repeat_words(grams: Column) -> Column:
    """Words covered by windows that occur twice or more; grams: a hash of each window, in order.

    Windows are sorted by (hash, place); those equal to a neighbour repeat.  Each such window adds
    its three words, less those that the repeated window before it has already covered.
    """
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    at = lambda p, j: F.get(p, j)["g"]
    again = _bound(placed, lambda p: F.filter(p, lambda x, j: x["g"].eqNullSafe(at(p, j - 1)) | x["g"].eqNullSafe(at(p, j + 1))))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(places, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])


def _bound(value: Column, use) -> Column:
    """use(x) with x standing for a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def measures(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, and the measures of each row; names in carry must not be measures."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[F.col(c) for c in carry], body.alias("_text"))
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    df = df.select(*carry, "_text", words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    grams = _bound(hashes, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2))))
    df = df.select(
        *carry,
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("bigint").alias("n_stop_words"),
        (F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_upper"),
        grams.alias("_grams"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    repeats = F.when(F.size(F.array_distinct("_grams")) == F.size("_grams"), F.lit(0).cast("bigint")).otherwise(_repeat_words(F.col("_grams")))
    return df.select(
        *[c for c in df.columns if c != "_grams"],
        repeats.alias("n_repeat_words"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        out &= rule.passed()
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """carry, the measures, base_failed and kept of each row."""
    return measures(docs, text, carry).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_rows(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their own columns, which ride along in a struct.

    The running number keeps the filter above the projection; below it, every bound would count words anew.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_body"))
    judged = judge(row, "_body", ("_row",), rules).withColumn("_n", F.monotonically_increasing_id())
    return judged.where("kept AND _n >= 0").select("_row.*")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result as DuckDB SQL over documents."""
    bounds = " AND ".join([f"{r.measure} >= {r.low}" for r in rules if r.low is not None] + [f"{r.measure} <= {r.high}" for r in rules if r.high is not None])
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
 CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 CAST(len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
 CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.r = w.r),
x AS (SELECT *, CASE WHEN n_words > 0 THEN CAST(word_chars AS DOUBLE) / n_words ELSE 0 END AS mean_word_chars,
 CASE WHEN word_chars > 0 THEN CAST(n_symbols AS DOUBLE) / word_chars ELSE 0 END AS symbol_ratio,
 CASE WHEN n_words > 0 THEN CAST(n_stop_words AS DOUBLE) / n_words ELSE 0 END AS stop_word_ratio,
 CASE WHEN n_lines > 0 THEN CAST(n_dup_lines AS DOUBLE) / n_lines ELSE 0 END AS dup_line_ratio,
 CASE WHEN word_chars > 0 THEN CAST(n_upper AS DOUBLE) / word_chars ELSE 0 END AS upper_ratio,
 (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {bounds}) AS kept FROM x"""
