"""Conversation structure repair: the cheapest edits that make a conversation follow the turn grammar.

Roles have to follow `(s?(ua)+)?` by their initials.  A repair keeps, reroles or deletes every row
and inserts empty turns.  Rows and grammar states form a lattice that is never built: Dijkstra's
search walks it from (row 0, nothing said), by least cost and then by the ASCII-least audit (the
initials of the edits), and ends with the first accepting end node that it takes from its heap.

Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert user or assistant 3; a truncated row
that isn't deleted costs 3 more.  Blank and duplicate rows have to go.

Conversations of up to BLOCK rows are one search.  Longer ones are searched block by block, from each
state to each state; what a block adds to cost and audit depends on its rows alone, so the best way into each
state is the least sum.  (Of two ways to one row with equal costs neither audit begins the other: the rest would be
inserts, which cost.  So appending the same edits keeps their order.)

Structure and text travel apart.  First, rows of a few bytes (place, role's initial, fault,
128-bit digests) meet by conversation and are read as a sorted stream; then texts and the audit meet in another sorted
stream that hashes the repaired conversation as it passes.  A worker holds a conversation's digests and flags
(some 30 bytes a row) and its audit, never its texts.  One conversation is one task, as its digest and audit
follow its rows; sorting spills.

Null roles and texts, and nulls in the key of the damage, are read as one space.  Rows go by turn (nulls first), then by
role and a digest of the text, so ties don't depend on their arrival; repeated rows are duplicates.  A conversation with a null id is one conversation. A role is known
by its first character; an empty role has none and fits nowhere.  Empty tables give no rows;
columns of other names are left out.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taxolens.llm.common import bound_batches

#: Rows that one search spans, and rows up to which results of a search are kept.
BLOCK, CACHED = 4096, 64
#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED_COST = 3, 4, 3, 3
#: Faults of a row.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Grammar states: nothing said, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> the initials that may follow, with the state they lead to.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: Adjacent initials that are right.
LEGAL = ("su", "ua", "au")
#: White space, and what a finished text ends with.
SPACE, ENDING = " \t\n\x0b\x0c\r", ".!?"


def ways(initials: str, faults: bytes, entry: int, goals: tuple[int, ...], first: bool = False) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from the state before these rows to each of the goals after them; first: to the first goal alone."""
    n = len(initials)
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in goals:
            found[state] = cost, audit
            if first or len(found) == len(goals):
                break
        follow = NEXT[state]
        for letter, to in follow.items():
            if letter in NAMES and (i, to) not in done:
                heappush(heap, (cost + INSERT, audit + "I", i, to))
        if i == n:
            continue
        fault = faults[i]
        if (i + 1, state) not in done:
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if fault in (BLANK, DUPLICATE):
            continue
        more = cost + TRUNCATED_COST * (fault == TRUNCATED)
        to = follow.get(initials[i])
        if to is not None:
            heappush(heap, (more, audit + "K", i + 1, to))
        for letter, to in follow.items():
            if letter in NAMES:
                heappush(heap, (more + REROLE, audit + "R", i + 1, to))
    return found


@lru_cache(maxsize=1 << 15)
def _short(initials: str, faults: bytes) -> tuple[int, str]:
    return next(iter(ways(initials, faults, START, ACCEPTING, True).values()))


def repair(initials: str, faults: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The least cost and its ASCII-least audit; initials: one character a row (NUL: none)."""
    if len(initials) <= min(CACHED, block):
        return _short(initials, faults)
    best = {START: (0, "")}
    for at in range(0, len(initials), block):
        rows, marks, last = initials[at : at + block], faults[at : at + block], at + block >= len(initials)
        into: dict[int, list[tuple[int, int, str]]] = {}
        for state, (cost, _) in best.items():
            for to, (more, edits) in ways(rows, marks, state, ACCEPTING if last else tuple(range(4)), last and len(best) == 1).items():
                into.setdefault(to, []).append((cost + more, state, edits))
        least = {to: min(way[0] for way in found) for to, found in into.items()}
        best = {to: (least[to], min(best[state][1] + edits for cost, state, edits in found if cost == least[to])) for to, found in into.items()}
    return min(best.values())


class Repaired:
    """Applies an audit to rows that come one by one; gives the repaired (role, text) pairs."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        letter = next(x for x in NEXT[self.state] if x in NAMES)
        self.state = NEXT[self.state][letter]
        return NAMES[letter]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[0]]
            yield role, text
        elif edit == "R":
            yield self._made(), text


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, dropped (false), nulls of role and text read as a space."""
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"), read(role).alias("role"), read(text).alias("text"), F.lit(False).alias("dropped"))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, dropped after seeded damage, by crc32 of `conv_id:turn` modulo 20.

    0 drops a row (it is marked), 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes its role user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _rows(conversations, conv_id, turn, role, text).withColumn("kind", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20)
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDING, "")).otherwise(F.col("text"))
    who = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", who.alias("role"), said.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def _fault(text: str) -> Column:
    """BLANK, TRUNCATED or FINE, by the text alone."""
    left = F.rtrim(text, F.lit(SPACE))
    return F.when(left == "", BLANK).when(F.right(left, F.lit(1)).isin(*ENDING), FINE).otherwise(TRUNCATED)


#: Columns by which a conversation's rows go; high and low: 120 bits of a digest of role and text.
ORDER = ("conv_id", "first", "turn", "role", "high", "low")


def _ordered(rows: DataFrame) -> DataFrame:
    bound_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER if c in rows.columns])


def _with_digest(rows: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    return rows.withColumn("high", half(1)).withColumn("low", half(16))


def _spans(column: pa.Array) -> list[tuple[int, int]]:
    """Runs of equal values; nulls are equal."""
    n = len(column)
    if not n:
        return []
    now, before = column.slice(1), column.slice(0, n - 1)
    other = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False) | (pc.is_null(now).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))
    cut = [0, *(np.flatnonzero(other) + 1).tolist(), n]
    return list(zip(cut, cut[1:], strict=False))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Iterator[pa.RecordBatch]]]:
    """Conversations of a sorted stream: the id, and the parts of batches that hold its rows."""
    parts = (batch.slice(a, b - a) for batch in batches for a, b in _spans(batch.column("conv_id")))
    ahead = next(parts, None)
    while ahead is not None:
        key, held = ahead.column("conv_id")[0], [ahead]

        def own(key=key, held=held) -> Iterator[pa.RecordBatch]:
            while held:
                yield held.pop()
                part = next(parts, None)
                if part is not None and part.column("conv_id")[0].as_py() == key.as_py():
                    held.append(part)
                else:
                    after.append(part)

        after: list[pa.RecordBatch | None] = []
        mine = own()
        yield key, mine
        for _ in mine:  # what the reader has left
            pass
        ahead = after[0]


def _structure(parts: Iterator[pa.RecordBatch]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit of one conversation's rows."""
    columns = [[part.column(c).to_numpy(zero_copy_only=False) for c in ("turn", "missing", "initial", "fault", "high", "low")] for part in (p.filter(pc.invert(p.column("dropped"))) for p in parts)]
    turn, missing, initial, fault, high, low = (np.concatenate(c) for c in zip(*columns, strict=True))
    n = len(turn)
    if not n:
        return 0, 0, 0, 0, 0, 0, ""
    order = np.lexsort((low, high))  # stable: of equal ones the first comes first
    again = np.zeros(n, bool)
    again[order[1:]] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    fault = np.where(again & (fault != BLANK), DUPLICATE, fault).astype(np.uint8)
    known = turn[missing == 0]
    gaps = int(known[-1]) - int(known[0]) + 1 - int((np.diff(known) != 0).sum()) - 1 if len(known) else 0
    initials = initial.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    legal = sum(initials.count(pair) for pair in LEGAL)  # letters of a pair differ, so pairs don't overlap themselves
    counts = np.bincount(fault, minlength=4)
    return gaps, int(counts[BLANK]), int(counts[DUPLICATE]), int(counts[TRUNCATED]), n - 1 - legal, *repair(initials, fault.tobytes())


MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _many(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows; a batch ends when its strings come to `size` characters or it has 2,000 rows."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if n >= size or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _audits(rows: DataFrame) -> DataFrame:
    """conv_id, the measures and the audit of every conversation; rows: as _rows gives them, with high and low."""
    small = rows.select(
        "conv_id", "turn", F.col("turn").isNull().cast("int").alias("missing"), "high", "low", "dropped",
        F.when(F.col("role") == "", 0).otherwise(F.ascii("role")).alias("initial"), _fault("text").cast("int").alias("fault"), "role",
    )
    small = _ordered(small).drop("role").withColumn("turn", F.coalesce("turn", F.lit(0)))
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    names = ["conv_id", *MEASURES, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((key.as_py(), *_structure(parts)) for key, parts in _by_conversation(batches))
        yield from _many(found, [kind, *[pa.int64()] * len(MEASURES), pa.string()], names)

    return small.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{m} bigint' for m in MEASURES)}, audit string")


def _with_audit(rows: DataFrame) -> DataFrame:
    """A sorted stream: of each conversation first a row with measures and audit, then its rows."""
    rows = _with_digest(rows)
    none = [F.lit(None).cast("bigint").alias(m) for m in MEASURES]
    head = _audits(rows).select("conv_id", F.lit(0).alias("first"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("high", "bigint"), ("low", "bigint"), ("text", "string"))], *MEASURES, "audit")
    body = rows.where("not dropped").select("conv_id", F.lit(1).alias("first"), "turn", "role", "high", "low", "text", *none, F.lit(None).cast("string").alias("audit"))
    return _ordered(head.unionByName(body)).select("conv_id", "role", "text", *MEASURES, "audit")


def _replayed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple | tuple[str, str]]:
    """The conversation's measures and audit, then its repaired (role, text) pairs."""
    first, turns = True, None
    for part in parts:
        rows = zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)
        if first:
            head = part.slice(0, 1).to_pylist()[0]
            yield tuple(head[m] for m in MEASURES) + (head["audit"],)
            turns, first = Repaired(head["audit"]), False
            next(rows)
        for role, text in rows:
            yield from turns.row(role, text)
    yield from turns.inserted()


def _digest(replayed: Iterator[tuple]) -> tuple:
    measures, said, between = next(replayed), hashlib.sha256(), b""
    for role, text in replayed:
        said.update(b"%s%s:%s" % (between, role.encode(), text.encode()))
        between = b"\n"
    return *measures, said.hexdigest()


def report(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    rows = conversations if conversations.columns == ["conv_id", "turn", "role", "text", "dropped"] else _rows(conversations, conv_id, turn, role, text)
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    names = ["conv_id", *MEASURES, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((key.as_py(), *_digest(_replayed(parts))) for key, parts in _by_conversation(batches))
        yield from _many(found, [kind, *[pa.int64()] * len(MEASURES), pa.string(), pa.string()], names)

    return _with_audit(rows).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{m} bigint' for m in MEASURES)}, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0), role, text of every turn of the repaired conversations."""
    rows = _rows(conversations, conv_id, turn, role, text)
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def turns(key: pa.Scalar, replayed: Iterator[tuple]) -> Iterator[tuple]:
        next(replayed)
        for place, (who, said) in enumerate(replayed):
            yield key.as_py(), place, who, said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for key, parts in _by_conversation(batches) for row in turns(key, _replayed(parts)))
        yield from _many(every, [kind, pa.int64(), pa.string(), pa.string()], ["conv_id", "place", "role", "text"])

    return _with_audit(rows).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place bigint, role string, text string")


def oracle_sql() -> str:
    """The query's result as DuckDB SQL over conversations: the cheapest way into each state, row by row, as a text of cost and audit."""
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    add = lambda k, w, e: f"lpad(CAST(CAST(substr({k}, 1, 9) AS BIGINT) + {w} AS VARCHAR), 9, '0') || substr({k}, 10) || '{e}'"
    insert = lambda k: add(k, INSERT, "I")
    made = f"CASE w.s WHEN {USER} THEN 'assistant' ELSE 'user' END"
    follows = f"CASE w.s WHEN {USER} THEN {ASSISTANT} ELSE {USER} END"
    more = f"CASE fault WHEN {TRUNCATED} THEN {TRUNCATED_COST} ELSE 0 END"
    stays = f"fault NOT IN ({BLANK}, {DUPLICATE})"
    closed = f"SELECT *, least(k3, {insert('k2')}) AS c3, k2 AS c2 FROM (SELECT * REPLACE (least(k2, {insert('k0')}, {insert('k1')}, {insert('k3')}) AS k2)"
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM o, t),
x AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDING}', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM d WHERE kind <> 0),
y AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS v, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT y.v, turn, role, text, left(role, 1) AS c, rtrim(text, {space}) AS body, row_number() OVER (PARTITION BY y.v ORDER BY turn NULLS FIRST, role, substr(sha256(strlen(role) || ':' || role || text), 1, 30)) AS i FROM x JOIN y ON x.conv_id IS NOT DISTINCT FROM y.conv_id),
f AS (SELECT *, CASE WHEN body = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY v, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN right(body, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {FINE} END AS fault, lag(c) OVER (PARTITION BY v ORDER BY i) || c AS pair FROM r),
m AS (SELECT v, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated,
 count(*) FILTER (i > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY v),
p AS (SELECT v, CAST(0 AS BIGINT) AS i, '000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS k3 FROM y
 UNION ALL SELECT v, i, {add("k0", DELETE, "D")}, least({add("k1", DELETE, "D")}, CASE WHEN {stays} AND c = 's' THEN {add("k0", more, "K")} END),
 least({add("c2", DELETE, "D")}, CASE WHEN {stays} AND c = 'u' THEN {add("least(k0, k1, c3)", more, "K")} END, CASE WHEN {stays} THEN {add("least(k0, k1, c3)", f"{REROLE} + {more}", "R")} END),
 least({add("c3", DELETE, "D")}, CASE WHEN {stays} AND c = 'a' THEN {add("c2", more, "K")} END, CASE WHEN {stays} THEN {add("c2", f"{REROLE} + {more}", "R")} END)
 FROM ({closed} FROM (SELECT f.v, f.i, f.c, f.fault, p.k0, p.k1, p.k2, p.k3 FROM p JOIN f ON f.v = p.v AND f.i = p.i + 1)))),
e AS (SELECT v, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM (SELECT v, least(k0, c3) AS best FROM ({closed} FROM (SELECT p.* FROM p LEFT JOIN m USING (v) WHERE p.i = coalesce(m.n, 0)))))),
w AS (SELECT v, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS i, {START} AS s, CAST([] AS VARCHAR[]) AS out, audit FROM e
 UNION ALL SELECT w.v, w.step + 1, CASE WHEN g = 'I' THEN w.i ELSE w.i + 1 END, CASE g WHEN 'D' THEN w.s WHEN 'K' THEN CASE f.c WHEN 's' THEN {SYSTEM} WHEN 'u' THEN {USER} ELSE {ASSISTANT} END ELSE {follows} END,
 CASE g WHEN 'D' THEN out WHEN 'K' THEN list_append(out, f.role || ':' || f.text) WHEN 'R' THEN list_append(out, {made} || ':' || f.text) ELSE list_append(out, {made} || ':') END, audit
 FROM (SELECT *, substr(audit, CAST(step + 1 AS INTEGER), 1) AS g FROM w WHERE step < length(audit)) w LEFT JOIN f ON f.v = w.v AND f.i = w.i + 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, w.audit, sha256(array_to_string(out, chr(10))) AS repaired_sha256
FROM y LEFT JOIN m USING (v) JOIN e USING (v) JOIN w ON w.v = y.v AND w.step = length(w.audit)"""
