"""Conversation repair against an exhaustive search over edits, and against SQL."""

import hashlib
import os
import random
import re
import zlib
from itertools import product

import pytest

from taxolens.llm import op13_conversation_repair as o
from taxolens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def exhaustive(rows, most=3):
    """(cost, audit, repaired) over all edits with up to `most` inserts a gap; rows: (role, text, fault)."""
    inserts = [c for n in range(most + 1) for c in product(("user", "assistant"), repeat=n)]
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for own in inserts:
            more, said = cost + 3 * len(own), [*out, *((r, "") for r in own)]
            marks = audit + "I" * len(own)
            if i == len(rows):
                if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in said)):
                    key = more, marks
                    if best is None or key < best[:2]:
                        best = *key, said
                continue
            role, text, fault = rows[i]
            go(i + 1, more + 4, marks + "D", said)
            if fault in (o.FINE, o.TRUNCATED):
                extra = 3 * (fault == o.TRUNCATED)
                go(i + 1, more + extra, marks + "K", [*said, (role, text)])
                for name in ("user", "assistant"):
                    go(i + 1, more + 3 + extra, marks + "R", [*said, (name, text)])

    go(0, 0, "", [])
    return best


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(o.BLANK if not body else o.DUPLICATE if (role, text) in seen else o.FINE if body[-1] in ".!?" else o.TRUNCATED)
        seen.add((role, text))
    return out


def plain_damage(rows):
    """(conv_id, turn, role, text) after damage, in order; the text's digest breaks ties as in the operator."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()[:30]
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))


def plain_report(rows, damage=True):
    out = []
    every = plain_damage(rows) if damage else rows
    for conv in {r[0] for r in rows}:
        own = [r for r in every if r[0] == conv]
        faults = plain_faults([r[2:] for r in own])
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, said = exhaustive([(r[2], r[3], f) for r, f in zip(own, faults)], 2)
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out.append((conv, gaps, *(faults.count(k) for k in (o.BLANK, o.DUPLICATE, o.TRUNCATED)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_edits(seed):
    r = random.Random(seed)
    for _ in range(60):
        n = r.randrange(6)
        roles = r.choices(["system", "user", "assistant", "tool", ""], weights=[1, 3, 3, 1, 1], k=n)
        faults = r.choices([0, 0, 0, 1, 2, 3], k=n)
        cost, audit, said = exhaustive([(role, "x", f) for role, f in zip(roles, faults)], 2)
        initials = "".join(role[:1] or "\0" for role in roles)
        assert o.repair(initials, bytes(faults)) == (cost, audit)
        replay = o.Repaired(audit)
        got = [p for role in roles for p in replay.row(role, "x")] + list(replay.inserted())
        assert got == said


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_against_one_search(block, monkeypatch):
    r = random.Random(block)
    for n in (0, 1, 2, 9, 40):
        for _ in range(25):
            initials, faults = "".join(r.choices("suaaut", k=n)), bytes(r.choices([0, 0, 0, 1, 2, 3], k=n))
            whole = next(iter(o.ways(initials, faults, o.START, o.ACCEPTING, True).values()))
            assert o.repair(initials, faults, block) == whole


def test_one_very_long_conversation():
    """A hundred thousand rows: as cheap as the sum of the parts that must be edited."""
    n = 100_000
    cost, audit = o.repair("ua" * (n // 2), bytes(n))
    assert (cost, audit) == (0, "K" * n)
    cost, audit = o.repair("u" * n, bytes(n))
    assert cost == 3 * (n // 2) and len(audit) >= n


ODD = [
    (1, 0, "system", "Be short."), (1, 1, "user", "Hi there"), (1, 2, "assistant", "Hello."), (1, 3, "user", "  \n"),
    (2, None, "user", "No turn?"), (2, 5, "assistant", "é ok!\x0b"), (2, 5, "assistant", "other at the same turn."), (2, 9, None, None),
    (3, 1, "tool", "x."), (3, 1, "tool", "x."), (3, 2, "", "y."), (3, 3, "user", "😀"),
    (None, 0, "user", "null id."), (None, 1, "assistant", "yes."),
    (4, None, "user", "a."), (4, None, "assistant", "b."),
    (5, 0, "assistant", "long " * 30_000 + "."), (5, 1, "user", " " * 50_000),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "z") for r in ODD], SCHEMA + ", cost int, audit string")


def test_report_of_odd_rows(odd):
    undamaged = sorted(({r[0] for r in ODD}), key=str)
    got = sorted(map(tuple, o.report(o.damaged(odd)).collect()), key=str)
    assert got == plain_report(ODD)
    assert len(o.report(odd).collect()) == len(undamaged)


def test_all_rows_lost(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = o.report(o.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA))).collect()
    assert [tuple(r) for r in rows] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_nothing(spark):
    assert o.report(o.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c"), (2, 0, "assistant", "d.")]
    got = sorted(tuple(r) for r in o.repaired(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, "user", "a."), (1, 1, "assistant", ""), (1, 2, "user", "b."), (1, 3, "assistant", "c"), (2, 0, "user", ""), (2, 1, "assistant", "d.")]


def test_conversation_over_many_batches(spark):
    """One conversation holds most rows; its rows come in many batches."""
    rows = [(8, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(9, 0, "user", "x."), (9, 1, "assistant", "y.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.conv_id: r for r in o.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = hashlib.sha256("\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 8).encode()).hexdigest()
    assert (got[8].cost, got[8].audit, got[8].repaired_sha256, got[9].audit) == (0, "K" * 3000, want, "KK")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables aren't here")
@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.1")])
def test_query_against_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = QUERIES["op13_conversation_repair"](spark, folder)
    want = con.sql(o.oracle_sql())
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables aren't here")
def test_sql_against_all_edits(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in ODD])
    assert sorted(con.sql(o.oracle_sql()).fetchall(), key=str) == plain_report(ODD)
