"""Chat formatting by compiled templates, with a reader that gets the turns back.

A template marks the turns; control strings inside texts and role names are
escaped with a backslash (which is itself doubled), so that no text can end a turn
or begin one, and every text is read back as it was.  Text inside the template's
generation block is under the loss mask.

Rows are dealt by conversation and sorted by turn; each conversation is rendered
and read as a stream, so a worker holds one turn and the next, however long the
conversation.  (A conversation's digests follow its order, so one task reads it.)

Null text and null role are empty.  Turns with equal numbers are ordered by role
and text; repeated rows are turns of their own.  Rows with a null id form one
conversation, a null turn comes first.  Only the four named columns are read, so
further columns of any name do no harm; an empty table gives only what is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taxolens.llm.common import bound_batches
from taxolens.llm.template import compile_template

#: The strings that control a formatted conversation.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST]{{ m.text | esc }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | esc }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | esc }}<</SYS>>"
    "{% else %}<<ROLE>>{{ m.role | esc }}<</ROLE>>{{ m.text | esc }}</s>{% endif %}"
    "{% endfor %}"
)
#: What the query adds to the table's conversations.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"

_CONTROL = "|".join(map(re.escape, CONTROLS))
_TO_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_ESCAPED = re.compile(rf"\\(\\|{_CONTROL})")
_READ = re.compile(rf"\\(?:\\|{_CONTROL})|({_CONTROL})")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Reader:
    """Reads turns back from formatted text that comes in pieces.

    turn(role, text) is called for each turn.  A piece may end anywhere but inside an escape or a
    control string.
    """

    ENDS = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}

    def __init__(self, turn) -> None:
        self.turn, self.state, self.role, self.held = turn, "assistant", None, []

    def feed(self, piece: str) -> None:
        at = 0
        for m in _READ.finditer(piece):
            if m[1] is None:
                continue
            self.held.append(piece[at : m.start()])
            at = m.end()
            self.control(m[1])
        self.held.append(piece[at:])

    def text(self) -> str:
        out, self.held = unescape("".join(self.held)), []
        return out

    def control(self, mark: str) -> None:
        if mark == "<s>" and self.state == "assistant" and not "".join(self.held):
            self.state = "opened"
        elif mark == "[INST]" and self.state == "opened" and not "".join(self.held):
            self.state = "user"
        elif mark in ("<<SYS>>", "<<ROLE>>") and self.state == "assistant" and not "".join(self.held):
            self.state = "system" if mark == "<<SYS>>" else "role"
        elif mark == "<</ROLE>>" and self.state == "role":
            self.role, self.state = self.text(), "other"
        elif mark == self.ENDS.get(self.state, "</s>" if self.state == "other" else None):
            self.turn(self.role if self.state == "other" else self.state, self.text())
            self.state, self.role = "assistant", None
        else:
            raise ValueError(f"{mark} in {self.state}")

    def close(self) -> None:
        if self.state != "assistant" or "".join(self.held):
            raise ValueError("the last turn isn't closed")


def formatted(conversations: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end) of every conversation: the real output, held whole."""
    from taxolens.llm.template import render

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_template(template, {"esc": escape})
        for key, messages in _grouped(batches):
            out, spans = render(program, messages)
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([out]), pa.array([[list(s) for s in spans]], pa.list_(pa.list_(pa.int64())))], ["conv_id", "formatted", "loss_spans"])

    rows = _dealt(conversations, conv_id, turn, role, text)
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted string, loss_spans array<array<bigint>>")


def _dealt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bound_batches(conversations.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of a sorted stream, each a stream of messages."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    for key, own in groupby(rows(), itemgetter(0)):
        yield key, ({"role": r, "text": t} for _, r, t in own)


def digests(conversations: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What reading the formatted conversations back gives, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_template(template, {"esc": escape})
        rows: list[tuple] = []
        for key, messages in _grouped(batches):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = {"turns": 0, "loss": 0, "chars": 0}

            def seen(who: str, said: str, turns=turns, n=n) -> None:
                turns.update(f"{who}\n{said}\n".encode("utf-8", "surrogatepass"))
                n["turns"] += 1

            reader = Reader(seen)

            def emit(piece: str, made: bool, reader=reader, loss=loss, n=n) -> None:
                n["chars"] += len(piece)
                if made:
                    own = unescape(piece)
                    n["loss"] += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
                reader.feed(piece)

            program({"messages": messages}, emit)
            reader.close()
            rows.append((key, n["turns"], turns.hexdigest(), n["loss"], loss.hexdigest(), n["chars"]))
            if len(rows) >= 1000:
                yield _batch(rows, kind)
                rows = []
        if rows:
            yield _batch(rows, kind)

    dealt = _dealt(conversations, conv_id, turn, role, text)
    kind = to_arrow_type(dealt.schema["conv_id"].dataType)
    return dealt.mapInArrow(run, f"conv_id {dealt.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The four columns of all conversations and of conversation -1."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    probe = probe.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)


def oracle_sql() -> str:
    """The query's result as DuckDB SQL over conversations."""
    pattern = r"\\|" + "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)
    extra = {"user": "<s>[INST][/INST]", "assistant": "</s>", "system": "<<SYS>><</SYS>>"}
    marks = " ".join(f"WHEN '{r}' THEN {len(m)}" for r, m in extra.items())
    esc = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{pattern}'))"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
 (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}')))),
f AS (SELECT *, {esc("text")} + CASE role {marks} ELSE {len("<<ROLE>><</ROLE>></s>")} + {esc("role")} END AS n FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""
