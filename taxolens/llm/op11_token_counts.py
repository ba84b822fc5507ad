"""Token counts by byte-pair merging over a heap and a linked list.

A text is split into pieces, each piece into bytes, and the adjacent pair with the
lowest rank is merged again and again (ties: the leftmost).  Pairs wait in a heap;
symbols are linked to their neighbours, so a merge touches two pairs and a piece of
n bytes takes n log n steps, however long.  The count is bytes less merges; no token's
identifier is made.  Counts of short pieces are kept in a table of bounded size.

The vocabulary is read on the driver and broadcast (refused beyond VOCABULARY_BYTES).
Special strings inside a text count as one token each, as in the library's default;
no begin, end or added token is counted, nothing is truncated.

Null and empty texts have 0 bytes and 0 tokens.  Rows are counted one by one, so ties
and repeated rows get equal counts each, and an empty table gives no rows.  Every text is
read whole; memory follows the longest text.  Further columns of any name are left out.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import bound_batches
from taxolens.llm.textkit import CHUNK_BYTES, mix, row_sums, text_chunks

#: Texts with more tokens are over the limit.
LIMIT = 1024
#: Largest vocabulary file that is sent to executors.
VOCABULARY_BYTES = 64 << 20
#: Pieces of at most CACHED_BYTES are kept, CACHED_PIECES of them at once in a worker.
CACHED_BYTES, CACHED_PIECES = 48, 400_000
#: Fixed value: how the vocabulary's texts are split before merging (no two alternatives but the last two begin alike); `less` is filled in.
SPLIT = r" ?[\p{{L}}{less}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{N}}{less}]+| ?[^\s[\p{{L}}{less}][\p{{N}}{less}]]+|\s+(?!\S)|\s+"
#: Characters before U+0540 are settled in every library's tables; later ones begin with this byte or a larger one.
ODD_BYTE = 0xD5
_SHIFT = 32
_LOW = (1 << _SHIFT) - 1


@lru_cache(maxsize=1)
def _unsettled() -> str:
    """Characters that the splitting library's older Unicode tables hold for neither letters nor numbers, as a set's body.

    Only characters that aren't assigned in this interpreter's tables can differ, so the library is asked about those.
    """
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    new = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    out: list[int] = []
    for kind, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        asked = regex.findall(kind, new)
        ends = {b for _, (_, b) in split.pre_tokenize_str("".join(f"{before}{c}\n" for c in asked))}
        out += [ord(c) for i, c in enumerate(asked) if 3 * i + 1 in ends]
    out.sort()
    firsts = [c for c, before in zip(out, [-2, *out], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(out, [*out[1:], -2], strict=False) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


def split_pattern() -> str:
    """SPLIT with the letters and numbers that the library knows."""
    odd = _unsettled()
    return SPLIT.format(less=f"--[{odd}]" if odd else "")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Ranks:
    """Bytes are symbols 0 to 255, merged ones follow.

    ranks: pair of symbols -> rank, shifted; made: merged symbol of each rank; special: strings that are one token;
    pattern: how texts are split.
    """

    ranks: dict[int, int]
    made: list[int]
    special: tuple[str, ...]
    pattern: str

    @staticmethod
    def load(path: str) -> Ranks:
        """From a byte-level vocabulary file in JSON; settings that would change counts otherwise are refused."""
        if os.path.getsize(path) > VOCABULARY_BYTES:
            raise ValueError(f"the vocabulary is larger than {VOCABULARY_BYTES} bytes")
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        whole = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        tokens = said.get("added_tokens", [])
        if not plain or not whole or any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only byte-level vocabularies without normalizer, prefix or stripping are counted")
        symbols = dict(byte_letters())
        ranks: dict[int, int] = {}
        made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made.append(symbols.setdefault(a + b, len(symbols)))
            ranks[symbols[a] << _SHIFT | symbols[b]] = rank << _SHIFT
        return Ranks(ranks, made, tuple(sorted((t["content"] for t in tokens), key=len, reverse=True)), split_pattern())


def tokens_of(piece: bytes, ranks: Ranks) -> int:
    """Symbols that are left when no adjacent pair of the piece can be merged."""
    n = len(piece)
    if n < 2:
        return n
    find, made = ranks.ranks.get, ranks.made
    symbol = list(piece)
    heap = []
    for i in range(n - 1):
        rank = find(symbol[i] << _SHIFT | symbol[i + 1])
        if rank is not None:
            heap.append(rank | i)
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        top = heappop(heap)
        i = top & _LOW
        j, a = after[i], symbol[i]
        if a < 0 or j >= n or find(a << _SHIFT | symbol[j]) != top - i:
            continue  # one of the two was merged since
        symbol[i] = a = made[top >> _SHIFT]
        symbol[j] = -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            rank = find(a << _SHIFT | symbol[k])
            if rank is not None:
                heappush(heap, rank | i)
        h = before[i]
        if h >= 0:
            rank = find(symbol[h] << _SHIFT | a)
            if rank is not None:
                heappush(heap, rank | h)
    return left


def _classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every character before U+0540."""
    kinds = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s"))]
    return np.array([next((k for k, p in kinds if p.match(chr(c))), OTHER) for c in range(0x540)], np.uint8)


LETTER, NUMBER, SPACE, OTHER = range(4)
_CLASS = _classes()
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def usual_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts without a byte of ODD_BYTE or more begin: SPLIT, for all texts at once.

    Pieces are runs of one class.  Of a run of white space before something else, the last character
    is a piece of its own, and a plain space joins what follows.  An apostrophe alone that no space
    precedes takes the letters of a contraction.
    """
    n = len(data)
    kind = _CLASS[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _CLASS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begin[1:] & (kind[:-1] == SPACE) & ~edge[1:n]) + 1  # what follows white space
    last = after - 1 - ((data[after - 1] & 0xC0) == 0x80)
    begin[last] = True
    begin[after[data[last] == 0x20]] = False
    mark = np.flatnonzero(begin[:-1] & (data[:-1] == 0x27) & (kind[1:] == LETTER) & ~edge[1:n])
    one, two = data[mark + 1], np.where(mark + 2 < n, data[np.minimum(mark + 2, n - 1)], 0)
    two[edge[np.minimum(mark + 2, n)]] = 0
    takes = np.where(np.isin(one, list(b"stmd")), 1, np.where((two == 0x65) & np.isin(one, list(b"rv")) | (one == 0x6C) & (two == 0x6C), 2, 0))
    mark, takes = mark[takes > 0], takes[takes > 0]
    begin[mark + 1] = False
    begin[(mark + 1 + takes)[mark + 1 + takes < n]] = True
    return np.flatnonzero(begin)


class Counts(dict):
    """Tokens of each piece (its bytes), worked out once while it is kept."""

    def __init__(self, ranks: Ranks) -> None:
        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(ranks.pattern, regex.V1)
        self.special = regex.compile("|".join(map(regex.escape, ranks.special))) if ranks.special else None

    def __missing__(self, piece: bytes) -> int:
        n = tokens_of(piece, self.ranks)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        return sum(self[m[0].encode()] for m in self.split.finditer(text))

    def tokens(self, text: str) -> int:
        """Tokens of a whole text."""
        if not any(s in text for s in self.ranks.special):
            return self.plain(text)
        at = n = 0
        for m in self.special.finditer(text):
            n += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return n + self.plain(text[at:])

    def usual(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text, for texts without a byte of ODD_BYTE or more and without special strings.

        Pieces of up to 16 bytes are told apart by their bytes as two numbers; each distinct one is looked up once.
        """
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        starts = usual_pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        body = data.tobytes()
        words = np.ndarray(len(data) + 9, "<u8", body + bytes(16), strides=(1,))
        low = words[starts] & _LOW_BYTES[np.minimum(sizes, 8)]
        high = words[np.minimum(starts + 8, len(data))] & _LOW_BYTES[np.clip(sizes - 8, 0, 8)]
        _, first, place = np.unique(mix(low ^ mix(high + sizes.astype(np.uint64))), return_index=True, return_inverse=True)
        kept = np.array([self[body[a:b]] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
        n = kept[place]
        as_first = first[place]
        alone = (sizes > 16) | (low != low[as_first]) | (high != high[as_first]) | (sizes != sizes[as_first])
        alone[first] = False
        rest = np.flatnonzero(alone)
        n[rest] = [self[body[a:b]] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        return row_sums(n, np.searchsorted(starts, offsets))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text."""
        out = np.zeros(len(texts), np.int64)
        for lo, hi, data, offsets in text_chunks(texts):
            odd = np.concatenate(([0], np.cumsum(data >= ODD_BYTE)))
            apart = odd[offsets[1:]] > odd[offsets[:-1]]
            for s in self.ranks.special:
                apart |= pc.match_substring(texts.slice(lo, hi - lo), s).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(apart).tolist():
                out[lo + i] = self.tokens(texts[lo + i].as_py())
            if apart.any():
                kept = pc.if_else(pa.array(apart), "", texts.slice(lo, hi - lo))
                for a, b, own, bounds in text_chunks(kept, 2 * CHUNK_BYTES + len(data)):
                    out[lo + a : lo + b] += self.usual(own, bounds)
            else:
                out[lo:hi] = self.usual(data, offsets)
        return out


def counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_tokens = pa.array(count.texts(texts))
            arrays = [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), n_tokens, pc.greater(n_tokens, limit)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
