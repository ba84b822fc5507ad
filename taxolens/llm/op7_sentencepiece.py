"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

A text is cut into units (a run of spaces with what follows it; line feeds stand
alone), which no merge crosses.  Within a unit the agenda is worked off by score,
leftmost first.  The candidate merges of a unit are numbered as they come up, and
number t is skipped with probability `dropout`, by a hash keyed with the seed, the
document's id, the unit's place in the text and t.  So every occurrence of a unit
has draws of its own, a segmentation depends on id, text and seed alone, and it is
repeatable on any cluster.  Without dropout it is the plain merge segmentation.

The plain segmentation of each different unit is worked out once.  An occurrence of
which no candidate is skipped has just that; for the others, occurrences of a unit
with the same skipped numbers share one run.  That only saves work: a draw is never
shared.  Different units of a chunk are worked off at once: each round merges the
best candidate of every unit that has one.  Long units go through a heap, one by
one.  Runs seen before come from a bounded cache.

Characters the vocabulary lacks, and the character that stands for a space inside
pieces, become byte pieces, so decoding gives back every text.  Null and empty
texts have no pieces; null decodes as empty.  Rows of equal id and text get equal
pieces, and so do those of equal text and null id.  A text is never split over
workers: one takes some 100 times the bytes of its longest text, or of a chunk of
1 MiB.  Only ids and texts are read, so further columns of any name do no harm; the
model file is read on the driver and its tables, of the vocabulary's size, are
broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import bound_batches
from taxolens.llm.textkit import mix, span_hashes, text_chunks

DROPOUT = 0.1
SEED = 17
#: Units with more characters than this are worked off with a heap.
LONG_UNIT = 48
CACHE_UNITS = 200_000
CHUNK = 1 << 20
SPACE = "▁"

_U = np.uint64


@dataclass
class Vocabulary:
    char_id: np.ndarray  # by code point; -1: not a piece
    pair_key: np.ndarray  # left id << 20 | right id, sorted
    pair_id: np.ndarray  # the piece that the pair makes
    rank: np.ndarray  # by id; the smaller, the sooner merged
    byte_id: np.ndarray  # by byte
    piece_bytes: np.ndarray  # all pieces' bytes, as they decode
    piece_at: np.ndarray

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        char_id = np.full(0x110000, -1, np.int32)
        pairs: dict[int, int] = {}
        for p, i in ids.items():
            if len(p) == 1:
                char_id[0x20 if p == SPACE else ord(p)] = i
            for k in range(1, len(p)):
                if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                    pairs[a << 20 | b] = i
        char_id[ord(SPACE)] = -1
        keys = np.array(sorted(pairs), np.int64)
        scores = np.array([sp.get_score(i) if plain[i] else -np.inf for i in range(n)])
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), -scores))] = np.arange(n)
        byte_id = np.full(256, -1, np.int32)
        decoded = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                byte_id[int(p[3:5], 16)] = i
                decoded.append(bytes([int(p[3:5], 16)]))
            else:
                decoded.append(p.replace(SPACE, " ").encode() if plain[i] else b"")
        if (byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so it can't decode every text")
        return cls(char_id, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), rank, byte_id, np.frombuffer(b"".join(decoded), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in decoded]))))

    def __post_init__(self) -> None:
        """A table of pairs by hash, with the next free place for pairs whose own is taken."""
        self.shift = _U(64 - max(4, int(4 * len(self.pair_key)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slot_key, self.slot_id = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left, at = np.arange(len(self.pair_key)), self._slot(self.pair_key)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slot_key[at] < 0]
            self.slot_key[at[self.slot_key[at] < 0]] = self.pair_key[free]  # of several pairs one gets the place
            placed = self.slot_key[at] == self.pair_key[left]
            self.slot_id[at[placed]] = self.pair_id[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getstate__(self) -> dict:
        return {f: getattr(self, f) for f in self.__dataclass_fields__}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair makes; -1: none."""
        key = (left.astype(np.int64) << 20) | right
        at = self._slot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_id[at], -1)
        other = np.flatnonzero((held != key) & (held >= 0) & (left >= 0) & (right >= 0))
        for _ in range(1, self.probes):
            if not len(other):
                break
            at[other] = (at[other] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[at[other]]
            same = held == key[other]
            out[other[same]] = self.slot_id[at[other[same]]]
            other = other[~same & (held >= 0)]
        out[(left < 0) | (right < 0)] = -1
        return out


#: Whether candidate t of unit u is skipped, for arrays of both.
Skip = Callable[[np.ndarray, np.ndarray], np.ndarray]


def drawn(keys: np.ndarray, t: np.ndarray, dropout: float) -> np.ndarray:
    """Whether candidate t is skipped, by a hash of t and the key of seed, document and unit."""
    return (mix(keys + (t.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)) >> _U(11)).astype(np.float64) * 2.0**-53 < dropout


def each_draw(keys: np.ndarray, many: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which key, t, skipped) for t below `many` of each key."""
    which = np.repeat(np.arange(len(keys)), many)
    t = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return which, t, drawn(keys[which], t, dropout)


def _code_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    b0 = data[starts].astype(np.int64)
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) if len(data) else np.zeros(3, np.int64)
    b1, b2, b3 = (pad[starts + k] & 0x3F for k in (1, 2, 3))
    return np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3)))


def _work_off(vocab: Vocabulary, ids: np.ndarray, start: np.ndarray, unit: np.ndarray, skip: Skip | None, seen: np.ndarray, first_seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges all units at once. ids, start, unit: of each symbol in order; returns the same of what is left.

    seen, first_seen: by unit, the candidates that came up in all and at first; filled in.
    """
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def candidates(at: np.ndarray) -> np.ndarray:
        """Piece made of symbol at and the next, or -1."""
        out = np.full(len(at), -1, np.int32)
        ok = at + 1 < len(ids)
        ok[ok] = unit[at[ok]] == unit[at[ok] + 1]
        i = at[ok]
        made = vocab.merged(ids[i], ids[i + 1])
        some = np.flatnonzero(made >= 0)
        if len(some):
            u = unit[i[some]]
            head = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            many = np.diff(np.append(head, len(u)))
            if skip:
                made[some[skip(u, seen[u] + np.arange(len(u)) - np.repeat(head, many))]] = -1
            seen[u[head]] += many
        out[ok] = made
        return out

    made = candidates(np.arange(len(ids)))
    first_seen[:] = np.maximum(first_seen, seen)
    worst = np.int64(1) << 60
    # the least is the best: rank, then place
    score = np.where(made >= 0, vocab.rank[made] << 40, worst)
    while len(ids):
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.minimum.reduceat(score + np.arange(len(ids)), first)
        going = best < worst
        if not going.all():
            rest = np.repeat(~going, np.diff(np.append(first, len(ids))))
            done.append((ids[rest], start[rest], unit[rest]))
            keep = ~rest
            moved = np.cumsum(keep) - 1
            ids, start, unit, made, score = ids[keep], start[keep], unit[keep], made[keep], score[keep]
            if not len(ids):
                break
            at = moved[best[going] & ((1 << 40) - 1)]
        else:
            at = best & ((1 << 40) - 1)
        ids[at] = made[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # places after the second symbols have gone
        ids, start, unit, made, score = ids[keep], start[keep], unit[keep], made[keep], score[keep]
        before = at[at > 0] - 1
        mark = np.zeros(len(ids), bool)
        mark[at] = mark[before[unit[before] == unit[before + 1]]] = True
        changed = np.flatnonzero(mark)
        made[changed] = now = candidates(changed)
        score[changed] = np.where(now >= 0, vocab.rank[now] << 40, worst)
    if not done:
        return ids, start, unit
    ids, start, unit = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.lexsort((start, unit))
    return ids[order], start[order], unit[order]


def _work_off_one(vocab: Vocabulary, ids: list[int], start: list[int], unit: int, skip: Skip | None) -> tuple[list[int], list[int], int, int]:
    """One long unit by a heap: the same merges in the same order. Pieces, where they begin, candidates in all and at first."""
    n = len(ids)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int, int]] = []
    seen = 0

    def push_all(lefts: list[int]) -> None:
        nonlocal seen
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        a, b = np.array([ids[i] for i in lefts], np.int32), np.array([ids[after[i]] for i in lefts], np.int32)
        made = vocab.merged(a, b)
        some = np.flatnonzero(made >= 0)
        numbers = seen + np.arange(len(some))
        seen += len(some)
        if skip:
            some = some[~skip(np.full(len(some), unit), numbers)]
        for j in some.tolist():
            heapq.heappush(heap, (int(vocab.rank[made[j]]), lefts[j], int(made[j]), int(a[j]), int(b[j])))

    push_all(list(range(n)))
    at_first = seen
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        if not live[i] or ids[i] != a or after[i] >= n or ids[after[i]] != b:
            continue
        j = after[i]
        ids[i], live[j], after[i] = made, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        push_all([before[i], i])
    return [ids[i] for i in range(n) if live[i]], [start[i] for i in range(n) if live[i]], seen, at_first


def encode_units(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, skip: Skip | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of each unit (bytes starts:ends of data), where each unit's begin, its candidates, and how many any run may have."""
    n = len(starts)
    sizes = ends - starts
    base = np.concatenate(([0], np.cumsum(sizes)))
    flat = data[np.repeat(starts - base[:-1], sizes) + np.arange(base[-1])]
    chars = np.flatnonzero((flat & 0xC0) != 0x80)
    unit = np.repeat(np.arange(n, dtype=np.int32), sizes)[chars]
    ids = vocab.char_id[_code_points(flat, chars)]
    start = (chars - base[unit]).astype(np.int32)
    count = np.bincount(unit, minlength=n)
    long = count > LONG_UNIT
    short = ~long[unit]
    seen, first_seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
    got = [_work_off(vocab, ids[short].copy(), start[short], unit[short], skip, seen, first_seen)]
    at = np.concatenate(([0], np.cumsum(count)))
    for u in np.flatnonzero(long).tolist():
        one, where, seen[u], first_seen[u] = _work_off_one(vocab, ids[at[u] : at[u + 1]].tolist(), start[at[u] : at[u + 1]].tolist(), u, skip)
        got.append((np.array(one, np.int32), np.array(where, np.int32), np.full(len(one), u, np.int32)))
    ids, start, unit = (np.concatenate([g[i] for g in got]) for i in range(3))
    if len(got) > 1:
        order = np.lexsort((start, unit))
        ids, start, unit = ids[order], start[order], unit[order]
    # characters without a piece become one piece a byte
    stop = np.append(start[1:], 0)
    last = np.append(unit[1:] != unit[:-1], True) if len(unit) else np.zeros(0, bool)
    stop[last] = sizes[unit[last]]
    width = np.where(ids >= 0, 1, stop - start)
    out = np.repeat(ids, width)
    raw = np.repeat(ids < 0, width)
    where = np.repeat(base[unit] + start, width) + (np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width))
    out[raw] = vocab.byte_id[flat[where[raw]]]
    # each merge brings up two candidates at most
    return out.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(unit, weights=width, minlength=n).astype(np.int64)))), seen, first_seen + 2 * np.maximum(count - 1, 0)


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[at[k]:at[k + 1]] for each k of which, one after another, and their sizes."""
    sizes = (at[1:] - at[:-1])[which]
    total = np.cumsum(sizes)
    return values[np.repeat(at[:-1][which] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)], sizes


class Runs:
    """A bounded cache of runs by a 64-bit key: pieces, candidates of the run, and how many any run of the unit may have."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.ids, self.at, self.seen, self.most = np.zeros(0, _U), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which of them are held."""
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        return place, known

    def complete(self, unique: np.ndarray, work: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Holds all of the sorted keys afterwards, by work(which of them are new); returns their places."""
        place, known = self.find(unique)
        new = np.flatnonzero(~known)
        if len(new):
            fresh, fresh_at, seen, most = work(new)
            if len(self.keys) + len(new) > CACHE_UNITS:
                kept = place[known]
                old, sizes = gather(self.ids, self.at, kept)
            else:
                kept, old, sizes = slice(None), self.ids, np.diff(self.at)
            keys = np.concatenate([self.keys[kept], unique[new]])
            order = np.argsort(keys)
            at = np.concatenate(([0], np.cumsum(np.concatenate([sizes, np.diff(fresh_at)]))))
            self.ids, sizes = gather(np.concatenate([old, fresh]), at, order)
            self.keys, self.at = keys[order], np.concatenate(([0], np.cumsum(sizes)))
            self.seen, self.most = (np.concatenate([a[kept], b])[order] for a, b in ((self.seen, seen), (self.most, most)))
        return np.searchsorted(self.keys, unique)


class Encoder:
    def __init__(self, vocab: Vocabulary, dropout: float = DROPOUT, seed: int = SEED) -> None:
        self.vocab, self.dropout, self.salt = vocab, dropout, _U((seed * 0x2545F4914F6CDD1D + 1) % (1 << 64))
        self.plain, self.skipped = Runs(), Runs()

    def chunk(self, data: np.ndarray, offsets: np.ndarray, documents: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each text's begin, the bytes with a space before each text that isn't empty, offsets of those).

        documents: a 64-bit key of each text's document; 0 for all if it isn't given.
        """
        sizes = np.diff(offsets)
        lead = (sizes > 0).astype(np.int64)
        bounds = offsets + np.concatenate(([0], np.cumsum(lead)))
        body = np.full(len(data) + int(lead.sum()), 0x20, np.uint8)
        body[np.arange(len(data)) + np.repeat(np.cumsum(lead), sizes)] = data
        space, feed = body == 0x20, body == 0x0A
        cut = np.zeros(len(body), bool)
        if len(body):
            cut[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
            cut[bounds[:-1][lead > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(body))
        ptr = np.searchsorted(starts, bounds)
        content = span_hashes(body, starts, ends)
        unique, first, unit = np.unique(content, return_index=True, return_inverse=True)
        place = self.plain.complete(unique, lambda new: encode_units(self.vocab, body, starts[first[new]], ends[first[new]]))
        ids, at, source = self.plain.ids, self.plain.at, place[unit]
        if self.dropout > 0 and len(starts):
            number = np.arange(len(starts)) - np.repeat(ptr[:-1], np.diff(ptr))
            document = np.zeros(len(sizes), _U) if documents is None else documents.view(_U)
            keys = mix(mix(np.repeat(document, np.diff(ptr)) + self.salt) + number.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
            which, _, skipped = each_draw(keys, self.plain.seen[source], self.dropout)
            changed = np.unique(which[skipped])
            if len(changed):
                more_ids, more_at, again = self._skipping(body, starts[changed], ends[changed], content[changed], keys[changed], self.plain.most[source[changed]])
                source[changed] = len(at) - 1 + again
                ids, at = np.concatenate([ids, more_ids]), np.concatenate([at, at[-1] + more_at[1:]])
        out, widths = gather(ids, at, source)
        ends_ = np.concatenate(([0], np.cumsum(widths)))
        for held in (self.plain, self.skipped):
            if len(held.keys) > CACHE_UNITS:
                held.clear()
        return out, ends_[ptr], body, bounds

    def _skipping(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, content: np.ndarray, keys: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each run's begin, the run of each occurrence) of occurrences of which a candidate is skipped."""
        few = most <= 64
        some, rest = np.flatnonzero(few), np.flatnonzero(~few)
        which, t, skipped = each_draw(keys[some], most[some], self.dropout)
        mask = np.zeros(len(some), _U)
        np.bitwise_or.at(mask, which[skipped], _U(1) << t[skipped].astype(_U))
        run = mix(content[some] + mix(mask ^ _U(0x9E3779B97F4A7C15)))
        unique, first, inverse = np.unique(run, return_index=True, return_inverse=True)

        def work(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            own, masks = some[first[new]], mask[first[new]]
            return encode_units(self.vocab, body, starts[own], ends[own], lambda u, t: (masks[u] >> t.astype(_U)) & _U(1) > 0)

        place = self.skipped.complete(unique, work)
        ids, at = self.skipped.ids, self.skipped.at
        again = np.empty(len(starts), np.int64)
        again[some] = place[inverse]
        if len(rest):
            own = keys[rest]
            more, more_at, _, _ = encode_units(self.vocab, body, starts[rest], ends[rest], lambda u, t: drawn(own[u], t, self.dropout))
            again[rest] = len(at) - 1 + np.arange(len(rest))
            ids, at = np.concatenate([ids, more]), np.concatenate([at, at[-1] + more_at[1:]])
        return ids, at, again


def decode_bytes(vocab: Vocabulary, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the pieces, with the space before each text, and where each text's begin."""
    data, sizes = gather(vocab.piece_bytes, vocab.piece_at, ids)
    return data, np.concatenate(([0], np.cumsum(sizes)))[ptr]


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids (array of piece ids), lossless (decoding the ids gives the text) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, dropout, seed)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text"), CHUNK):
                ids, ptr, body, bounds = encoder.chunk(data, offsets, batch.column("key").slice(lo, hi - lo).to_numpy())
                back, at = decode_bytes(shared.value, ids, ptr)
                if len(back) == len(body) and np.array_equal(at, bounds) and np.array_equal(back, body):
                    same = np.ones(hi - lo, bool)
                else:
                    same = np.array([np.array_equal(back[a:b], body[c:d]) for a, b, c, d in zip(at, at[1:], bounds, bounds[1:], strict=False)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(ptr)), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids)), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "lossless"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("key"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model_file: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of every row of piece ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for pieces in batch.column("ids"):
                own = np.array(pieces.values.to_numpy() if pieces.is_valid else [], np.int64)
                texts.append(decode_bytes(shared.value, own, np.array([0, len(own)]))[0].tobytes().decode().removeprefix(" "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
