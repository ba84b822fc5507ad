"""Token counts against the vocabulary's own library and against one-by-one merging."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from taxolens.llm import op11_token_counts as o
from test_text_operators import ODD, SCHEMA, frame, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ranks():
    return o.Ranks.load(PATH)


def expected(library, texts):
    return [len(e) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def rescanned(piece, ranks):
    """Merges the lowest pair, found by looking at all pairs again each time."""
    symbol = list(piece)
    while True:
        found = [(ranks.ranks[k], i) for i, k in enumerate(a << 32 | b for a, b in zip(symbol, symbol[1:])) if k in ranks.ranks]
        if not found:
            return len(symbol)
        rank, i = min(found)
        symbol[i : i + 2] = [ranks.made[rank >> 32]]


def test_heap_against_rescanning(ranks):
    r = random.Random(5)
    for _ in range(300):
        piece = "".join(r.choices("abcdeinorst é1", k=r.randrange(40))).encode()
        assert o.tokens_of(piece, ranks) == rescanned(piece, ranks)


SPECIAL = ["<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", "  <|endoftext|>", "<|endoftext|", "<|endoftext|>一", " 'S's'll x'll 're're"]


def test_counts_against_library(spark, library):
    texts = [*ODD, *SPECIAL, *[words(n, n) for n in (1, 7, 400)]]
    rows = o.counts(frame(spark, texts), PATH, limit=100).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = expected(library, [t])[0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100), t[:50]


@pytest.mark.parametrize(
    "letters",
    [
        "'stmdrevl  a1\n\x85",
        "'''ab  \t\n.é\xa0́ß¾²",
        [chr(c) for c in range(0x540)],
        [chr(c) for c in (*range(0x530, 0x560), *range(0x2000, 0x2070), 0x1F600, 0x323B0, 0x88F, 0x1C89, 0xA7DD, 0x4E00, 0x3000, 0x20, 0x27, 0x73)],
    ],
)
def test_splitting_against_library(library, ranks, letters):
    r = random.Random(11)
    texts = ["".join(r.choices(letters, k=r.randrange(16))) for _ in range(4000)]
    assert o.Counts(ranks).texts(pa.array(texts)).tolist() == expected(library, texts)


def test_every_character_is_of_the_librarys_class(library, ranks):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 7]
    texts = ["".join(f"a{c}1{c} {c}\n" for c in chars[i : i + 256]) for i in range(0, len(chars), 256)]
    assert o.Counts(ranks).texts(pa.array(texts)).tolist() == expected(library, texts)


def test_small_table_of_pieces(library, ranks, monkeypatch):
    monkeypatch.setattr(o, "CACHED_PIECES", 3)
    texts = [words(200, 1), words(200, 2)]
    assert o.Counts(ranks).texts(pa.array(texts)).tolist() == expected(library, texts)


def test_repeats_null_ids_and_no_rows(spark, library):
    odd = spark.createDataFrame([(None, "null id", 1.0, "a", "b"), (3, "twice", 1.0, "a", "b"), (3, "twice", 1.0, "a", "b")], SCHEMA)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in o.counts(odd, PATH).collect()) == sorted(zip([-1, 3, 3], expected(library, ["null id", "twice", "twice"])))
    assert o.counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        o.Ranks.load(public_tokenizers.path("word_bpe_49k.json"))
