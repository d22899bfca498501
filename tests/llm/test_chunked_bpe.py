"""Chunked BPE against the library on whole texts, and its cuts and joins alone."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import chunked_bpe
from loomspark.llm.chunked_bpe import cuts, encode_documents, encoding_report, head_of, put_together, tail_of

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def packed(text):
    return np.array(library_ids(text), "<u4").tobytes()


RNG = np.random.default_rng(11)
SOME = ["over", "Under", "été", "漢字", "😀", "it's", "42", "<|endoftext|>", "áb", "İx", " ", "...", "x\x00y"]


def prose(n):
    return "".join(str(RNG.choice(SOME)) + str(RNG.choice([" ", "\n", "", "  "], p=[0.7, 0.1, 0.15, 0.05])) for _ in range(n))


SHARED = prose(900)
TEXTS = [None, "", " ", SHARED, SHARED, "x" + SHARED, SHARED[5:], prose(60) + SHARED + prose(60), prose(60) + "-" + SHARED * 2, SHARED[:4000] + prose(9) + SHARED[4000:]]
TEXTS += ["q" * 5000, "ab" * 4000, "".join(RNG.choice(list("abcdef漢é"), 9000)), "z" + "".join(RNG.choice(list("abcdef"), 4000)), prose(40), prose(4000)]
LONG_WORD = "".join(RNG.choice(list("ghijkl"), 6000))
TEXTS += [LONG_WORD, "a" + LONG_WORD + " b", LONG_WORD + LONG_WORD, "tail " + LONG_WORD]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(3, SHARED), (3, "other"), (None, SHARED), (None, None)]


@pytest.mark.parametrize("unique", [True, False])
def test_documents(spark, unique):
    rows = ROWS[: len(TEXTS)] if unique else ROWS
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("z") for c in ("row", "id", "name", "ids", "names", "packed", "owned", "lent")})
    got = sorted((tuple(r) for r in encoding_report(docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library_ids(t or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    if unique:
        out = encode_documents(docs, PATH)
        assert out.columns == ["doc_id", "ids"]
        assert {r.doc_id: bytes(r.ids) for r in out.collect()} == {i: packed(t or "") for i, t in rows}


def test_empty(spark):
    none = encoding_report(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_cuts_read_only_what_is_near():
    raw = SHARED.encode()
    (plain,) = cuts([raw])
    assert len(plain) > 8 and plain[-1] == len(raw)
    for text in (b"x" + raw, prose(50).encode() + raw):
        (moved,) = cuts([text])
        by = len(text) - len(raw)
        assert [e - by for e in moved if e - by > 600] == [e for e in plain if e > 600]
    assert cuts([b"", b"a" * 9000, b"abc" * 3000]) == [[], [9000], [9000]]
    for block in (700, 1000, 4096):
        assert cuts([raw, raw[:90], raw[7:]], block=block) == cuts([raw, raw[:90], raw[7:]])
    assert all(raw[:e].decode() is not None for e in plain)


BITS = st.lists(st.sampled_from(["a", "B", " ", "\n", "é", "漢", "'s", "<|endoftext|>", "<|end", "oftext|>", ".", "1", "zz"]), min_size=1, max_size=12)


@given(st.lists(BITS.map("".join), max_size=8))
@settings(max_examples=300, deadline=None)
def test_joins_are_repaired(texts):
    parts = [(t.encode(), packed(t)) for t in texts]
    assert put_together(parts, lambda b: packed(b.decode())) == packed("".join(texts))


def test_joins_take_more_words_until_ids_agree():
    """A side whose ids for its outer word are not the word's own is encoded again further in."""
    ids = {b"one two": b"AAAABBBB", b"two": b"bbbb", b"two three": b"CCCC", b"three four": b"DDDDEEEE", b"three": b"DDDD", b"one twothree": b"FFFFGGGG"}
    assert put_together([(b"one two", ids[b"one two"]), (b"three four", ids[b"three four"])], ids.__getitem__) == b"FFFFGGGGEEEE"


def test_words_at_the_sides():
    assert head_of(b"ab cd  ef") == b"ab" and head_of(b" ab cd", 2) == b" ab cd" and head_of(b"") == b""
    assert tail_of(b"ab cd\tef") == b"ef" and tail_of(b"ab cd ", 2) == b"ab cd " and tail_of(b"ab") == b"ab"


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    rows = [(k, SHARED + f" {k}") for k in range(6)]
    seen = []
    keep = chunked_bpe.staged
    monkeypatch.setattr(chunked_bpe, "staged", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).count()
    once = dict(seen)["encoded"]
    assert once.count() == once.select("name").distinct().count() >= 8
