"""Ranked search against plain Python, and its parts alone."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import ranked_search
from loomspark.llm.ranked_search import Best, accumulate, radix_order, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(docs, items, most):
    cut = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    cut = [(i, Counter(w), len(w)) for i, w in cut if w]
    n, total, df = len(cut), sum(x[2] for x in cut), Counter(w for x in cut for w in x[1])
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(FOLD))), []
        for i, words, size in cut:
            damp = 12 * (75 + 25 * size * n // total)
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * words[t] // (1000 * words[t] + damp)) for t, k in asked.items() if t in words)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


RNG = np.random.default_rng(3)
WORDS = ["Alpha", "beta", "GAMMA", "délta", "42", "é", "漢字", "x9", "the", "THE"]
DOCS = [(k, " ".join(RNG.choice(WORDS, int(RNG.integers(1, 40)), p=[0.05] * 8 + [0.3, 0.3]))) for k in range(120)]
DOCS += [(500 + k, DOCS[3][1]) for k in range(30)] + [(500, DOCS[3][1]), (500, "beta, other"), (None, "42 é-x9"), (None, None), (77, ""), (900, "!?\x7f \x00"), (901, "the " * 5000 + "alpha")]
ITEMS = [(0, "Alpha beta; alpha 42"), (1, "the"), (2, None), (3, "..."), (3, "漢字 é x9"), (None, "délta gamma"), (4, "nowhere")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    # Clashing names, on purpose.
    docs = docs.withColumns({c: F.lit(1) for c in ("item_id", "rank", "score", "n", "df", "docs", "item")})
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"doc_id": F.lit(5), "item": F.lit("i"), "block": F.lit(0)})


@pytest.mark.parametrize(("most", "block"), [(20, 4_000_000), (3, 30)])
def test_search(tables, most, block, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    assert sorted((tuple(r) for r in search(*tables, most=most).collect()), key=str) == by_force(DOCS, ITEMS, most)


def test_empty(tables):
    docs, items = tables
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search(docs, items.limit(0)).count() == 0


@given(st.text(st.sampled_from("aZ é9-.漢"), max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_terms_by_pieces(text, piece):
    before, ranked_search.PIECE = ranked_search.PIECE, piece
    try:
        assert [w.decode() for some in terms(text.encode()) for w in some] == TERM.findall(text.translate(FOLD))
    finally:
        ranked_search.PIECE = before


@given(st.lists(st.integers(0, 2**45), max_size=50))
def test_radix_order(keys):
    x = np.array(keys, np.int64)
    assert radix_order(x).tolist() == np.argsort(x, kind="stable").tolist()


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.integers(1, 100)), max_size=60), st.integers(1, 4))
def test_accumulated_and_selected(rows, most):
    sums = Counter()
    for i, d, x in rows:
        sums[i, d] += x
    items, docs, scores = accumulate(*(np.array([r[j] for r in rows], np.int64) for j in range(3)), 10)
    assert list(zip(items.tolist(), docs.tolist(), scores.tolist(), strict=True)) == [(i, d, sums[i, d]) for i, d in sorted(sums)]
    best, ids = Best(6, most), [7, 3, None, 5, 1, 2, 8, 9, 4, 6]
    for part in (slice(0, len(items) // 2), slice(len(items) // 2, None)):
        best.add(items[part], ids, docs[part], scores[part])
    want = {(i, ids[d], s) for j in range(6) for s, d, i in sorted(((s, d, i) for (i, d), s in sums.items() if i == j), key=lambda r: (-r[0], 99 if ids[r[1]] is None else ids[r[1]]))[:most]}
    assert set(best.rows()) == want
