"""Mentions by automaton against regular expressions."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.operators import mentions as M
from loomspark.operators.entities import names_in_texts


def by_force(patterns, texts):
    return [{p for p in patterns if p and re.search(r"(?<![a-zA-Z0-9])" + re.escape(p) + r"(?![a-zA-Z0-9])", t)} for t in texts]


LETTERS = st.text(st.sampled_from("ab c(é漢\0"), max_size=9)


@given(st.lists(st.text(st.sampled_from("ab c(é漢"), min_size=1, max_size=5), min_size=1, max_size=12, unique=True), st.lists(LETTERS, max_size=6), st.integers(1, 7), st.sampled_from([8, 200, 10**6]))
@settings(max_examples=300, deadline=None)
def test_automaton(patterns, texts, stretch, cells):
    before, M.STRETCH = M.STRETCH, stretch
    try:
        assert M.free_hits(M.automata(patterns, cells), texts) == by_force(patterns, texts)
    finally:
        M.STRETCH = before


def test_machines_are_dealt_by_first_character():
    words = [a + b for a in "abcdefgh" for b in ("x", "yy", "zzz")]
    machines = M.automata(words, 200)
    assert len(machines) > 2 and sorted(p for m in machines for p in m.patterns) == sorted(words)
    firsts = [{p[0] for p in m.patterns} for m in machines]
    assert sum(map(len, firsts)) == len(set().union(*firsts))
    assert M.automata([]) == []


@pytest.mark.parametrize("shard", [500_000, 12])
def test_mention_edges(spark, monkeypatch, shard):
    monkeypatch.setattr(M, "SHARD_CHARS", shard)
    aliases = [(1, "rope"), (1, "Tau Ring"), (2, "tau ring"), (3, "模型"), (4, "ＱＲＳ"), (5, None), (6, ""), (7, "a.b"), (8, "the")]
    texts = [(1, "A rope, of europe"), (2, "the TAU ring; rope2"), (3, "新模型x 模型"), (4, "qrs and QRS."), (5, None), (6, ""), (7, "acb a.b"), (7, "rope the"), (8, "the"), (9, "the " * 4000 + "rope")]
    frame = spark.createDataFrame(texts, "text_id long, text string").repartition(3)
    named = spark.createDataFrame(aliases, "id int, alias string")
    want = set()
    for i, t in texts:
        hit = by_force([M.fold(a) for _, a in aliases if a], [M.fold(t or "")])[0]
        want |= {(i, k) for k, a in aliases if a and M.fold(a) in hit}
    got = [tuple(r) for r in M.mention_edges(named, frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (1, 1) in want and (4, 4) in want
    fewer = {tuple(r) for r in M.mention_edges(named, frame, share=0.3).collect()}
    assert fewer == {(i, k) for i, k in want if k != 8} != want
    assert {tuple(r) for r in M.mention_edges(named, frame, share=0.3, floor=9).collect()} == want
    assert M.mention_edges(named, frame, share=0.0).count() == 0
    assert M.mention_edges(named.limit(0), frame).count() == 0 and M.mention_edges(named, frame.limit(0)).count() == 0


def test_mention_bridge(spark):
    concepts = [(1, "Velvet bridge code (VBC)", 10), (1, "Velvet bridge code (VBC)", 11), (2, "MQX (mixed query exchange)", 10), (2, "MQX (mixed query exchange)", 12), (3, "Lone thing", 10), (3, "Lone thing", 10)]
    claims = [(1, "VBC needs fewer parts than MQX."), (2, "A velvet bridge code beats MQX here"), (3, "VBCs and the lone thing"), *((k, "nothing at all") for k in range(4, 120))]
    edges, pairs = M.mention_bridge(spark.createDataFrame(concepts, "id int, name string, source_id int"), spark.createDataFrame(claims, "text_id int, text string"))
    assert {tuple(r) for r in edges.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 2)]


def test_names_in_texts_of_one_key(spark):
    names = spark.createDataFrame([("en", 1, "Rope"), ("fr", 2, "rope"), ("en", 3, "rope"), (None, 4, "rope")], "lang string, id int, name string")
    texts = spark.createDataFrame([("en", 1, "a ROPE"), ("de", 2, "rope"), (None, 3, "rope"), ("en", 1, "rope rope")], "lang string, text_id int, text string")
    assert {tuple(r) for r in names_in_texts(names, texts, "lang").collect()} == {("en", 1, 1), ("en", 3, 1)}


def test_hits_count_every_place():
    m = M.Automaton(["aa", "a", "ba"])
    which, at = m.hits(np.array([ord(c) for c in "aabaa"]))
    assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == [(0, 0), (0, 3), (1, 0), (1, 1), (1, 3), (1, 4), (2, 2)]
