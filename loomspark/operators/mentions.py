"""Mentions of many names in many texts, by a multi-pattern automaton.

The alias table is cut into shards of bounded length. A shard's aliases go to every task, which builds their automaton once and
passes its texts through it: transitions are one dense array (state x character class), so that a few thousand stretches of
text take a step together in one gather. No pair of a name and a text is made that is not a hit, and texts are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.curation import aliases as aliases_of
from loomspark.operators.entities import co_mentions
from loomspark.session import staged

#: Characters of aliases in a shard, cells of one transition array, characters of texts in step at once, and of one stretch.
SHARD_CHARS, CELLS, STEP_CHARS, STRETCH = 500_000, 8_000_000, 4_000_000, 2048


class Automaton:
    """Aho-Corasick over distinct, non-empty patterns: `delta` is goto with failures followed, `own` the pattern that ends at a
    state, `link` the next shorter state on the failure path at which one ends."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.longest = patterns, max(map(len, patterns))
        letters = sorted(set().union(*patterns))
        self.classes = np.zeros(0x110000, np.int32)  # 0: a character of no pattern
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        of = {c: k for k, c in enumerate(letters, 1)}
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for k, p in enumerate(patterns):
            s = 0
            for c in p:
                if of[c] not in children[s]:
                    children[s][of[c]] = len(children)
                    children.append({})
                    own.append(-1)
                s = children[s][of[c]]
            own[s] = k
        width = len(letters) + 1
        delta, fail, link = np.zeros((len(children), width), np.int32), [0] * len(children), [-1] * len(children)
        queue = [0]
        for s in queue:  # grows while it is walked: breadth first
            if s:
                delta[s] = delta[fail[s]]
            for c, to in children[s].items():
                fail[to] = int(delta[s, c])
                link[to] = fail[to] if own[fail[to]] >= 0 else link[fail[to]]
                delta[s, c] = to
                queue.append(to)
        self.width, self.delta = width, delta.ravel()
        self.own, self.link = np.array(own, np.int32), np.array(link, np.int32)
        self.ends = (self.own >= 0) | (self.link >= 0)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, start) of every occurrence in a sequence of code points."""
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = self.longest - 1
        rows = -(-len(codes) // STRETCH)
        padded = np.zeros(lead + rows * STRETCH, np.int32)
        padded[lead : lead + len(codes)] = self.classes[codes]
        # Each stretch begins as far before its own part as a pattern can reach back.
        steps = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, lead + STRETCH)[::STRETCH].T)
        state, found = np.zeros(rows, np.int64), []
        for j, column in enumerate(steps):
            state = self.delta[state * self.width + column].astype(np.int64)
            if j >= lead:
                at = np.flatnonzero(self.ends[state])
                if len(at):
                    found.append((state[at], at * STRETCH + j - lead))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        states, last = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        while len(states):
            here = self.own[states]
            out.append((here[here >= 0], last[here >= 0]))
            states = self.link[states]
            states, last = states[states >= 0], last[states >= 0]
        which, last = (np.concatenate(x) for x in zip(*out, strict=True))
        return which, last + 1 - np.array([len(p) for p in self.patterns])[which]


def automata(patterns: list[str], cells: int = CELLS) -> list[Automaton]:
    """One automaton, or several with the patterns dealt by first character where one array would be too large."""
    if not patterns:
        return []
    size = sum(map(len, patterns)) * (len(set().union(*patterns)) + 1)
    if size <= cells or len({p[0] for p in patterns}) == 1:
        return [Automaton(patterns)]
    listed = sorted(patterns)
    middle = next((k for k in range(len(listed) // 2, len(listed)) if listed[k][0] != listed[k - 1][0]), None)
    middle = middle or next(k for k in range(len(listed) // 2, 0, -1) if listed[k][0] != listed[k - 1][0])
    return automata(listed[:middle], cells) + automata(listed[middle:], cells)


def fold(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


_CLOSED = np.zeros(0x110000, bool)
_CLOSED[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def free_hits(machines: list[Automaton], texts: list[str]) -> list[set[str]]:
    """For each text the patterns that occur in it with no ASCII letter or digit on either side."""
    out: list[set[str]] = [set() for _ in texts]
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    closed = np.concatenate([[False], _CLOSED[codes], [False]])
    for m in machines:
        which, at = m.hits(codes)
        ends = at + np.array([len(p) for p in m.patterns])[which] if len(which) else at
        free = ~closed[at] & ~closed[ends + 1]
        which, of = which[free], np.searchsorted(starts, at[free], "right") - 1
        inside = ends[free] < (starts + sizes)[of]  # a pattern with a null character could run on
        for t, k in set(zip(of[inside].tolist(), which[inside].tolist(), strict=True)):
            out[t].add(m.patterns[k])
    return out


def mentions(aliases: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, alias): texts (text_id, text) in which an alias (alias) occurs with no ASCII letter or digit beside it.

    Both sides are folded (NFKC, lower case); an alias is told as folded. Null and empty aliases and texts give nothing, repeated
    aliases count once, repeated text ids each give their rows.
    """
    asked = aliases.select("alias").where("alias IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.length("alias"))).head()[0] or 0
    shards = max(1, -(-size // SHARD_CHARS))
    kind = texts.schema["text_id"].dataType.simpleString()
    out = None
    for shard in range(shards):
        own = asked.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == shard) if shards > 1 else asked
        patterns = sorted({fold(r.alias) for r in own.collect()} - {""})  # a shard's characters at most, on average
        found = texts.select("text_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan(patterns), f"text_id {kind}, found array<string>")
        out = found if out is None else out.unionByName(found)
    return out.select("text_id", F.explode("found").alias("alias"))


def _scan(patterns: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(patterns)
        for batch in batches:
            folded, size, first = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                folded.append(fold(text.as_py() or ""))
                size += len(folded[-1]) + 1
                if size >= STEP_CHARS or k + 1 == batch.num_rows:
                    found = [sorted(x) for x in free_hits(machines, folded)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(folded)), pa.array(found, pa.list_(pa.string()))], names=["text_id", "found"])
                    folded, size, first = [], 0, k + 1

    return scan


def mention_edges(aliases: DataFrame, texts: DataFrame, share: float | None = None, floor: int = 0) -> DataFrame:
    """(text_id, id), distinct, for aliases (id, alias). With a share, aliases found in more texts than that part of all (and than
    `floor`) are too general and go whole; `general_aliases` tells which."""
    hits = staged(mentions(aliases, texts).distinct(), "mentions") if share is not None else mentions(aliases, texts)
    if share is not None:
        hits = hits.join(general_aliases(hits, texts, share, floor), "alias", "left_anti")
    fold_column = F.pandas_udf(lambda s: s.map(fold, na_action="ignore"), "string")
    named = aliases.select("id", fold_column("alias").alias("alias")).where("alias <> ''").distinct()
    return hits.join(named, "alias").select("text_id", "id").distinct()


def general_aliases(hits: DataFrame, texts: DataFrame, share: float, floor: int = 0) -> DataFrame:
    """(alias, texts) of aliases in more than share * (number of texts) texts, and in more than `floor`; hits are distinct."""
    most = max(float(floor), share * texts.count())
    return hits.groupBy("alias").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > most)


def mention_bridge(concepts: DataFrame, claims: DataFrame, share: float = 0.02, floor: int = 0, least_sources: int = 2, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Edges (text_id, id) from claims (text_id, text) to the concepts they name, and pairs (a < b, together) of concepts that
    claims name together. concepts (id, name, source_id): only those of `least_sources` or more sources take part, under the
    aliases of all their names."""
    several = concepts.groupBy("id").agg(F.countDistinct("source_id").alias("n")).where(F.col("n") >= least_sources).select("id")
    table = aliases_of(concepts.select("id", "name").distinct().join(several, "id", "left_semi"))
    edges = mention_edges(table, claims, share, floor)
    return edges, co_mentions(edges, most)
