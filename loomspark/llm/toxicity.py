"""Toxicity by classifier chains.

Categories are predicted one after the other; each linear model sees the text's features and the probabilities of the
categories before it. While training, those probabilities are out-of-fold predictions, so that later models learn from the
kind of mistakes they will meet.

Features are words and word beginnings (4 to 7 characters), hashed to SLOTS, each once for being there and once more for being
there twice. Document frequencies by class choose, for each category, the FEATURES that tell its classes apart best; the models
that make out-of-fold probabilities choose theirs without the fold that they are to predict. The models are fitted on at most
MAX_ROWS labelled rows, those with the least hash of their id, each category on the rows whose label for it is known; every
document is scored.

Edge cases: null and empty texts have no features and get the models' base probability; without labels, or with one class
only, a category gets the smoothed share of that class; a null label leaves a row out of that category only; ties in the hash
order go to the lower id; repeated rows get equal results; an empty table gives an empty result; other columns are ignored;
texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, staged

SLOTS, FEATURES, MAX_ROWS, FOLDS = 1 << 18, 512, 20_000, 3
_WORD = re.compile(r"\w+")


class _Grams(dict):
    """Feature slots of a word."""

    def __missing__(self, word: str) -> np.ndarray:
        grams = {f"={word}", *(f"^{word[:k]}" for k in range(4, 8) if len(word) >= k)}
        slots = np.array(sorted({xxhash.xxh3_64_intdigest(g) % SLOTS for g in grams}), np.int64)
        if len(self) < 100_000:
            self[word] = slots
        return slots


_grams = _Grams()


def features(text: str | None) -> np.ndarray:
    """Slots of a text: s for a gram that occurs, SLOTS + s for one that occurs again."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    slots, counts = np.unique(np.concatenate([_grams[w] for w in words]), return_counts=True)
    return np.concatenate([slots, slots[counts > 1] + SLOTS])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 150) -> np.ndarray:
    """Weights, the last one the constant; accelerated gradient steps on the penalised log loss."""
    n, d = x.shape
    prior = (y.sum() + 1) / (n + 2)
    w = np.zeros(d + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    if not 0 < y.sum() < n:
        return w
    step = np.float32(1.0 / (0.25 * (float((x * x).sum(1).mean()) + 1) + penalty))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        miss = (1 / (1 + np.exp(-(x @ v[:-1] + v[-1]))) - y).astype(np.float32)
        grad = np.append(x.T @ miss / n + penalty / n * v[:-1], miss.mean()).astype(np.float32)
        fresh = v - step * 4 * grad
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = (fresh + np.float32((t - 1) / after) * (fresh - w)).astype(np.float32)
        w, t = fresh, after
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, columns: list[list[np.ndarray]] | None = None) -> list[np.ndarray]:
    """One weight vector a category, in the order of the columns of labels, where NaN is not known.

    columns gives, for each category, the columns of x that its model sees, and after them those that its models without fold
    0, 1, ... see; without it all models see all columns.
    """
    every = np.arange(x.shape[1])
    before = np.zeros((len(x), 0), np.float32)
    weights = []
    for k in range(labels.shape[1]):
        use = columns[k] if columns else [every] * (FOLDS + 1)
        known, y = ~np.isnan(labels[:, k]), labels[:, k].astype(np.float32)
        sees = lambda cols: np.hstack([x[:, cols].astype(np.float32), before])
        weights.append(_logistic(sees(use[0])[known], y[known]))
        unseen = np.zeros((len(x), 1), np.float32)
        for f in range(FOLDS):
            out, fit = fold == f, (fold != f) & known
            if out.any():
                w, cols = (None, use[f + 1]) if fit.any() else (weights[-1], use[0])
                z = sees(cols)
                unseen[out, 0] = _probability(z[out], _logistic(z[fit], y[fit]) if w is None else w)
        before = np.hstack([before, unseen])
    return weights


def chain_probabilities(x: np.ndarray, weights: list[np.ndarray], columns: list[np.ndarray] | None = None) -> np.ndarray:
    before = np.zeros((len(x), 0), np.float32)
    for k, w in enumerate(weights):
        seen = x[:, columns[k]] if columns else x
        before = np.hstack([before, _probability(np.hstack([seen, before]), w).astype(np.float32)[:, None]])
    return before


def _dense(found: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(found), len(chosen)), np.float32)
    for r, slots in enumerate(found):
        at = np.searchsorted(chosen, slots)
        at = at[chosen[np.minimum(at, len(chosen) - 1)] == slots] if len(chosen) else at[:0]
        x[r, at] = 1
    return x


def _choose(counts: DataFrame, totals: list[tuple[int, int]], k: int, without: int | None) -> np.ndarray:
    """The FEATURES slots that tell category k's classes apart best in all folds, or in all but one; the driver gets no more."""
    folds = [f for f in range(FOLDS) if f != without]
    yes, no = (sum((F.col(f"{c}_{k}_{f}") for f in folds), F.lit(0)) for c in ("yes", "no"))
    all_yes, all_no = (sum(totals[k * FOLDS + f][c] for f in folds) for c in (0, 1))
    ratio = F.log((F.col("yes") + 0.1) / (all_yes + 1.0)) - F.log((F.col("no") + 0.1) / (all_no + 1.0))
    seen = counts.select("slot", yes.alias("yes"), no.alias("no")).where("yes + no >= 5").withColumn("ratio", ratio)
    weight = F.abs("ratio") * F.sqrt(F.when(F.col("ratio") > 0, F.col("yes")).otherwise(F.col("no") * 0.01))
    best = seen.select("slot", weight.alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "slot").limit(FEATURES).collect()
    return np.array(sorted(r["slot"] for r in best), np.int64)


def score_documents(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and p_<category> of every row of docs; labels has doc_id and a 0/1 column for each category, in chain order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col("doc_id").isNotNull() & F.coalesce(*categories).isNotNull())
    sample = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(*[F.col(c).cast("int") for c in categories]).alias("labels"))
    sample = sample.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows).drop("h")
    # At most max_rows ids are broadcast, so that no text moves.
    train = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "labels")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), slots, batch.column("labels")], names=["doc_id", "slots", "labels"])

    found = staged(train.mapInArrow(grams, "doc_id long, slots array<int>, labels array<int>"), "grams")
    fold = F.pmod("doc_id", F.lit(FOLDS))
    is_ = lambda k, f, c: F.coalesce(F.sum(F.when((fold == f) & ((F.col("labels")[k] > 0) == (c == "yes")), 1)), F.lit(0)).alias(f"{c}_{k}_{f}")
    sums = [is_(k, f, c) for k in range(len(categories)) for f in range(FOLDS) for c in ("yes", "no")]
    whole = found.agg(*sums).first()
    totals = [(whole[i], whole[i + 1]) for i in range(0, len(whole), 2)]
    counts = staged(found.select("doc_id", "labels", F.explode("slots").alias("slot")).groupBy("slot").agg(*sums), "frequencies")
    picked = [[_choose(counts, totals, k, f) for f in (None, *range(FOLDS))] for k in range(len(categories))]
    union = np.unique(np.concatenate([p for ps in picked for p in ps]))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense([np.array(s, np.int64) for s in batch.column("slots").to_pylist()], union)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.packbits(r.astype(bool)).tobytes() for r in x], pa.binary()), batch.column("labels")], names=["doc_id", "x", "labels"])

    # At most max_rows rows of FEATURES bits for each model.
    order = lambda r: (r["doc_id"], r["x"], [-1 if y is None else y for y in r["labels"]])
    fitted = sorted(found.mapInArrow(matrix, "doc_id long, x binary, labels array<int>").collect(), key=order)
    x = np.array([np.unpackbits(np.frombuffer(r["x"], np.uint8), count=len(union)) for r in fitted], np.uint8).reshape(len(fitted), len(union))
    y = np.array([[np.nan if v is None else v for v in r["labels"]] for r in fitted], np.float32).reshape(len(fitted), len(categories))
    weights = fit_chain(x, y, np.array([r["doc_id"] % FOLDS for r in fitted]), [[np.searchsorted(union, p) for p in ps] for ps in picked])
    discard(found, counts)
    chosen = np.unique(np.concatenate([ps[0] for ps in picked]))
    columns = [np.searchsorted(chosen, ps[0]) for ps in picked]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                p = chain_probabilities(_dense([features(t) for t in some.column(1).to_pylist()], chosen), weights, columns)
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(p[:, k].astype(np.float64)) for k in range(len(categories))]], names=["doc_id", *(f"p_{c}" for c in categories)])

    return rows.mapInArrow(score, "doc_id long, " + ", ".join(f"p_{c} double" for c in categories)).withColumnRenamed("doc_id", id_col)
