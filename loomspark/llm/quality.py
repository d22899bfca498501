"""Quality scores: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

A Gaussian kernel over some twenty statistics of a text is approximated by FEATURES random cosines. Ridge regression in that
space needs only the sums of z z' and z y, which partitions add up on their own and an aggregate adds up further; a task sends
a matrix of fixed size, whatever its rows. Sums are kept per fold, so every training row is scored by weights that have not
seen it, and an isotonic curve over those out-of-fold scores turns raw scores into probabilities.

All labelled training rows are used. Labels, language, source and ids are never inputs of a score.

Edge cases: null and empty texts have all-zero statistics and get a score as any text does; without any training label every
score is 0.5, with one class only it is that class's share smoothed by one count on either side; null labels are skipped;
several labels of one document each count; ties in raw scores get equal scores; an empty table gives an empty result; columns
other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import staged

FEATURES, FOLDS, RIDGE, WIDTH, BINS = 256, 5, 1.0, 1.0, 2000
STATISTICS = 22
_STOP = re.compile(r"[.!?]")


def statistics(text: str | None) -> list[float]:
    """Language-free statistics of a whole text."""
    words = (text or "").split()
    if not words:
        return [0.0] * STATISTICS
    n, chars = len(words), len(text)
    counts = Counter(words)
    most = counts.most_common(3)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    total = len(raw)
    share = kinds[kinds > 0] / total
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_lines = len(set(lines))
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)
    stops = kinds[[46, 33, 63]].sum()
    return [
        np.log1p(chars),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        len(counts) / n,
        len(counts) / np.sqrt(2 * n),
        most[0][1] / n,
        sum(c for _, c in most) / n,
        same / n,
        pairs,
        kinds[48:58].sum() / total,
        kinds[65:91].sum() / total,
        (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / total,
        kinds[124] / n,
        kinds[44] / n,
        stops / n,
        np.log1p(n / (stops + 1)),
        kinds[32] / total,
        len(lines) / n,
        distinct_lines / max(len(lines), 1),
        -(share * np.log2(share)).sum(),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(len(lines), 1),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float32()))], names=["doc_id", "stats"])


@dataclass
class Model:
    """Everything a score needs; a few hundred numbers by FEATURES."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # knots of the calibration
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        directions = rng.normal(0, WIDTH / np.sqrt(STATISTICS), (STATISTICS, FEATURES))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + shift), np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weights, self.raw, self.level)


def _sum_rows(df: DataFrame, groups: int = 8) -> np.ndarray:
    """Sum of the packed doubles in column `sums`, one row a partition, in two levels; the driver gets `groups` rows at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column("sums").to_pylist():
                x = np.frombuffer(b, np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = df.repartition(groups).mapInArrow(add, "sums binary").collect()
    return sum(np.frombuffer(r["sums"], np.float64) for r in parts) if parts else np.zeros(0)


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over sorted raw scores: centres and levels of the blocks, the levels never falling."""
    blocks: list[list[float]] = []
    for r, y, w in zip(raw, label, weight, strict=True):
        blocks.append([y, w, r * w])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], (b[:, 0] + 0.5) / (b[:, 1] + 1.0)


def fit(rows: DataFrame) -> Model:
    """Fits on rows (doc_id, stats, label 0/1); sums are made where the rows are."""
    d = FEATURES + 1
    blank = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(d), np.array([0.0]), np.array([0.5]))

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stats = batch.column("stats").values.to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)
        return stats, batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64), batch.column("fold").to_numpy(zero_copy_only=False)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * STATISTICS)
        for batch in batches:
            stats, y, _ = arrays(batch)
            total += np.concatenate([[len(y), y.sum()], stats.sum(0), (stats * stats).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = _sum_rows(rows.mapInArrow(moments, "sums binary"))
    if not len(sums) or not sums[0]:
        return blank
    n, ones = sums[:2]
    mean = sums[2 : 2 + STATISTICS] / n
    scale = np.sqrt(np.maximum(sums[2 + STATISTICS :] / n - mean**2, 0)) + 1e-9
    model = Model(mean, scale, np.zeros(d), np.array([0.0]), np.array([(ones + 1) / (n + 2)]))
    if ones in (0, n):
        return model

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            stats, y, fold = arrays(batch)
            z = model.features(stats)
            for k in range(FOLDS):
                own = fold == k
                total[k] += z[own].T @ np.hstack([z[own], y[own, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    by_fold = _sum_rows(rows.mapInArrow(equations, "sums binary")).reshape(FOLDS, d, d + 1)
    ridge = RIDGE * np.eye(d)
    ridge[-1, -1] = 1e-6
    solve = lambda s: np.linalg.solve(s[:, :-1] + ridge, s[:, -1])
    whole = by_fold.sum(0)
    unseen = np.array([solve(whole - by_fold[k]) for k in range(FOLDS)])
    model.weights = solve(whole)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, labels and raw scores by bin of the out-of-fold score."""
        total = np.zeros((3, BINS))
        for batch in batches:
            stats, y, fold = arrays(batch)
            raw = (model.features(stats) * unseen[fold.astype(np.int64)]).sum(1)
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            for k, w in enumerate((None, y, raw)):
                total[k] += np.bincount(at, w, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = _sum_rows(rows.mapInArrow(binned, "sums binary")).reshape(3, BINS)
    some = total[0] > 0
    model.raw, model.level = isotonic(total[2][some] / total[0][some], total[1][some], total[0][some])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of docs; the model learns from the rows of labels (doc_id, label) that `use` selects."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = staged(rows.mapInArrow(_statistics, "doc_id long, stats array<float>"), "statistics")
    known = labels.where(use & F.col("label").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    train = stats.join(known, "doc_id").select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    model = fit(staged(train, "training"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").values.to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x) if len(x) else [], pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double").withColumnRenamed("doc_id", id_col)


def fitted(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model alone; the texts of labelled rows become statistics where they are read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(use & F.col("label").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    train = rows.mapInArrow(_statistics, "doc_id long, stats array<float>").join(known, "doc_id")
    return fit(staged(train.select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "training"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model scores at threshold or above, all columns as they were; no row leaves its partition."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], np.float32).reshape(-1, STATISTICS).astype(np.float64)
            if len(x):
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are kept for measuring."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
