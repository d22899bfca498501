"""Inverted-file vector index: centroids and residual codes fitted on a bounded sample, every row in a list, probes by list.

`fit` takes at most PER_LIST sampled rows for each list (the least by hash of their id) to the driver and fits centroids and, on
what they leave, product codes. `build` assigns every row in one pass and packs each task's rows by list into segments of bounded
size, so indexing shuffles nothing. `search` packs queries by the lists they probe in the same way; segments and query blocks meet
in a join on the list, whose large partitions Spark can split, and each meeting is one matrix product. The best by code are scored
again on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomspark.functions import vectors as V
from loomspark.session import staged

#: Sampled rows for each list, most lists, rows of a segment, queries of a block, codes a part of the vector has.
PER_LIST, MOST_LISTS, SEGMENT, BLOCK, CODES = 50, 1024, 4096, 256, 256


@dataclass
class Index:
    """Centroids (lists x dims) and, for each part of the dimensions, the residuals that its codes stand for."""

    centroids: np.ndarray
    parts: list[tuple[int, int]]
    books: list[np.ndarray]
    probes: int = 1

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n lists nearest to each row, nearest first; ties to the smaller list."""
        far = (self.centroids**2).sum(1)[None, :] - 2 * (x @ self.centroids.T)
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = x - self.centroids[lists]
        return np.stack([_nearest(left[:, a:b], book) for (a, b), book in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, which: int) -> np.ndarray:
        return self.centroids[which] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(1)
    for k in range(0, len(x), 8192):
        out[k : k + 8192] = np.argmin(half[None, :] - 2 * (x[k : k + 8192] @ centres.T), axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of k groups by Lloyd's rounds; an empty group moves to the row that lies farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=k)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        if not full.all():
            far = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")
            centres[~full] = x[far[: int((~full).sum())]]
    return centres


def unit_rows(vectors: list[list[float] | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one of `dims` finite numbers and are not zero, and which rows those are."""
    good = [k for k, v in enumerate(vectors) if v is not None and len(v) == dims and None not in v]
    x = np.array([vectors[k] for k in good], np.float64).reshape(len(good), dims)
    norm = np.sqrt((x**2).sum(1))
    fine = np.isfinite(norm) & (norm > 0)
    return (x[fine] / norm[fine, None]).astype(np.float32), np.array(good, np.int64)[fine]


def enough_probes(x: np.ndarray, centroids: np.ndarray, k: int, target: float, asked: int = 256) -> int:
    """How many lists hold, on average over `asked` of the sampled rows x, that part of their k nearest sampled rows."""
    own, some = _nearest(x, centroids), x[:asked]
    scores = some @ x.T
    scores[np.arange(len(some)), np.arange(len(some))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    far = (centroids**2).sum(1)[None, :] - 2 * (some @ centroids.T)
    place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
    held = np.cumsum(np.bincount(np.take_along_axis(place, own[best], 1).ravel(), minlength=len(centroids))) / best.size
    return int(np.searchsorted(held, min(target, held[-1])) + 1)


def fit(rows: DataFrame, lists: int | None = None, parts: int = 16, per_list: int = PER_LIST, k: int = 10, target: float = 0.95) -> Index:
    """The index of rows (id, vector); without `lists`, half the square root of the rows, MOST_LISTS at most. Rows of another
    width than the sample's most common one are never found. `probes` is what the sample needs to hold `target` of its k nearest."""
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5 / 2), MOST_LISTS, n))
    sample = rows.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(lists * per_list).select("vector").toPandas()["vector"]
    widths = sample.map(len)
    dims = int(widths.mode().iloc[0]) if len(widths) else 1
    x, _ = unit_rows([list(v) for v in sample], dims)
    if not len(x):
        return Index(np.zeros((1, dims), np.float32), [(0, dims)], [np.zeros((1, dims), np.float32)])
    lists = min(lists, len(x))
    centroids = k_means(x, lists)
    left = x - centroids[_nearest(x, centroids)]
    edges = np.linspace(0, dims, min(parts, dims) + 1).astype(int).tolist()
    spans = list(zip(edges, edges[1:], strict=False))
    books = [k_means(np.ascontiguousarray(left[:, a:b]), min(CODES, len(left))) for a, b in spans]
    return Index(centroids, spans, books, enough_probes(x, centroids, k, target))


def build(rows: DataFrame, index: Index) -> DataFrame:
    """(list, ids, codes): every row of rows (id long, vector) in the segment of a list; rows without a vector are in none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                some = batch.slice(first, 2048)
                x, at = unit_rows(some.column(1).to_pylist(), index.centroids.shape[1])
                ids = some.column(0).to_numpy(zero_copy_only=False)[at]
                lists = index.nearest(x)[:, 0] if len(x) else np.zeros(0, int)
                codes = index.encode(x, lists) if len(x) else None
                for k in np.unique(lists).tolist():
                    own = held.setdefault(k, ([], []))
                    own[0].extend(ids[lists == k].tolist())
                    own[1].append(codes[lists == k])
                    if len(own[0]) >= SEGMENT:
                        yield _segment(k, *held.pop(k))
        for k in list(held):
            yield _segment(k, *held.pop(k))

    return rows.where("id IS NOT NULL").select(F.col("id").cast("long"), "vector").mapInArrow(pack, "list int, ids array<long>, codes binary")


def _segment(k: int, ids: list, codes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(codes).tobytes()], pa.binary())], names=["list", "ids", "codes"])


def _routed(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                some = batch.slice(first, BLOCK)
                x, at = unit_rows(some.column(1).to_pylist(), index.centroids.shape[1])
                if not len(x):
                    continue
                ids, near = some.column(0).to_numpy(zero_copy_only=False)[at], index.nearest(x, probes)
                rows = [(k, ids[hit].tolist(), x[hit].tobytes()) for k in np.unique(near).tolist() for hit in [(near == k).any(1)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["list", "queries", "vectors"])

    return queries.where("id IS NOT NULL").select(F.col("id").cast("long"), "vector").mapInArrow(route, "list int, queries array<long>, vectors binary")


def search(segments: DataFrame, index: Index, rows: DataFrame, queries: DataFrame, k: int, probes: int | None = None, wider: int = 10, least: float = -1.0) -> DataFrame:
    """(id, other, score): for each of queries (id, vector) the k nearest other rows of the index by cosine, `least` or more, as far
    as they lie in the `probes` (or the index's own number of) nearest lists and among the wider * k best by code. rows (id, vector) is what was indexed."""
    dims, most = index.centroids.shape[1], wider * k

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, ids, codes, asked, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, asked = np.array(ids, np.int64), np.array(asked, np.int64)
                x = index.decode(np.frombuffer(codes, np.uint8).reshape(len(ids), -1), which)
                scores = np.frombuffer(vectors, np.float32).reshape(len(asked), dims) @ x.T
                scores[asked[:, None] == ids[None, :]] = -np.inf
                n = min(most, len(ids))
                best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                q, other, s = np.repeat(asked, n), ids[best].ravel(), np.take_along_axis(scores, best, 1).ravel()
                fine = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(q[fine]), pa.array(other[fine]), pa.array(s[fine].astype(np.float64))], names=["id", "other", "code_score"])

    met = segments.join(_routed(queries, index, probes or index.probes), "list").select("list", "ids", "codes", "queries", "vectors").mapInArrow(meet, "id long, other long, code_score double")
    place = lambda score: F.row_number().over(Window.partitionBy("id").orderBy(F.desc(score), "other"))
    few = met.withColumn("__place", place("code_score")).where(F.col("__place") <= most).select("id", "other")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.array(c.tolist(), np.float64).reshape(len(c), dims) for c in (a, b))
        return pd.Series(np.round((x * y).sum(1) / np.sqrt((x**2).sum(1) * (y**2).sum(1)), 9))

    theirs = rows.select(F.col("id").cast("long").alias("other"), F.col("vector").alias("__y"))
    ours = queries.select(F.col("id").cast("long").alias("id"), F.col("vector").alias("__x"))
    scored = few.join(theirs, "other").join(ours, "id").select("id", "other", cosine("__x", "__y").alias("score")).where(F.col("score") >= least)
    return scored.withColumn("__place", place("score")).where(F.col("__place") <= k).select("id", "other", "score")


def exact_neighbours(rows: DataFrame, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(id, other, score): the k nearest other rows (id, vector) of each of queries (id, vector), all rows looked at. Queries go to
    the rows in blocks of bounded size; each batch of rows hands on its k best for each query of the block."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    for part in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).select("id", "vector").toPandas()
        widths = asked["vector"].dropna().map(len)
        dims = int(widths.mode().iloc[0]) if len(widths) else 1
        x, at = unit_rows([None if v is None else list(v) for v in asked["vector"]], dims)
        near = rows.where("id IS NOT NULL").select(F.col("id").cast("long"), "vector").mapInArrow(_near(x, asked["id"].to_numpy()[at], k), "id long, other long, score double")
        out = near if out is None else out.unionByName(near)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return out.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def _near(x: np.ndarray, asked: np.ndarray, k: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                some = batch.slice(first, 2048)
                y, at = unit_rows(some.column(1).to_pylist(), x.shape[1])
                if not len(y) or not len(x):
                    continue
                ids = some.column(0).to_numpy(zero_copy_only=False)[at]
                scores = np.round(x.astype(np.float64) @ y.T.astype(np.float64), 9)
                scores[asked[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, : min(k, len(ids))]
                s = np.take_along_axis(scores, order, 1).ravel()
                fine = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, order.shape[1])[fine].astype(np.int64)), pa.array(ids[order].ravel()[fine].astype(np.int64)), pa.array(s[fine])], names=["id", "other", "score"])

    return near


#: Vectors of a packed segment and of a packed block of queries, and queries that meet a segment at once.
PACKED, ASKED, STEP = 8192, 1024, 128


def nearest(rows: DataFrame, queries: DataFrame, k: int, packed: int = PACKED, asked: int = ASKED) -> DataFrame:
    """(query_id, id, score): at least the k first rows (id long, vector) of each of queries (query_id long, vector) by cosine to
    six places, ties by id; all pairs are looked at.

    Vectors are packed, segments and blocks of queries meet in a Cartesian product, each meeting is a matrix product that hands on
    the k first of a query; scores are those of `V.cosine`, to the bit. Vectors of another width have null. What has no id, no
    vector or numbers that are not finite meets the others one by one.
    """
    small = rows.schema["vector"].dataType.elementType == FloatType()
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 1e100) & ((x == 0) | (F.abs(x.cast("double")) > 1e-100))
    plain = lambda ident: F.col(ident).isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False))
    rows, queries = rows.select(F.col("id").cast("long"), "vector"), queries.select(F.col("query_id").cast("long"), F.col("vector"))
    spark = rows.sparkSession
    pack = lambda df, ident, most: df.where(plain(ident)).select(ident, "vector").mapInArrow(_packed(most, "<f4" if small else "<f8"), "ids array<long>, dims int, vectors binary")
    segments = pack(rows, "id", packed).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = staged(pack(queries, "query_id", asked), "asked").toDF("query_ids", "query_dims", "query_vectors")
    met = segments.crossJoin(blocks).mapInArrow(_first(k, "<f4" if small else "<f8"), "query_id long, id long, score double")
    # Few rows are odd: they are written, so that a product reads them again and not all rows.
    odd_rows, odd_queries = staged(rows.where(~plain("id")), "odd"), staged(queries.where(~plain("query_id")), "odd")
    as_q = lambda df: df.withColumnRenamed("vector", "q")
    odd = odd_rows.crossJoin(as_q(queries)).unionByName(rows.where(plain("id")).crossJoin(as_q(odd_queries)))
    return met.unionByName(odd.select("query_id", "id", V.cosine(F.col("vector"), F.col("q")).alias("score"))).withColumn("score", F.round("score", 6))


def _packed(most: int, kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        segment = lambda ids, d, x: pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([d], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["ids", "dims", "vectors"])
        for batch in batches:
            ids, widths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            values, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(widths)
            for d in np.unique(widths).tolist():
                at = np.flatnonzero(widths == d)
                x = values[(ends[at] - d)[:, None] + np.arange(d)]
                if d in held:
                    ids_, x = np.concatenate([held[d][0], ids[at]]), np.concatenate([held[d][1], x])
                else:
                    ids_ = ids[at]
                full = len(ids_) // most * most
                for a in range(0, full, most):
                    yield segment(ids_[a : a + most], d, x[a : a + most])
                held[d] = [ids_[full:], x[full:]]
        for d, (ids, x) in held.items():
            if len(ids):
                yield segment(ids, d, x)

    return pack


def _dots(x: np.ndarray, i: np.ndarray | slice, y: np.ndarray, q: np.ndarray | slice) -> np.ndarray:
    """Of the rows i of x with the rows q of y, summed from first to last as `V.dot` does."""
    out = np.zeros(len(x[i, :1]))
    for k in range(x.shape[1]):
        out += x[i, k] * y[q, k]
    return out


def _first(k: int, kind: str):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lambda q, i, s: pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), s], names=["query_id", "id", "score"])
        for batch in batches:
            for row in range(batch.num_rows):
                ids, asked = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (0, 3))
                d, e = batch.column(1)[row].as_py(), batch.column(4)[row].as_py()
                if d != e:
                    few = np.sort(ids)[:k]
                    yield found(np.repeat(asked, len(few)), np.tile(few, len(asked)), pa.nulls(len(few) * len(asked), pa.float64()))
                    continue
                x, y = (np.frombuffer(batch.column(c)[row].as_py(), kind).astype(np.float64).reshape(n, d) for c, n in ((2, len(ids)), (5, len(asked))))
                every = slice(None)
                nx, ny = np.sqrt(_dots(x, every, x, every)), np.sqrt(_dots(y, every, y, every))
                ux = x / np.where(nx > 0, nx, 1.0)[:, None]
                for a in range(0, len(asked), STEP):
                    near = (y[a : a + STEP] / np.where(ny > 0, ny, 1.0)[a : a + STEP, None]) @ ux.T
                    if len(ids) > k:  # what may be among the first k to six places
                        least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
                        q, i = np.nonzero(near >= least[:, None] - 1.1e-6)
                    else:
                        q, i = np.divmod(np.arange(near.size), len(ids))
                    yield found(*_kept(q + a, i, ids, asked, x, y, nx, ny, k))

    return meet


def _kept(q: np.ndarray, i: np.ndarray, ids: np.ndarray, asked: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, k: int) -> tuple:
    """Of pairs of queries and rows those among a query's first k to six places; where that hangs on how a half is rounded, all."""
    n = nx[i] * ny[q]
    s = np.where(n > 0, _dots(x, i, y, q) / np.where(n > 0, n, 1.0), 0.0)
    place = np.floor(s * 1e6 + 0.5)
    sure = np.abs(s * 1e6 + 0.5 - np.rint(s * 1e6 + 0.5)) > 1e-4
    order = np.lexsort((ids[i], -place, q))
    q, i, s, sure = q[order], i[order], s[order], sure[order]
    before = np.cumsum(sure) - sure
    start = np.searchsorted(q, q)
    fine = ~sure | (before - before[start] < k)
    return asked[q[fine]], ids[i[fine]], pa.array(s[fine])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and which part of the exact neighbours was found, each query counting the same."""
    met = exact.select("id", "other").join(found.select("id", "other", F.lit(1).alias("__hit")), ["id", "other"], "left")
    return met.groupBy("id").agg((F.count("__hit") / F.count(F.lit(1))).alias("part")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("part"), 6).alias("recall"))


def synonym_edges(rows: DataFrame, k: int, least: float, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """Unordered pairs (a, b, score) where one is among the other's k nearest by the index, at cosine `least` or more."""
    index = fit(rows, lists)
    near = search(build(rows, index), index, rows, rows, k, probes, least=least)
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.round("score", 6).alias("score")).distinct()
