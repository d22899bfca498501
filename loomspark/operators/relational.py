"""Joins, aggregates, windows and set operations with the semantics that notebook stores need.

Every function takes and returns DataFrames and leaves strategy to Catalyst. Windows that could gather a large group keep only
what a top-n needs; orderings always end in a unique column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import iou
from loomspark.session import staged


def latest(df: DataFrame, keys: list[str], *order: Column, keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= keep).drop("__rn")


def forward_fill(df: DataFrame, keys: list[str], order: list, col: str) -> DataFrame:
    """Blank cells take the last non-blank one above them; leading blanks stay null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(F.nullif(F.trim(F.col(col)), F.lit("")), True).over(w))


def net_changes(log: DataFrame, key: list[str], seq: str, before: str, after: str) -> DataFrame:
    """First `before` and last `after` of each key; keys that end as they began fall out."""
    first, last = F.min_by(before, seq), F.max_by(after, seq)
    return log.groupBy(*key).agg(first.alias(before), last.alias(after), F.count(F.lit(1)).alias("changes")).where(~F.col(before).eqNullSafe(F.col(after)))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The `size` rows that follow `after` in the ascending order of the columns."""
    if after is not None:
        tests, equal = [], F.lit(True)
        for c, v in zip(order, after, strict=True):
            tests.append(equal & (F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        df = df.where(reduce(lambda a, b: a | b, tests))
    return df.orderBy(*order).limit(size)


def evenly_spaced(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """n rows of each key, spread evenly over its order, the last one among them."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    places = F.when(F.col("__n") <= n, F.col("__i") >= 0).otherwise(F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("__n") - 1) / max(n - 1, 1)) == F.col("__i")))
    return numbered.where(places).drop("__i", "__n")


def round_robin(df: DataFrame, group: str, within: list, between: list, n: int | None = None) -> DataFrame:
    """First rows of all groups, then second rows, and so on."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*within))).orderBy("turn", *between)
    return ranked.limit(n) if n else ranked


def classified_join(logs: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """One row per correlation key of either side, with how the sides meet.

    joined (one and one), log_only, event_only, retry (several logs, one event), ambiguous (several events); rows without a
    key are unattributed.
    """
    left = logs.groupBy(key).agg(F.count(F.lit(1)).alias("logs"))
    right = events.groupBy(key).agg(F.count(F.lit(1)).alias("events"))
    sides = left.withColumn("events", F.lit(0).cast("long")).unionByName(right.withColumn("logs", F.lit(0).cast("long")))
    met = sides.groupBy(key).agg(F.sum("logs").alias("logs"), F.sum("events").alias("events"))
    kind = F.when(F.col(key).isNull(), "unattributed").when(F.col("events") == 0, "log_only").when(F.col("logs") == 0, "event_only").when(F.col("events") > 1, "ambiguous").when(F.col("logs") > 1, "retry").otherwise("joined")
    return met.withColumn("kind", kind)


def overlapping_spans(gold: DataFrame, pred: DataFrame, keys: list[str], width: int, least: float = 0.0) -> DataFrame:
    """Pairs of spans (id, a, b) on the same keys that overlap, with their intersection over union.

    Spans are listed under every bin of `width` they touch, so the range condition becomes an equality that shuffles well; of
    the bins two spans share only the first counts.
    """
    binned = lambda df, p: df.select(*keys, F.col("id").alias(f"{p}_id"), F.col("a").alias(f"{p}_a"), F.col("b").alias(f"{p}_b"), F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.greatest(F.col("b") - 1, F.col("a"))) / width))).alias("__bin"))
    g, p = binned(gold, "gold"), binned(pred, "pred")
    both = g.join(p, [*keys, "__bin"]).where((F.col("gold_a") < F.col("pred_b")) & (F.col("pred_a") < F.col("gold_b")))
    both = both.where(F.col("__bin") == F.floor(F.greatest("gold_a", "pred_a") / width))
    return both.withColumn("iou", F.round(iou(F.col("gold_a"), F.col("gold_b"), F.col("pred_a"), F.col("pred_b")), 6)).where(F.col("iou") > least).drop("__bin")


def greedy_matching(pairs: DataFrame, keys: list[str], score: str = "iou") -> DataFrame:
    """One-to-one matches (gold_id, pred_id, score) within each key: best first, ties by ids.

    What the sorted loop takes, found in rounds: a pair that is the best left for its gold and for its pred is taken, and all pairs
    that share a side with one go. No key has to fit a task; a round is two grouped minima, and most pairs go in the first few.
    Repeated pairs count once, at their best; null keys are keys, pairs without a score or a side are passed over.
    """
    names = pairs.columns
    rows = pairs.dropna(subset=["gold_id", "pred_id", score]).withColumn("__k", F.struct(*keys))
    left = staged(rows.withColumn("__o", F.struct((-F.col(score)).alias("s"), "gold_id", "pred_id")), "pairs")
    taken = None
    while True:
        by_gold = left.groupBy("__k", "gold_id").agg(F.min("__o").alias("__o"))
        by_pred = left.groupBy("__k", "pred_id").agg(F.min("__o").alias("__o"))
        best = staged(by_gold.join(by_pred.select("__k", "__o"), ["__k", "__o"]).select("__k", "__o"), "best")
        if best.isEmpty():
            break
        now = left.join(best, ["__k", "__o"], "left_semi").dropDuplicates(["__k", "__o"]).select(*names)
        taken = now if taken is None else taken.unionByName(now)
        gone = lambda side: best.select("__k", F.col(f"__o.{side}").alias(side))
        left = staged(left.join(gone("gold_id"), ["__k", "gold_id"], "left_anti").join(gone("pred_id"), ["__k", "pred_id"], "left_anti"), "pairs")
    return left.select(*names).limit(0) if taken is None else taken


def identity_map(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """left ids to right ids: exact names first, then names that are equal in lower case among the leftovers; empty names never match."""
    a = left.select(F.col("id").alias("left_id"), F.col(name).alias("n")).where("n <> ''")
    b = right.select(F.col("id").alias("right_id"), F.col(name).alias("n")).where("n <> ''")
    exact = a.join(b, "n").select("left_id", "right_id", F.lit("exact").alias("how"))
    a2, b2 = a.join(exact, "left_id", "left_anti"), b.join(exact, "right_id", "left_anti")
    loose = a2.withColumn("k", F.lower("n")).join(b2.withColumn("k", F.lower("n")).drop("n"), "k").select("left_id", "right_id", F.lit("folded").alias("how"))
    return exact.unionByName(loose)


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, or a failure of the job that reads it if a key occurs twice."""
    w = Window.partitionBy(*keys)
    message = F.concat(F.lit(f"{what}: repeated key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def nearest_rank(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """count, nearest-rank percentiles and maximum of a value by keys."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in points],
        F.max(value).alias("max"),
    )


def histogram_percentile(buckets: DataFrame, keys: list[str], bound: str, count: str, q: float) -> DataFrame:
    """The first bucket bound where the running count reaches total * q; counts beyond the finite bounds answer the largest of them."""
    w = Window.partitionBy(*keys).orderBy(F.col(bound).asc_nulls_last())
    running = buckets.withColumn("__run", F.sum(count).over(w)).withColumn("__all", F.sum(count).over(Window.partitionBy(*keys))).withColumn("__top", F.max(bound).over(Window.partitionBy(*keys)))
    return running.where(F.col("__run") >= F.col("__all") * q).groupBy(*keys).agg(F.coalesce(F.min(bound), F.max("__top")).alias("bound"))


def gated_summary(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """Observed and missing counts, and mean and median only where there are at least `least` values; unknown is not zero."""
    enough = F.count(value) >= least
    return df.groupBy(*keys).agg(
        F.count(value).alias("n_observed"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.when(enough, F.round(F.avg(value), 6)).alias("mean"),
        F.when(enough, F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")).alias("median"),
    )


def zero_filled(counts: DataFrame, dimension: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row of the dimension, zero where nothing was counted."""
    return dimension.join(counts, keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def pivoted(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Cells (key, column name, value) as wide rows."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value))


def transposed(grid: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """A grid of named columns with rows and columns exchanged."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    tall = grid.selectExpr(row, f"stack({len(columns)}, {pairs}) AS ({col}, {value})")
    return tall


def ordered_union(*arms: tuple[DataFrame, str], key: str) -> DataFrame:
    """Rows of all arms in their order (arm, then its position column); of equal keys the first stays."""
    every = reduce(DataFrame.unionByName, [df.withColumn("arm", F.lit(k)).withColumn("at", F.col(pos).cast("long")).drop(*([pos] if pos != "at" else [])) for k, (df, pos) in enumerate(arms)])
    return latest(every, [key], F.col("arm"), F.col("at"))


def unordered_pairs(df: DataFrame, a: str, b: str, *order: Column) -> DataFrame:
    """One row a pair, whichever end comes first; the first in the given order stays. Pairs of one end with itself go."""
    sides = df.where(F.col(a) != F.col(b)).withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    return latest(sides, ["lo", "hi"], *order)


#: Rows of a key that meet in one array at most, roughly; longer keys are cut into blocks. Hash buckets in which keys are counted.
BLOCK, BUCKETS = 1 << 14, 1 << 16


def pairs_within(rows: DataFrame, keys: list[str], ident: str, block: int = BLOCK) -> DataFrame:
    """(x, y): all pairs of rows with equal keys and ident ascending, each a struct of ident and the columns that are no keys.

    A row is shuffled once, in its key's array. Keys that may have more than `block` rows, by the count of the hash bucket they
    fall in, are cut into blocks by a hash of ident, and every two blocks meet in a cell of their own: no task holds more than
    two blocks. Null keys and idents have no pairs.
    """
    placed = rows.dropna(subset=[*keys, ident]).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    n = F.count(F.lit(1))
    large = placed.groupBy("__bucket").agg(F.ceil(n / block).cast("int").alias("__of")).where("__of > 1")
    cut = placed.join(F.broadcast(large), "__bucket", "left").withColumn("__of", F.coalesce("__of", F.lit(1)))
    at = F.pmod(F.xxhash64(F.lit("block"), ident), F.col("__of")).cast("int")
    row = F.struct(ident, *[c for c in rows.columns if c not in {*keys, ident}])
    blocks = cut.groupBy(*keys, "__of", at.alias("__at")).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    whole = blocks.where("__of = 1").select(F.col("__rows").alias("__x"), F.col("__rows").alias("__y"))
    others = F.explode(F.sequence(F.lit(0), F.col("__of") - 1))
    side = lambda mine, other, name: blocks.where("__of > 1").select(*keys, F.col("__at").alias(mine), others.alias(other), F.col("__rows").alias(name))
    cells = side("__i", "__j", "__x").join(side("__j", "__i", "__y"), [*keys, "__i", "__j"]).select("__x", "__y")
    met = whole.unionByName(cells).select(F.explode("__x").alias("x"), "__y").select("x", F.explode("__y").alias("y"))
    return met.where(F.col(f"x.{ident}") < F.col(f"y.{ident}"))


def upserted(base: DataFrame, changes: DataFrame, key: list[str], seq: str, deleted: Column | None = None) -> DataFrame:
    """base with the latest change of each key put in; keys whose latest change is a deletion go."""
    every = base.withColumn(seq, F.lit(-1).cast("long")).withColumn("__gone", F.lit(False)).unionByName(changes.withColumn("__gone", deleted if deleted is not None else F.lit(False)).withColumn(seq, F.col(seq).cast("long")))
    return latest(every, key, F.desc(seq)).where(~F.col("__gone")).drop("__gone", seq)


def missing(base: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    return base.join(have, key, "left_anti")


def running_budget(df: DataFrame, keys: list[str], order: list, text: str, each: int, total: int) -> DataFrame:
    """Texts cut to `each` characters, as many as fit into `total` in the given order; the one that overflows is cut to fit."""
    cut = df.withColumn(text, F.substring(text, 1, each))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = cut.withColumn("__used", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))
    return used.where(F.col("__used") < total).withColumn(text, F.substr(F.col(text), F.lit(1), (F.lit(total) - F.col("__used")).cast("int"))).drop("__used")


def change_feed(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """insert, update and delete rows between two states of a table."""
    digest = lambda df: df.select(*key, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(v).cast("string"), F.lit("\x00")) for v in values]), 256).alias("h"), *values)
    a, b = digest(before).alias("a"), digest(after).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key])
    op = F.when(F.col("a.h").isNull(), "insert").when(F.col("b.h").isNull(), "delete").when(F.col("a.h") != F.col("b.h"), "update")
    met = a.join(b, on, "full_outer").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key], op.alias("op"), *[F.col(f"b.{v}").alias(v) for v in values])
    return met.where(F.col("op").isNotNull())
