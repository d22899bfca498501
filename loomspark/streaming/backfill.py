"""A judgement made for every source of a table, page by page, that can be stopped and taken up again at any place.

Pages are cut by key, not by offset, so sources that come or go meanwhile move nothing. A page's judgements are one partition of the
results and overwrite what a lost run left there; a page counts once its row in the progress table is written, after the results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROGRESS = "page int, last long, sources long"
#: What a judgement can be; only `judged` is final.
JUDGED, BUSY, FAILED = "judged", "busy", "failed"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def progress(spark: SparkSession, store: str) -> DataFrame:
    """page, last, sources: the pages that are done."""
    return spark.read.schema(_PROGRESS).json(f"{store}/progress/*") if _exists(spark, f"{store}/progress") else spark.createDataFrame([], _PROGRESS)


def judgements(spark: SparkSession, store: str) -> DataFrame:
    """id, outcome, flagged, changed: the last word on each source of a finished page. A second look has a page number below 0."""
    if not _exists(spark, f"{store}/results"):
        return spark.createDataFrame([], "id long, outcome string, flagged long, changed long")
    rows = spark.read.schema("id long, outcome string, flagged long, changed long, page int").parquet(f"{store}/results")
    done = rows.join(F.broadcast(progress(spark, store).select("page").unionByName(spark.createDataFrame([(-1,)], "page int"))), "page", "left_semi")  # a row a page
    return done.groupBy("id").agg(F.min_by(F.struct("outcome", "flagged", "changed"), F.when(F.col("page") < 0, 0).otherwise(1)).alias("r")).select("id", "r.*")


def backfill(sources: DataFrame, store: str, judge: Callable[[DataFrame], DataFrame], page_size: int, most_pages: int | None = None, dry_run: bool = False) -> bool:
    """Goes on where the last run stopped; True when all sources (id long, ...) have been seen.

    judge gives id, outcome, flagged, changed for a page of sources. With `most_pages` the run stops after so many. When the last
    page is done, sources that were busy get one more look, one page of them at most; what is busy then stays pending, and a later
    run looks again. A dry run judges the same pages and writes nothing.
    """
    spark = sources.sparkSession
    told = progress(spark, store).agg(F.max("last"), F.max("page")).head()
    last, page, run = told[0], -1 if told[1] is None else told[1], 0
    while most_pages is None or run < most_pages:
        ahead = sources.where("id IS NOT NULL") if last is None else sources.where(F.col("id") > last)
        some = ahead.orderBy("id").limit(page_size)
        upto, count = some.agg(F.max("id"), F.countDistinct("id")).head()
        if upto is None:
            break
        page, run = page + 1, run + 1
        # The page is cut by its ends, so that it is the same rows each time it is read.
        own = ahead.where(F.col("id") <= upto)
        judged = judge(own).select("id", "outcome", F.col("flagged").cast("long").alias("flagged"), F.col("changed").cast("long").alias("changed"))
        if dry_run:
            judged.write.format("noop").mode("overwrite").save()
        else:
            judged.write.mode("overwrite").parquet(f"{store}/results/page={page}")
            spark.createDataFrame([(page, upto, count)], _PROGRESS).coalesce(1).write.mode("overwrite").json(f"{store}/progress/of={page}")
        last = upto
    else:
        if not sources.where(F.col("id") > last if last is not None else F.col("id").isNotNull()).isEmpty():
            return False
    if not dry_run:
        waiting = judgements(spark, store).where(F.col("outcome") == BUSY).orderBy("id").limit(page_size).select("id")
        if not waiting.isEmpty():
            known = judgements(spark, store).where(F.col("outcome") != BUSY)
            again = judge(sources.join(waiting, "id", "left_semi")).select("id", "outcome", F.col("flagged").cast("long").alias("flagged"), F.col("changed").cast("long").alias("changed"))
            before = spark.read.parquet(f"{store}/results/page=-1").join(known, "id", "left_semi") if _exists(spark, f"{store}/results/page=-1") else again.limit(0)
            # Written beside the old look first: the old one is an input of the new.
            before.unionByName(again).write.mode("overwrite").parquet(f"{store}/second")
            spark.read.parquet(f"{store}/second").write.mode("overwrite").parquet(f"{store}/results/page=-1")
    return True


def tally(spark: SparkSession, store: str) -> DataFrame:
    """outcome, sources, flagged, changed, sources_changed."""
    changed = F.count_if(F.col("changed") > 0)
    return judgements(spark, store).groupBy("outcome").agg(F.count(F.lit(1)).alias("sources"), F.sum("flagged").alias("flagged"), F.sum("changed").alias("changed"), changed.alias("sources_changed"))
