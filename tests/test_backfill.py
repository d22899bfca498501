"""The resumable backfill: pages, restarts, busy sources, lost writes."""

import shutil
import uuid

from pyspark.sql import functions as F

from loomspark.session import shared_dir
from loomspark.streaming import backfill as B


def test_backfill(spark):
    store, seen, busy = f"{shared_dir(spark)}/backfill/{uuid.uuid4().hex}", [], {4, 9}
    sources = spark.createDataFrame([(k,) for k in (1, 3, 4, 4, 7, 9, 12, 20)] + [(None,)], "id long")

    def judge(page):
        ids = sorted({r.id for r in page.collect()})
        seen.append(ids)
        return page.distinct().select("id", F.when(F.col("id").isin(*busy, -1), B.BUSY).otherwise(B.JUDGED).alias("outcome"), F.col("id").alias("flagged"), (F.col("id") % 2).alias("changed"))

    assert B.backfill(sources, store, judge, 3, dry_run=True) and B.judgements(spark, store).count() == 0
    assert seen == [[1, 3, 4], [7, 9, 12], [20]]
    seen.clear()
    assert not B.backfill(sources, store, judge, 3, most_pages=1)
    # A run that was lost between results and progress leaves its page to be judged again.
    B.backfill(sources, store, judge, 3, most_pages=1)
    shutil.rmtree(f"{store}/progress/of=1")
    assert {r.id for r in B.judgements(spark, store).collect()} == {1, 3, 4}
    busy.discard(9)
    assert B.backfill(sources, store, judge, 3)
    assert seen == [[1, 3, 4], [7, 9, 12], [7, 9, 12], [20], [4]]
    got = {r.id: r.outcome for r in B.judgements(spark, store).collect()}
    assert got == {k: B.BUSY if k == 4 else B.JUDGED for k in (1, 3, 4, 7, 9, 12, 20)}
    # A later run looks again at what was busy, and at what came meanwhile.
    busy.clear()
    seen.clear()
    assert B.backfill(sources.unionByName(spark.createDataFrame([(30,), (2,)], "id long")), store, judge, 3)
    assert seen == [[30], [4]]
    assert {(r.outcome, r.sources, r.flagged, r.sources_changed) for r in B.tally(spark, store).collect()} == {(B.JUDGED, 8, 86, 4)}
    assert B.backfill(sources.limit(0), f"{store}-none", judge, 3)
