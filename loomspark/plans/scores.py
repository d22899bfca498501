"""Stage scores and payload leaves over the driver's tables: views are gold, clicks are predicted, 200 events are a document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import payload, promotion, scoring
from loomspark.plans.registry import query
from loomspark.plans.relations import _LOOP, _PAIRS
from loomspark.session import shared_dir, table
from loomspark.streaming import backfill

_ATOMS = """WITH RECURSIVE e AS (SELECT *, event_id // 200 AS k, 'k' || (event_id % 3) AS kind, event_id * 10 AS a FROM events),
    g AS (SELECT k, event_id AS id, kind, a, a + 400 + CAST(floor(value) AS BIGINT) AS b FROM e WHERE event_type = 'view'), p AS (SELECT k, event_id AS id, kind, a, a + 600 AS b FROM e WHERE event_type = 'click')"""


def _atoms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, a = table(spark, d, "events"), F.col("event_id") * 10
    kind = F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))
    own = [F.floor(F.col("event_id") / 200).alias("doc"), F.col("event_id").alias("id"), kind.alias("kind"), a.alias("a")]
    return e.where("event_type = 'view'").select(*own, (a + 400 + F.floor("value")).alias("b")), e.where("event_type = 'click'").select(*own, (a + 600).alias("b"))


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One object an atom, with the scalars of its event's payload."""
    values = payload.payload_values(table(spark, d, "events"), ["event_id"], "props").withColumnRenamed("event_id", "id")
    return tuple(side.select("doc", "id", "kind", F.array("id").alias("atoms")).join(values, "id") for side in _atoms(spark, d))


@query("v04_atoms", _ATOMS + f""", {_PAIRS[:-1]} AND round((least(g.b, p.b) - greatest(g.a, p.a)) * 1.0 / ((g.b - g.a) + (p.b - p.a) - (least(g.b, p.b) - greatest(g.a, p.a))), 6) >= 0.5), {_LOOP},
    s AS (SELECT m.k, count(*) AS n, count(CASE WHEN g.kind = p.kind THEN 1 END) AS tp, round(avg(iou), 4) AS mean_iou FROM m JOIN g ON g.id = gold_id JOIN p ON p.id = pred_id GROUP BY 1),
    c AS (SELECT k, count(CASE WHEN event_type = 'view' THEN 1 END) AS ng, count(CASE WHEN event_type = 'click' THEN 1 END) AS np FROM e WHERE event_type IN ('view', 'click') GROUP BY 1),
    f AS (SELECT c.k AS doc, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, ng - coalesce(tp, 0) AS fn, coalesce(n, 0) AS n, coalesce(mean_iou, 1.0) AS mean_iou FROM c LEFT JOIN s ON s.k = c.k)
    SELECT doc, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
           round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(CASE WHEN n = 0 THEN 1.0 ELSE tp / n END, 6) AS type_accuracy, mean_iou FROM f""")
def v04_atoms(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _atoms(spark, d)
    return scoring.score_atoms(gold, pred, scoring.match_atoms(gold, pred, 1000))


@query("v04_chunks")
def v04_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are runs of events: 20 of gold, 25 of what is predicted."""
    gold, pred = _atoms(spark, d)
    listed = lambda side, n: side.groupBy("doc", F.floor(F.col("id") / n).alias("id")).agg(F.min("kind").alias("kind"), F.collect_list("id").alias("atoms"))
    g, p = listed(gold, 20), listed(pred, 25)
    return scoring.score_chunks(g, p, scoring.match_chunks(g, p, scoring.match_atoms(gold, pred, 1000)))


@query("v04_objects")
def v04_objects(spark: SparkSession, d: str) -> DataFrame:
    g, p = _objects(spark, d)
    return scoring.score_objects(g, p, scoring.match_objects(g, p, scoring.match_atoms(*_atoms(spark, d), 1000)))


@query("v04_relations")
def v04_relations(spark: SparkSession, d: str) -> DataFrame:
    """Each object leads to the next of its side."""
    g, p = _objects(spark, d)
    aligned = scoring.match_objects(g, p, scoring.match_atoms(*_atoms(spark, d), 1000))
    chain = lambda o: o.select("doc", "id", F.col("id").alias("source"), F.lead("id").over(Window.partitionBy("doc").orderBy("id")).alias("target"), F.when(F.col("id") % 7 < 5, "next").otherwise("then").alias("kind")).where("target IS NOT NULL")
    return scoring.score_relations(chain(g), chain(p), aligned)


_SIDES = """WITH o AS (SELECT o_orderkey // 500 AS doc, lower(o_orderpriority || ' ' || o_custkey % 9) AS path, o_custkey % 20 AS atom, lower(o_orderstatus) AS text, o_orderkey % 2 = 0 AS gold FROM orders)"""
_F1 = "SELECT doc, round(CASE WHEN sum(g * p) = 0 THEN 0.0 ELSE 2.0 * sum(g * p) / (sum(g) + sum(p)) END, 6) AS f1 FROM (SELECT doc, {0}, max(CASE WHEN gold THEN 1 ELSE 0 END) AS g, max(CASE WHEN gold THEN 0 ELSE 1 END) AS p FROM o GROUP BY doc, {0}) GROUP BY 1"


@query("v04_structure", f"{_SIDES}, s AS ({_F1.format('path')}), m AS ({_F1.format('atom, text')}) SELECT doc, s.f1 AS sections_f1, m.f1 AS mentions_f1, round(0.5 * s.f1 + 0.5 * m.f1, 6) AS score FROM s JOIN m USING (doc)")
def v04_structure(spark: SparkSession, d: str) -> DataFrame:
    """Orders of even keys are gold; priorities are section paths, customers and states are mentions."""
    path = F.concat_ws(" ", F.col("o_orderpriority"), (F.col("o_custkey") % 9).cast("string"))
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("doc"), path.alias("path"), (F.col("o_custkey") % 20).alias("atom"), F.col("o_orderstatus").alias("text"), (F.col("o_orderkey") % 2 == 0).alias("gold"))
    g, p = o.where("gold"), o.where("NOT gold")
    none = o.select("doc", F.col("atom").alias("gold_id"), F.col("atom").alias("pred_id"), F.lit(1.0).alias("score")).limit(0)
    return scoring.score_structure(g.select("doc", "path"), p.select("doc", "path"), g.select("doc", "atom", "text"), p.select("doc", "atom", "text"), none)


@query("v04_suppression", """WITH f AS (SELECT c_nationkey AS doc, lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '' END AS n FROM customer), p AS (SELECT s_nationkey AS doc, 'the building' AS t FROM supplier UNION ALL SELECT s_nationkey, 'machinery x' FROM supplier WHERE s_suppkey % 2 = 0),
    g AS (SELECT s_nationkey AS doc, 'old building' AS t FROM supplier WHERE s_suppkey % 5 = 0), v AS (SELECT doc, count(*) AS total, count(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.doc = f.doc AND contains(t, n)) AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc = f.doc AND contains(t, n)) THEN 1 END) AS violations FROM f GROUP BY 1),
    d AS (SELECT doc FROM f UNION SELECT doc FROM p) SELECT doc, coalesce(total, 0) AS total, coalesce(violations, 0) AS violations, CASE WHEN coalesce(total, 0) = 0 THEN 1.0 ELSE round(1 - violations / total, 6) END AS score FROM d LEFT JOIN v USING (doc)""")
def v04_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Customers' segments must not be named by a nation's suppliers."""
    nation = lambda: table(spark, d, "supplier").withColumn("doc", F.col("s_nationkey"))
    more = F.when(F.col("c_custkey") % 3 == 0, " X").otherwise("")
    forbidden = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc"), F.concat("c_mktsegment", more).alias("text"))
    pred = nation().select("doc", F.lit("The  BUILDING").alias("text")).unionByName(nation().where("s_suppkey % 2 = 0").select("doc", F.lit("'Machinery X'").alias("text")))
    return scoring.score_suppression(forbidden, pred, nation().where("s_suppkey % 5 = 0").select("doc", F.lit("old building").alias("text")))


@query("v04_packages", """WITH p AS (SELECT l_orderkey // 100 AS doc, l_orderkey AS id, l_partkey AS object, l_linenumber AS n FROM lineitem), o AS (SELECT DISTINCT doc, object FROM p WHERE object % 3 <> 0),
    r AS (SELECT doc, count(o.object) * 1.0 / count(*) AS r FROM p LEFT JOIN o USING (doc, object) GROUP BY 1), c AS (SELECT doc, sum(CASE WHEN o.object IS NULL THEN 0 WHEN p.object % 2 = 0 THEN 2 ELSE 1 END) * 1.0 / sum(2) AS c FROM (SELECT DISTINCT doc, id, object FROM p) p LEFT JOIN o USING (doc, object) GROUP BY 1)
    SELECT doc, round(r, 6) AS object_recall, round(c, 6) AS field_coverage, round(0.7 * r + 0.3 * c, 6) AS score FROM r JOIN c USING (doc)""")
def v04_packages(spark: SparkSession, d: str) -> DataFrame:
    """Orders expect their parts; two parts of three are found, and every second of those has both names asked for."""
    p = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("doc"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("object"))
    fields = F.map_from_entries(F.transform(F.array_distinct(F.collect_list("object")), lambda x: F.struct(x, F.array(F.lit("name"), F.lit("unit")))))
    packages = p.groupBy("doc", "id").agg(F.collect_list("object").alias("expected"), fields.alias("fields"))
    aligned = p.where("object % 3 <> 0").select("doc", F.col("object").alias("gold_id"), F.col("object").alias("pred_id")).distinct()
    keys = F.when(F.col("pred_id") % 2 == 0, F.array(F.lit("name"), F.lit("unit"))).otherwise(F.array(F.lit("name")))
    return scoring.score_packages(packages, aligned, aligned.select("doc", "pred_id", keys.alias("keys")))


@query("s26_payload_leaves", """WITH e AS (SELECT event_id, unnest(['[0]', '[1, 0]', '[1, 1]', '[2, 0, 0]']) AS at, unnest(['kind', 'list', 'list', 'k']) AS key, unnest([event_type, CAST(user_id AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END, CAST(json_extract(props, '$.k') AS VARCHAR)]) AS value FROM events) SELECT * FROM e""")
def s26(spark: SparkSession, d: str) -> DataFrame:
    nested = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "list": ['), F.col("user_id").cast("string"), F.lit(", "), (F.col("event_id") % 2 == 0).cast("string"), F.lit(', null, {}], "more": {"inner": '), "props", F.lit("}}"))
    found = payload.scalar_leaves(table(spark, d, "events").select("event_id", nested.alias("payload")), ["event_id"], "payload")
    return found.withColumn("at", F.concat(F.lit("["), F.array_join(F.transform("at", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("k21_promoted_evidence", f"""WITH e AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 's' || l_suppkey, 'e' || l_partkey, CASE WHEN l_quantity > 10 THEN 'said ' || l_linenumber END NULLS FIRST) - 1 AS pos, 's' || l_suppkey AS s, 'e' || l_partkey AS k, CASE WHEN l_quantity > 10 THEN 'said ' || l_linenumber END AS span, l_suppkey, l_partkey FROM lineitem),
    t AS (SELECT *, l_suppkey % 3 = 0 AS own, l_suppkey % 3 <> 0 AND l_suppkey % 7 = 1 AS hidden, coalesce(CASE WHEN l_suppkey = (SELECT min(x.l_suppkey) FROM lineitem x WHERE x.l_partkey = e.l_partkey AND x.l_partkey % 2 = 0 AND x.l_partkey % 10 = x.l_suppkey % 10) THEN 'part ' || l_partkey END, span, '') AS text FROM e),
    n AS (SELECT *, 'src-promo-' || md5('lib|' || s) AS source FROM t WHERE own OR (NOT hidden AND text <> ''))
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, CASE WHEN own THEN s ELSE source END AS source_id, CASE WHEN own THEN k ELSE 'el-promo-' || md5(source || '|' || k || '|' || text) END AS element_id,
           CASE WHEN own THEN span ELSE coalesce(span, substr(text, 1, 500)) END AS quoted_span, CASE WHEN own THEN NULL ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'nb' ELSE 'nb-x' END END AS origin_notebook_id FROM n""")
def k21(spark: SparkSession, d: str) -> DataFrame:
    """Orders are objects with their lines as evidence; a third of the suppliers is the library's own, some are private, and parts of
    even keys are live elements of a supplier each."""
    line, blank = table(spark, d, "lineitem"), F.lit(None).cast("string")
    span = F.when(F.col("l_quantity") > 10, F.concat(F.lit("said "), F.col("l_linenumber").cast("string")))
    source = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    entry = F.struct(source("l_suppkey").alias("source_id"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("element_id"), span.alias("quoted_span"), *[blank.alias(c) for c in ("source_title", "element_type", "location_label", "origin_source_id", "origin_notebook_id")])
    objects = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("e")))), lambda x: x["e"]).alias("evidence"))
    suppliers = table(spark, d, "supplier").select(source("s_suppkey").alias("source_id"), F.col("s_suppkey").alias("n"))
    lines = line.select("l_partkey", "l_suppkey").where("l_partkey % 2 = 0 AND l_partkey % 10 = l_suppkey % 10")
    live = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    live = live.select(F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("element_id"), source("l_suppkey").alias("source_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))
    found, _, _ = promotion.promoted(objects, "lib", suppliers.where("n % 3 = 0").select("source_id"), suppliers.where("n % 3 <> 0 AND n % 7 = 1").select("source_id"), live, suppliers.where("n % 2 = 0").select("source_id", F.lit("nb").alias("notebook")), "nb-x")
    return found.select("id", F.posexplode("evidence").alias("pos", "e")).select("id", "pos", "e.source_id", "e.element_id", "e.quoted_span", "e.origin_notebook_id")


@query("x13_backfill", """WITH c AS (SELECT conv_id AS id, count(*) AS n, count(CASE WHEN length(text) < 120 THEN 1 END) AS flagged, count(CASE WHEN length(text) < 120 AND turn > 0 THEN 1 END) AS changed FROM conversations GROUP BY 1)
    SELECT 'judged' AS outcome, count(*) AS sources, CAST(sum(flagged) AS BIGINT) AS flagged, CAST(sum(changed) AS BIGINT) AS changed, count(CASE WHEN changed > 0 THEN 1 END) AS sources_changed FROM c""")
def x13(spark: SparkSession, d: str) -> DataFrame:
    """Conversations are sources, short turns are flagged; the run is stopped after two pages and taken up again."""
    turns, store = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "text"), f"{shared_dir(spark)}/backfill/{uuid.uuid4().hex}"
    sources = turns.select("id").distinct()
    size = max(1, sources.count() // 4)

    def judge(page: DataFrame) -> DataFrame:
        short = F.length("text") < 120
        return turns.join(page, "id", "left_semi").groupBy("id").agg(F.lit(backfill.JUDGED).alias("outcome"), F.count_if(short).alias("flagged"), F.count_if(short & (F.col("turn") > 0)).alias("changed"))

    backfill.backfill(sources, store, judge, size, most_pages=2)
    backfill.backfill(sources, store, judge, size)
    return backfill.tally(spark, store)
