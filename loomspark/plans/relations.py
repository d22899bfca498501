"""Joins, aggregates, windows, ordering and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunking, entities, graph, relational, retrieval, vector_index
from loomspark.plans import shapes
from loomspark.plans.registry import query
from loomspark.session import table


@query("c01_inner_join", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def c01(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("c02_left_join_counts", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(urgent, 0) AS urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def c02(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query("c03_conditional_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F' AND c_acctbal > 0")
def c03(spark: SparkSession, d: str) -> DataFrame:
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "F") & (F.col("c_acctbal") > 0)
    return table(spark, d, "orders").join(table(spark, d, "customer"), on, "left").select("o_orderkey", "c_name")


@query("c04_semi_join", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def c04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey")


@query("c05_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("c06_lateral_unnest", "SELECT page_id, CAST(i AS INT) AS pos, part FROM (SELECT page_id, unnest(string_split(url, '/')) AS part, generate_subscripts(string_split(url, '/'), 1) - 1 AS i FROM pages)")
def c06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("pos", "part"))


@query("c07_single_row_viewer", "SELECT s_suppkey, s_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)) AS own FROM supplier")
def c07(spark: SparkSession, d: str) -> DataFrame:
    viewer = table(spark, d, "nation").agg(F.min_by("n_nationkey", "n_name").alias("viewer"))  # one row
    return table(spark, d, "supplier").crossJoin(viewer).select("s_suppkey", (F.col("s_nationkey") == F.col("viewer")).alias("own"))


@query("c08_id_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 9, 500, 1400)")
def c08(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(1,), (5,), (9,), (500,), (1400,)], "o_orderkey long")
    return table(spark, d, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("c09_classified_join", """WITH l AS (SELECT k, count(*) AS logs FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id // 3 AS VARCHAR) END AS k FROM events WHERE event_type IN ('view', 'click')) GROUP BY k),
    e AS (SELECT k, count(*) AS events FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id // 3 AS VARCHAR) END AS k FROM events WHERE event_type = 'error') GROUP BY k),
    b AS (SELECT coalesce(l.k, e.k) AS k, coalesce(logs, 0) AS logs, coalesce(events, 0) AS events FROM l FULL OUTER JOIN e ON l.k IS NOT DISTINCT FROM e.k)
    SELECT k AS support_id, logs, events, CASE WHEN k IS NULL THEN 'unattributed' WHEN events = 0 THEN 'log_only' WHEN logs = 0 THEN 'event_only' WHEN events > 1 THEN 'ambiguous' WHEN logs > 1 THEN 'retry' ELSE 'joined' END AS kind FROM b""")
def c09(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("support_id", F.when(F.col("event_id") % 50 != 0, F.floor(F.col("event_id") / 3).cast("string")))
    return relational.classified_join(ev.where("event_type IN ('view', 'click')"), ev.where("event_type = 'error'"), "support_id")


@query("c10_shared_elements", "WITH m AS (SELECT DISTINCT l_suppkey AS source_id, l_orderkey AS element_id, l_partkey AS id FROM lineitem) SELECT x.source_id, x.id AS a, y.id AS b, count(*) AS overlap FROM m x JOIN m y ON x.source_id = y.source_id AND x.element_id = y.element_id AND x.id < y.id GROUP BY 1, 2, 3")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return entities.shared_elements(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("element_id"), F.col("l_partkey").alias("id")))


@query("c11_names_in_texts", r"SELECT DISTINCT 'en' AS lang, n_nationkey AS id, doc_id AS text_id FROM documents, (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'and' ELSE 'license' END AS w FROM nation) WHERE lang = 'en' AND regexp_matches(lower(text), '(^|[^a-z0-9])' || w || '($|[^a-z0-9])')")
def c11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    names = table(spark, d, "nation").select(F.lit("en").alias("lang"), F.col("n_nationkey").alias("id"), F.when(k == 0, "the").when(k == 1, "and").otherwise("license").alias("name"))
    texts = table(spark, d, "documents").select("lang", F.col("doc_id").alias("text_id"), "text")
    return entities.names_in_texts(names, texts, "lang")


@query("c12_name_triples", shapes.with_("nodes", "relations") + "SELECT a.name AS src_name, edge_type, b.name AS dst_name, count(*) AS n, count(DISTINCT source_id) AS sources FROM relations JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1, 2, 3")
def c12(spark: SparkSession, d: str) -> DataFrame:
    n = shapes.nodes(spark, d)
    r = shapes.relations(spark, d).join(n.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return r.groupBy("src_name", "edge_type", "dst_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"))


@query("c13_two_hop_bridge", "SELECT DISTINCT p_brand, o_custkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey")
def c13(spark: SparkSession, d: str) -> DataFrame:
    few = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("l_partkey"))
    items = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey"))
    return few.join(items, "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("p_brand", "o_custkey").distinct()


_SPANS = """WITH g AS (SELECT event_id AS id, user_id AS k, event_id * 10 AS a, event_id * 10 + 400 + CAST(floor(value) AS BIGINT) AS b FROM events WHERE event_type = 'view'),
    p AS (SELECT event_id AS id, user_id AS k, event_id * 10 AS a, event_id * 10 + 600 AS b FROM events WHERE event_type = 'click') """


def _spans(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    a = F.col("event_id") * 10
    gold = ev.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), a.alias("a"), (a + 400 + F.floor("value")).alias("b"))
    pred = ev.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), a.alias("a"), (a + 600).alias("b"))
    return relational.overlapping_spans(gold, pred, ["k"], 1000)


@query("c14_span_overlap", _SPANS + "SELECT k, g.id AS gold_id, p.id AS pred_id, round((least(g.b, p.b) - greatest(g.a, p.a)) * 1.0 / ((g.b - g.a) + (p.b - p.a) - (least(g.b, p.b) - greatest(g.a, p.a))), 6) AS iou FROM g JOIN p USING (k) WHERE g.a < p.b AND p.a < g.b")
def c14(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("k", "gold_id", "pred_id", "iou")


_LOOP = """r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC, gold_id, pred_id) AS i FROM pairs),
    w AS (SELECT k, i, gold_id, pred_id, iou, true AS taken, [gold_id] AS gs, [pred_id] AS ps FROM r WHERE i = 1 UNION ALL
          SELECT r.k, r.i, r.gold_id, r.pred_id, r.iou, NOT list_contains(gs, r.gold_id) AND NOT list_contains(ps, r.pred_id),
                 CASE WHEN list_contains(gs, r.gold_id) OR list_contains(ps, r.pred_id) THEN gs ELSE list_append(gs, r.gold_id) END,
                 CASE WHEN list_contains(gs, r.gold_id) OR list_contains(ps, r.pred_id) THEN ps ELSE list_append(ps, r.pred_id) END
          FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1),
    m AS (SELECT k, gold_id, pred_id, iou FROM w WHERE taken)"""
_PAIRS = "pairs AS (SELECT k, g.id AS gold_id, p.id AS pred_id, round((least(g.b, p.b) - greatest(g.a, p.a)) * 1.0 / ((g.b - g.a) + (p.b - p.a) - (least(g.b, p.b) - greatest(g.a, p.a))), 6) AS iou FROM g JOIN p USING (k) WHERE g.a < p.b AND p.a < g.b)"


@query("c15_greedy_matching", _SPANS.replace("WITH g", "WITH RECURSIVE g", 1) + f", {_PAIRS}, {_LOOP} SELECT * FROM m")
def c15(spark: SparkSession, d: str) -> DataFrame:
    return relational.greedy_matching(_spans(spark, d).select("k", "gold_id", "pred_id", "iou"), ["k"])


@query("c16_two_hops", shapes.with_("relations") + "SELECT a.edge_type, a.src AS a, a.dst AS b, b.dst AS c FROM (SELECT DISTINCT edge_type, src, dst FROM relations WHERE edge_type IN ('derived_from', 'kind_of', 'part_of', 'precedes', 'prerequisite_of') AND status <> 'rejected' AND quote <> '') a JOIN (SELECT DISTINCT edge_type, src, dst FROM relations WHERE edge_type IN ('derived_from', 'kind_of', 'part_of', 'precedes', 'prerequisite_of') AND status <> 'rejected' AND quote <> '') b ON a.edge_type = b.edge_type AND a.dst = b.src AND a.src <> b.dst AND a.src <> a.dst AND b.src <> b.dst")
def c16(spark: SparkSession, d: str) -> DataFrame:
    r = shapes.relations(spark, d).where(F.col("edge_type").isin(*graph.TRANSITIVE)).where("status <> 'rejected' AND quote <> '' AND src <> dst").select("edge_type", "src", "dst").distinct()
    return r.select("edge_type", F.col("src").alias("a"), F.col("dst").alias("b")).join(r.select("edge_type", F.col("src").alias("b"), F.col("dst").alias("c")), ["edge_type", "b"]).where("a <> c").select("edge_type", "a", "b", "c")


@query("c17_nearest_pairs", """WITH s AS (SELECT x.vec_id AS id, y.vec_id AS other, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS rn FROM s WHERE round(score, 9) >= 0.3) SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, round(round(score, 6), 4) AS score FROM r WHERE rn <= 5""")
def c17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.knn_pairs(rows, 5, 0.3).withColumn("score", F.round("score", 4))


@query("k10_vector_index", "SELECT count(*) AS queries, true AS at_least_90 FROM embeddings WHERE vec_id % 100 = 0")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """Every row is indexed; rows whose id is divisible by 100 ask, and the exact way tells how much was found."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked, index = rows.where("id % 100 = 0"), vector_index.fit(rows)
    found = vector_index.search(vector_index.build(rows, index), index, rows, asked, 10)
    return vector_index.recall(found, vector_index.exact_neighbours(rows, asked, 10)).select("queries", (F.col("recall") >= 0.9).alias("at_least_90"))


@query("c18_identity_map", "SELECT s_suppkey AS left_id, s_suppkey AS right_id, CASE WHEN s_suppkey % 2 = 0 THEN 'exact' ELSE 'folded' END AS how FROM supplier WHERE s_suppkey % 5 <> 0")
def c18(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    other = s.withColumn("name", F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.upper("name")))
    return relational.identity_map(relational.assert_unique(s, ["name"], "left names"), other)


@query("c19_first_by_status", "SELECT c_custkey, CAST(f.first AS DOUBLE) AS f_first, CAST(p.first AS DOUBLE) AS p_first, coalesce(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), FALSE) AS urgent FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON p.o_custkey = c_custkey")
def c19(spark: SparkSession, d: str) -> DataFrame:
    status = lambda s: F.min(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(status("F").alias("f_first"), status("P").alias("p_first"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.col("f_first").cast("double").alias("f_first"), F.col("p_first").cast("double").alias("p_first"), F.coalesce("u", F.lit(False)).alias("urgent"))


@query("d01_type_status_counts", "SELECT l_returnflag, l_linestatus, count(*) AS total, count(*) - count(CASE WHEN l_suppkey < 3 THEN 1 END) AS visible FROM lineitem GROUP BY 1, 2")
def d01(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    hidden = li.where("l_suppkey < 3").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("hidden"))
    total = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("total"))
    return total.join(hidden, ["l_returnflag", "l_linestatus"], "left").select("l_returnflag", "l_linestatus", "total", (F.col("total") - F.coalesce("hidden", F.lit(0))).alias("visible"))


@query("d02_log_stats", "SELECT count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, round(avg(value), 4) AS mean, max(value) AS top, (SELECT count(DISTINCT event_type) FROM events) AS kinds FROM events WHERE event_type <> 'view'")
def d02(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    own = ev.where("event_type <> 'view'").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("top"))
    return own.crossJoin(ev.agg(F.countDistinct("event_type").alias("kinds")))  # one row by one row


@query("d03_stage_percentiles", "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY 1")
def d03(spark: SparkSession, d: str) -> DataFrame:
    return relational.nearest_rank(table(spark, d, "events"), ["event_type"], "value")


@query("d04_gated_summary", "SELECT user_id, count(v) AS n_observed, count(*) - count(v) AS n_missing, CASE WHEN count(v) >= 50 THEN round(avg(v), 6) END AS mean, CASE WHEN count(v) >= 50 THEN quantile_disc(v, 0.5) END AS median FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1")
def d04(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return relational.gated_summary(ev, ["user_id"], "v", 50)


@query("d05_size_buckets", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CASE WHEN n < 60 THEN 'small' WHEN n < 75 THEN 'medium' ELSE 'large' END AS bucket, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events JOIN c USING (user_id) GROUP BY 1")
def d05(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    sizes = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    bucket = F.when(F.col("c").isNull(), "unknown").when(F.col("c") < 60, "small").when(F.col("c") < 75, "medium").otherwise("large")
    return relational.nearest_rank(ev.join(sizes, "user_id", "left").withColumn("bucket", bucket), ["bucket"], "value")


@query("d06_histogram_percentile", "WITH b AS (SELECT event_type, CASE WHEN value <= 100 THEN ceil(value / 10) * 10 END AS bound, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bound NULLS LAST) AS run, sum(n) OVER (PARTITION BY event_type) AS tot, max(bound) OVER (PARTITION BY event_type) AS top FROM b) SELECT event_type, CAST(coalesce(min(bound), max(top)) AS DOUBLE) AS bound FROM r WHERE run >= tot * 0.95 GROUP BY 1")
def d06(spark: SparkSession, d: str) -> DataFrame:
    buckets = table(spark, d, "events").groupBy("event_type", F.when(F.col("value") <= 100, F.ceil(F.col("value") / 10) * 10).cast("double").alias("bound")).agg(F.count(F.lit(1)).alias("n"))
    return relational.histogram_percentile(buckets, ["event_type"], "bound", "n", 0.95)


@query("d07_distinct_filter", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity > 25) AS large, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted, bool_or(l_tax = 0) AS untaxed FROM lineitem GROUP BY 1")
def d07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.expr("count(*) FILTER (WHERE l_quantity > 25)").alias("large"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"), F.bool_or(F.col("l_tax") == 0).alias("untaxed"))


@query("d11_repeated_keys", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("d12_table_fingerprint", "SELECT n_regionkey, sha256(string_agg(hex(n_name) || chr(31) || CAST(n_nationkey AS VARCHAR), chr(30) ORDER BY n_nationkey)) AS fingerprint FROM nation GROUP BY 1")
def d12(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.hex("n_name"), F.lit("\x1f"), F.col("n_nationkey").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), cell.alias("c"))))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["c"]), "\x1e"), 256).alias("fingerprint"))


@query("d13_dirty_flag", "SELECT p_brand, max(CASE WHEN l_partkey IS NULL THEN 1 ELSE 0 END) AS dirty FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey GROUP BY 1")
def d13(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("have")).distinct()
    return table(spark, d, "part").join(have, "p_partkey", "left").groupBy("p_brand").agg(F.max(F.when(F.col("have").isNull(), 1).otherwise(0)).alias("dirty"))


_VALID = " OR ".join(f"(edge_type = '{e}' AND src_type || '>' || dst_type IN ({', '.join(repr('>'.join(p)) for p in pairs)}))" for e, pairs in graph.EDGE_PAIRS.items())
_TYPED = shapes.with_("nodes", "relations") + f", typed AS (SELECT r.*, a.object_type AS src_type, b.object_type AS dst_type, a.name AS src_name, b.name AS dst_name FROM relations r LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst), checked AS (SELECT *, coalesce({_VALID}, FALSE) AS valid FROM typed) "


@query("d14_edge_trust", _TYPED + ", named AS (SELECT *, coalesce(src_name, CAST(src AS VARCHAR)) AS sn, coalesce(dst_name, CAST(dst AS VARCHAR)) AS dn FROM checked), backed AS (SELECT sn, edge_type, dn, count(DISTINCT source_id) AS sources FROM named GROUP BY 1, 2, 3) SELECT id, sources, round(0.4 * CASE WHEN quote <> '' THEN 1 ELSE 0 END + 0.3 * least(sources / 3.0, 1.0) + 0.3 * CASE WHEN valid THEN 1 ELSE 0 END, 6) AS trust FROM named JOIN backed USING (sn, edge_type, dn)")
def d14(spark: SparkSession, d: str) -> DataFrame:
    n, r = shapes.nodes(spark, d), shapes.relations(spark, d)
    return graph.trust(graph.with_types(r, n, labels=True), n)


@query("d16_size_histogram", "WITH g AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT p_type, CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS bucket, count(*) AS clusters FROM g GROUP BY 1, 2), dim AS (SELECT DISTINCT p_type, bucket FROM part, (VALUES ('1'), ('2-5'), ('6-20'), ('21+')) v(bucket)) SELECT p_type, bucket, coalesce(clusters, 0) AS clusters FROM dim LEFT JOIN b USING (p_type, bucket)")
def d16(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    n = F.col("n")
    counts = part.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")).groupBy("p_type", F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+").alias("bucket")).agg(F.count(F.lit(1)).alias("clusters"))
    dimension = part.select("p_type").distinct().select("p_type", F.explode(F.array(*map(F.lit, ("1", "2-5", "6-20", "21+")))).alias("bucket"))
    return relational.zero_filled(counts, dimension, ["p_type", "bucket"], "clusters")


@query("d17_largest_clusters", "SELECT p_name, count(*) AS n, (SELECT count(DISTINCT p_name) FROM part) > 10 AS truncated FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def d17(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    probe = sizes.orderBy(F.desc("n"), "p_name").limit(11)
    return probe.withColumn("all", F.count(F.lit(1)).over(Window.partitionBy())).orderBy(F.desc("n"), "p_name").limit(10).select("p_name", "n", (F.col("all") > 10).alias("truncated"))


@query("d18_provenance", shapes.with_("relations") + "SELECT edge_type, count(*) AS total, count(CASE WHEN status <> 'rejected' THEN 1 END) AS counted, count(CASE WHEN status = 'rejected' THEN 1 END) AS excluded, count(CASE WHEN quote LIKE 'line 1%' THEN 1 END) AS relinked FROM relations GROUP BY 1")
def d18(spark: SparkSession, d: str) -> DataFrame:
    return shapes.relations(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "rejected").alias("counted"), F.count_if(F.col("status") == "rejected").alias("excluded"), F.count_if(F.startswith("quote", F.lit("line 1"))).alias("relinked"))


@query("d19_group_overview", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS size FROM part) SELECT p_brand, max(size) AS size, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY rn) AS members, max(size) > 3 AS truncated FROM r WHERE rn <= 3 GROUP BY 1")
def d19(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    r = table(spark, d, "part").withColumn("rn", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey"))).withColumn("size", F.count(F.lit(1)).over(w)).where("rn <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("p_partkey").cast("string").alias("k")))), lambda x: x["k"])
    return r.groupBy("p_brand").agg(F.max("size").alias("size"), F.array_join(listed, ",").alias("members"), (F.max("size") > 3).alias("truncated"))


@query("d20_families", """WITH RECURSIVE e AS (SELECT DISTINCT a.s_suppkey AS u, b.s_suppkey AS v FROM supplier a JOIN supplier b ON (a.s_nationkey = b.s_nationkey OR CAST(floor(a.s_acctbal / 50) AS INT) = CAST(floor(b.s_acctbal / 50) AS INT))),
    r(id, v) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.id, e.v FROM r JOIN e ON r.v = e.u) SELECT id, min(v) AS family FROM r GROUP BY id""")
def d20(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("hash"), F.floor(F.col("s_acctbal") / 50).alias("title"))
    return entities.families(sources, ["hash", "title"])


@query("d21_quality_probes", r"SELECT mask, count(*) AS n FROM (SELECT regexp_replace(lower(p_brand), '\d+', '#', 'g') || '/' || p_type AS mask FROM part) GROUP BY 1 HAVING count(*) >= 2")
def d21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.concat(T.digit_mask(F.col("p_brand")), F.lit("/"), "p_type").alias("mask")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("d22_funnel", "SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS pending, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS adopted, CASE WHEN count(CASE WHEN event_type IN ('view', 'purchase') THEN 1 END) > 0 THEN round(count(CASE WHEN event_type = 'purchase' THEN 1 END) * 1.0 / count(CASE WHEN event_type IN ('view', 'purchase') THEN 1 END), 6) END AS rate FROM events GROUP BY 1")
def d22(spark: SparkSession, d: str) -> DataFrame:
    view, bought = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "purchase")
    return table(spark, d, "events").groupBy("user_id").agg(view.alias("pending"), bought.alias("adopted"), F.when(view + bought > 0, F.round(bought / (view + bought), 6)).alias("rate"))


@query("d23_coverage_audit", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1")
def d23(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.groupBy(F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "good").otherwise("poor").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("d24_contract_audit", _TYPED + "SELECT edge_type, src_type, dst_type, count(*) AS violations, min(id) AS sample FROM checked WHERE NOT valid GROUP BY 1, 2, 3")
def d24(spark: SparkSession, d: str) -> DataFrame:
    checked = graph.validity(graph.with_types(shapes.relations(spark, d), shapes.nodes(spark, d)))
    return checked.where(~F.col("valid")).groupBy("edge_type", "src_type", "dst_type").agg(F.count(F.lit(1)).alias("violations"), F.min("id").alias("sample"))


@query("d25_snapshot_comparison", "SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, a.n AS before, b.n AS after FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1) a FULL OUTER JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) b ON a.l_returnflag = b.l_returnflag")
def d25(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    count = lambda df, name: df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias(name))
    return count(li.where("l_shipdate < TIMESTAMP '1998-01-01'"), "before").join(count(li, "after"), "l_returnflag", "full_outer")


@query("d26_degrees", shapes.with_("relations") + "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM relations UNION ALL SELECT dst FROM relations) GROUP BY 1")
def d26(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(shapes.relations(spark, d))


@query("d27_strongest_decision", shapes.with_("relations") + "SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, CASE max(CASE status WHEN 'verified' THEN 3 WHEN 'rejected' THEN 2 ELSE 1 END) WHEN 3 THEN 'verified' WHEN 2 THEN 'rejected' ELSE 'pending' END AS status FROM relations GROUP BY 1, 2")
def d27(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("status") == "verified", 3).when(F.col("status") == "rejected", 2).otherwise(1)
    return shapes.relations(spark, d).groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.max_by("status", rank).alias("status"))


@query("d28_counts_by_tag", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def d28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("e01_latest_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def e01(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("e03_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_type || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM events")
def e03(spark: SparkSession, d: str) -> DataFrame:
    blank = table(spark, d, "events").withColumn("filled", F.when(F.col("event_type") == "error", F.concat("event_type", F.col("event_id").cast("string"))).otherwise("  "))
    return relational.forward_fill(blank, ["user_id"], ["event_id"], "filled").select("event_id", "filled")


@query("e04_net_changes", "SELECT user_id, arg_min(prev, event_id) AS before, arg_max(event_type, event_id) AS after, count(*) AS changes FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'error' END AS prev FROM events) GROUP BY 1 HAVING arg_min(prev, event_id) IS DISTINCT FROM arg_max(event_type, event_id)")
def e04(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    log = table(spark, d, "events").select("user_id", "event_id", F.when(k == 0, "view").when(k == 1, "click").otherwise("error").alias("before"), F.col("event_type").alias("after"))
    return relational.net_changes(log, ["user_id"], "event_id", "before", "after")


@query("e05_ring", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def e05(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"), keep=3).select("event_id")


@query("e06_best_kept", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def e06(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(spark, d, "orders"), ["o_custkey"], F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey"), keep=2).select("o_orderkey")


@query("e07_section_spread", "SELECT doc_id, rn AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) ORDER BY rn, md5(source), source LIMIT 50")
def e07(spark: SparkSession, d: str) -> DataFrame:
    spread = relational.round_robin(table(spark, d, "documents"), "source", [F.md5(F.col("doc_id").cast("string")), "doc_id"], [F.md5("source"), "source"], 50)
    return spread.select("doc_id", "turn")


@query("e09_concept_rank", shapes.with_("relations") + "SELECT src, rank FROM (SELECT src, row_number() OVER (ORDER BY count(DISTINCT source_id) DESC, count(*) DESC, src) AS rank FROM relations GROUP BY src) WHERE rank <= 80")
def e09(spark: SparkSession, d: str) -> DataFrame:
    counts = shapes.relations(spark, d).groupBy("src").agg(F.countDistinct("source_id").alias("s"), F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("s"), F.desc("n"), "src").limit(80)
    return top.select("src", F.row_number().over(Window.orderBy(F.desc("s"), F.desc("n"), "src")).alias("rank"))


@query("e10_chain_state", "SELECT user_id, min(event_id) AS first_seen, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def e10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"), F.max_by("event_type", "event_id").alias("state"))


@query("e12_text_windows", "SELECT doc_id, CAST(w AS INT) AS window, CAST(w * 900 AS INT) AS char_start, CAST(least(w * 900 + 1000, length(text)) AS INT) AS char_end FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 100) / 900.0), 1) AS BIGINT))) AS w FROM documents WHERE length(text) > 0)")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return chunking.windows(table(spark, d, "documents"), 1000, 100).select("doc_id", "window", "char_start", "char_end")


@query("e13_chunks", shapes.with_("elements").replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT doc_id, pos, trim(text, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM elements WHERE pos > 0),
    h AS (SELECT doc_id, trim(text, ' ') AS title FROM elements WHERE pos = 0),
    w AS (SELECT doc_id, i, 0 AS nth, length(t) AS used FROM b WHERE i = 1 UNION ALL
          SELECT b.doc_id, b.i, CASE WHEN used >= 600 THEN nth + 1 ELSE nth END, CASE WHEN used >= 600 THEN length(t) ELSE used + length(t) END FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)
    SELECT doc_id, nth AS chunk, coalesce(any_value(title), '') AS section_path, CASE WHEN any_value(title) IS NULL THEN '' ELSE '[' || any_value(title) || '] ' END || string_agg(t, chr(10) ORDER BY i) AS text,
           string_agg(CAST(pos AS VARCHAR), ',' ORDER BY i) AS element_ids FROM w JOIN b USING (doc_id, i) LEFT JOIN h USING (doc_id) GROUP BY doc_id, nth""")
def e13(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(shapes.typed_elements(spark, d)).withColumn("element_ids", F.array_join("element_ids", ","))


@query("e14_evenly_spaced", "WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id FROM n WHERE n <= 5 OR i IN (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1)")
def e14(spark: SparkSession, d: str) -> DataFrame:
    return relational.evenly_spaced(table(spark, d, "events"), ["user_id"], ["event_id"], 5).select("event_id")


@query("f05_group_ranking", "SELECT lang, source, count(*) AS hits, min(length(text)) AS shortest FROM documents WHERE contains(text, 'the') GROUP BY 1, 2 ORDER BY hits DESC, shortest, lang, source LIMIT 10")
def f05(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").where(F.contains("text", F.lit("the"))).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("hits"), F.min(F.length("text")).alias("shortest"))
    return g.orderBy(F.desc("hits"), "shortest", "lang", "source").limit(10)


@query("f06_ranked_dedupe", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY lang = 'en' DESC, n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def f06(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").withColumn("k", F.sha2(F.lower("text"), 256))
    return relational.latest(keyed, ["k"], F.desc(F.col("lang") == "en"), F.desc("n_chars"), F.col("doc_id")).select("doc_id")


@query("f07_reserved_evidence", "SELECT s_nationkey AS library, s_suppkey AS id, rn = 1 AS reserved FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) ORDER BY rn = 1 DESC, s_acctbal DESC, s_nationkey, s_suppkey LIMIT 40")
def f07(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "supplier").select(F.col("s_nationkey").alias("library"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return retrieval.reserved_evidence(hits, 40).select("library", "id", "reserved")


@query("f09_page_with_more", "SELECT event_id, (SELECT count(*) FROM events WHERE event_id > 100) > 20 AS has_more FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 20")
def f09(spark: SparkSession, d: str) -> DataFrame:
    probe = relational.keyset_page(table(spark, d, "events").select("event_id"), ["event_id"], (100,), 21)
    return probe.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).orderBy("event_id").limit(20).select("event_id", (F.col("n") > 20).alias("has_more"))


@query("f10_tier_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice, o_orderkey LIMIT 30 OFFSET 10")
def f10(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(tier, "o_totalprice", "o_orderkey").offset(10).limit(30).select("o_orderkey")


@query("f12_batches", """WITH RECURSIVE r AS (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    w AS (SELECT source, i, 0 AS batch, 1 AS n, size AS used FROM r WHERE i = 1 UNION ALL
          SELECT r.source, r.i, CASE WHEN n >= 20 OR used + size > 20000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 20 OR used + size > 20000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 20 OR used + size > 20000 THEN size ELSE used + size END
          FROM w JOIN r ON r.source = w.source AND r.i = w.i + 1)
    SELECT source, doc_id, size, batch FROM w JOIN r USING (source, i)""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("size"))
    return chunking.batches(rows, "source", ["doc_id"], 20, 20_000)


@query("f13_merged_arms", "SELECT kind, k FROM (SELECT 'order' AS kind, o_orderkey AS k, o_orderdate AS happened FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'item', l_orderkey, l_shipdate FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1 AND l_tax = 0) ORDER BY happened DESC, kind, k LIMIT 40")
def f13(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"))
    b = table(spark, d, "lineitem").where("l_quantity = 50 AND l_linenumber = 1 AND l_tax = 0").select(F.lit("item").alias("kind"), F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("at"))
    return a.unionByName(b).orderBy(F.desc("at"), "kind", "k").limit(40).select("kind", "k")


@query("g01_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("g03_ordered_union", "SELECT k, arm FROM (SELECT k, arm, row_number() OVER (PARTITION BY k ORDER BY arm, spot) AS rn FROM (SELECT o_custkey AS k, 0 AS arm, o_orderkey AS spot FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT c_custkey, 1, c_custkey FROM customer)) WHERE rn = 1")
def g03(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("p"))
    return relational.ordered_union((a, "p"), (b, "p"), key="k").select("k", "arm")


@query("g05_text_dedupe", shapes.with_("elements") + "SELECT doc_id, CAST(min(pos) AS INT) AS pos FROM elements GROUP BY doc_id, text")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(shapes.elements(spark, d), ["doc_id", "text"], F.col("pos")).select("doc_id", "pos")


@query("g06_unordered_pairs", shapes.with_("relations") + "SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, min(id) AS id FROM relations WHERE src <> dst GROUP BY 1, 2")
def g06(spark: SparkSession, d: str) -> DataFrame:
    return relational.unordered_pairs(shapes.relations(spark, d).select("id", "src", "dst"), "src", "dst", F.col("id")).select("lo", "hi", "id")


@query("g07_missing_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def g07(spark: SparkSession, d: str) -> DataFrame:
    return relational.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("g08_upsert", "SELECT c_custkey AS k, CAST(coalesce(v, c_acctbal) AS DOUBLE) AS v FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE s IS NULL OR s <> 'P'")
def g08(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("-").alias("s"))
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("seq"))
    return relational.upserted(base, changes, ["k"], "seq", F.col("s") == "P").select("k", "v")
