"""Curation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import curation, retrieval
from loomspark.operators.graph import EDGE_PAIRS
from loomspark.plans import shapes
from loomspark.plans.knowledge import _rounds
from loomspark.plans.registry import query
from loomspark.session import table

_CONTRACT = ", ".join(f"('{e}', '{a}', '{b}')" for e, pairs in EDGE_PAIRS.items() for a, b in pairs)


@query("a16_adjacency_blocks", shapes.with_("relations") + ", b AS (SELECT src AS id, dst AS o FROM relations WHERE src <> dst UNION SELECT dst, src FROM relations WHERE src <> dst), r AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY o) - 1) // 20 AS block, count(*) OVER (PARTITION BY id) AS degree FROM b) SELECT id, degree, block, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS neighbours FROM r GROUP BY 1, 2, 3")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return curation.adjacency_blocks(shapes.relations(spark, d), 20).withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ","))


@query("k12_completion", shapes.with_("nodes", "relations") + rf""", m AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS element_id FROM lineitem), contract(edge_type, st, tt) AS (VALUES {_CONTRACT}),
    h AS (SELECT id, object_type, name, brand AS section, row_number() OVER (PARTITION BY brand ORDER BY sha256('run:' || id)) AS turn FROM nodes WHERE id IN (SELECT id FROM m)), s AS (SELECT * FROM h ORDER BY turn, section LIMIT 300),
    w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}]+'))) AS w FROM s), p AS (SELECT a.id AS source, b.id AS target, CAST(count(*) AS DOUBLE) AS score FROM w a JOIN w b USING (w) WHERE a.id <> b.id GROUP BY 1, 2),
    met AS (SELECT DISTINCT a.id AS source, b.id AS target FROM m a JOIN m b USING (element_id) WHERE a.id IN (SELECT id FROM s) AND b.id IN (SELECT id FROM s)), there AS (SELECT DISTINCT edge_type, CASE WHEN edge_type = 'contrasts_with' THEN least(src, dst) ELSE src END AS e1, CASE WHEN edge_type = 'contrasts_with' THEN greatest(src, dst) ELSE dst END AS e2 FROM relations),
    o AS (SELECT p.*, x.section, c.edge_type FROM p ANTI JOIN met USING (source, target) JOIN s x ON x.id = source JOIN s y ON y.id = target JOIN contract c ON c.st = x.object_type AND c.tt = y.object_type),
    k AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.edge_type = o.edge_type AND t.e1 = CASE WHEN o.edge_type = 'contrasts_with' THEN least(source, target) ELSE source END AND t.e2 = CASE WHEN o.edge_type = 'contrasts_with' THEN greatest(source, target) ELSE target END)),
    g AS (SELECT source, target, section, score, string_agg(edge_type, ',' ORDER BY edge_type) AS allowed FROM k GROUP BY 1, 2, 3, 4), q AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, sha256('run:' || source || ':' || target)) AS place FROM g)
    SELECT source, target, section, score, allowed FROM q WHERE place <= 6 ORDER BY score DESC, sha256('run:' || source || ':' || target) LIMIT 100""")
def k12(spark: SparkSession, d: str) -> DataFrame:
    objects = shapes.nodes(spark, d).select("id", "object_type", "name", F.col("brand").alias("section"))
    members = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("element_id")).distinct()
    found = curation.completion_candidates(objects, members, shapes.relations(spark, d), "run", 300, 100, quota=6)
    return found.withColumn("allowed", F.array_join("allowed", ","))


@query("f08_library_page", "WITH r AS (SELECT p_brand AS library, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank FROM part), l AS (SELECT library, n, spot, greatest(1, 60 // n) AS q FROM (SELECT p_brand AS library, count(*) OVER () AS n, row_number() OVER (ORDER BY p_brand) - 1 AS spot FROM part GROUP BY 1 HAVING max(p_size) > 20)), z AS (SELECT library, q + CASE WHEN spot < greatest(0, 60 - q * n) THEN 1 ELSE 0 END AS quota FROM l) SELECT r.library, id, CAST(rank AS INT) AS rank FROM r JOIN z USING (library) WHERE rank >= quota AND rank < least(2 * quota, 80)")
def f08(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("library", F.col("p_brand"))
    ranked = part.selectExpr("library", "p_partkey AS id", "row_number() OVER (PARTITION BY library ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank")
    return curation.library_page(ranked, part.groupBy("library").agg((F.max("p_size") > 20).alias("ready")), 1, 60)


@query("s07_aliases", "WITH n AS (SELECT p_partkey AS id, lower(p_name) AS n, 'ab' || p_size AS s FROM part), a AS (SELECT id, unnest(CASE WHEN id % 4 IN (0, 1) THEN [n, s] WHEN id % 4 = 2 THEN [n] ELSE [CAST(id AS VARCHAR)] END) AS alias, s FROM n) SELECT DISTINCT id, alias FROM a WHERE (alias = s AND length(s) >= 3) OR (alias <> s AND length(alias) >= 4 AND NOT regexp_matches(alias, '^[0-9]*$'))")
def s07(spark: SparkSession, d: str) -> DataFrame:
    k, short = F.col("p_partkey") % 4, F.concat(F.lit("AB"), F.col("p_size").cast("string"))
    name = F.when(k == 0, F.concat("p_name", F.lit(" ("), short, F.lit(")"))).when(k == 1, F.concat(short, F.lit(" ("), F.col("p_name"), F.lit(")"))).when(k == 2, F.col("p_name")).otherwise(F.col("p_partkey").cast("string"))
    return curation.aliases(table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")))


@query("s29_sequence_ratio")
def s29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(curation.sequence_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("r10_active_floor", """WITH h AS (SELECT vec_id AS id, vec_id % 20 AS q, label = 0 AS local, 't' || (vec_id % 70) AS text, vec_id % 5 = 0 AS extra, (vec_id * 37 % 101) / 100.0 AS relevance FROM embeddings), s AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY relevance DESC, id) AS place FROM h QUALIFY place <= 8),
    held AS (SELECT DISTINCT q, text FROM s WHERE local), f AS (SELECT * FROM h ANTI JOIN held USING (q, text) WHERE local QUALIFY row_number() OVER (PARTITION BY q, text ORDER BY relevance DESC, id) = 1), spare AS (SELECT q, id AS new_id, row_number() OVER (PARTITION BY q ORDER BY relevance DESC, id) AS k FROM f),
    lv AS (SELECT s.q, s.place, row_number() OVER (PARTITION BY s.q ORDER BY extra DESC, place DESC) AS k FROM s WHERE NOT local), sw AS (SELECT lv.q, lv.place, new_id FROM lv JOIN spare USING (q, k) WHERE k <= 3 - (SELECT count(*) FROM held WHERE held.q = lv.q))
    SELECT s.q, CAST(s.place AS INT) AS place, coalesce(new_id, id) AS id FROM s LEFT JOIN sw ON sw.q = s.q AND sw.place = s.place""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "embeddings").selectExpr("vec_id AS id", "vec_id % 20 AS q", "label = 0 AS local", "concat('t', vec_id % 70) AS text", "vec_id % 5 = 0 AS extra", "(vec_id * 37 % 101) / 100D AS relevance")
    chosen = hits.selectExpr("*", "row_number() OVER (PARTITION BY q ORDER BY relevance DESC, id) AS place").where("place <= 8")
    return curation.with_floor(chosen, hits, 3)


@query("k04_source_rank", shapes.with_("relations") + ", one AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(weight, id) AS weight FROM relations WHERE src <> dst AND status <> 'rejected' AND source_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY 1, 2), e AS (SELECT lo AS u, hi AS v, weight FROM one UNION ALL SELECT hi, lo, weight FROM one), shares AS (SELECT u, v, weight / sum(weight) OVER (PARTITION BY u) AS share FROM e), reset AS (SELECT p_partkey AS id, 1.0 / count(*) OVER () AS r FROM part WHERE p_partkey < 5), s0 AS (SELECT id, r AS score FROM reset), " + _rounds(3) + " SELECT id, round(score, 6) AS score FROM s3")
def k04(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("source_id"))
    seeds = shapes.nodes(spark, d).where("id < 5").select("id", F.lit(1.0).alias("weight"))
    return curation.source_rank(shapes.relations(spark, d), sources, seeds, rounds=3).withColumn("score", F.round("score", 6))


@query("k05_spliced", shapes.with_("relations") + ", c AS (SELECT p_partkey AS id, p_partkey - p_partkey % 5 AS canonical FROM part) SELECT src, dst, edge_type FROM relations WHERE tier = 'base' AND src <> dst UNION SELECT coalesce(a.canonical, src), coalesce(b.canonical, dst), edge_type FROM relations LEFT JOIN c a ON a.id = src LEFT JOIN c b ON b.id = dst WHERE tier <> 'base' AND coalesce(a.canonical, src) <> coalesce(b.canonical, dst)")
def k05(spark: SparkSession, d: str) -> DataFrame:
    r = shapes.relations(spark, d)
    return curation.spliced(r.where("tier = 'base'"), r.where("tier <> 'base'"), table(spark, d, "part").selectExpr("p_partkey AS id", "p_partkey - p_partkey % 5 AS canonical"))


@query("k18_checked_partitions", "SELECT l_suppkey AS source_id, count(*) AS n_edges FROM lineitem GROUP BY 1")
def k18(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return curation.checked_partitions(shapes.relations(spark, d), declared)


@query("v07_extract_seconds", "SELECT doc_id, CAST(ceil(length(text) / 900.0) AS BIGINT) AS n_windows, round(ceil(ceil(length(text) / 900.0) / 4.0) * 1.5 + 3, 2) AS est_s FROM documents")
def v07(spark: SparkSession, d: str) -> DataFrame:
    n, est = curation.extract_seconds(F.length("text"), 900, 4, 1.5, 3.0)
    return table(spark, d, "documents").select("doc_id", n.alias("n_windows"), est.alias("est_s"))


@query("x07_dangling", """WITH k AS (SELECT o_orderkey AS id, o_orderkey % 50 AS a, o_custkey % 50 AS b, o_orderkey % 7 AS c FROM orders), g AS (SELECT *, list_filter([a, b], lambda x: x % 3 <> 0) AS l FROM k)
    SELECT id, 'Total' || CASE WHEN len(l) = 0 THEN '' ELSE ' [' || array_to_string(list_transform(l, lambda x: 'k' || x), ', ') || ']' END || ' of' || CASE WHEN c % 3 <> 0 THEN ' [k' || c || ']' ELSE '' END || '.' AS text, len(list_distinct(list_filter([a, b, c], lambda x: x % 3 = 0))) AS n_dead FROM g""")
def x07(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('Total [k', o_orderkey % 50, ', k', o_custkey % 50, '] of [k', o_orderkey % 7, '].') AS text")
    return curation.without_dangling(texts, spark.range(50).where("id % 3 <> 0").selectExpr("concat('k', id) AS key"))


@query("x10_outline", "WITH s AS (SELECT p_partkey // 12 AS outline, p_partkey AS id, p_partkey - p_partkey % 3 AS parent, p_size * 100000 + p_partkey AS pos, p_size % 5 <> 0 AS bound FROM part), k AS (SELECT * FROM s WHERE bound), j AS (SELECT k.*, r.pos AS root_pos FROM k LEFT JOIN k r ON r.outline = k.outline AND r.id = k.parent AND k.parent <> k.id) SELECT outline, id, CAST(row_number() OVER (PARTITION BY outline ORDER BY coalesce(root_pos, pos), root_pos IS NOT NULL, pos) AS INT) AS place, CASE WHEN root_pos IS NOT NULL THEN parent ELSE -1 END AS parent FROM j UNION ALL SELECT outline, id, 0, -1 FROM s WHERE NOT bound")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return curation.outline_order(table(spark, d, "part").selectExpr("p_partkey div 12 AS outline", "p_partkey AS id", "p_partkey - p_partkey % 3 AS parent", "p_size * 100000 + p_partkey AS pos", "p_size % 5 <> 0 AS bound")).fillna({"place": 0, "parent": -1})


@query("x14_attributed", "SELECT DISTINCT event_id AS job_id, unnest(['n' || user_id % 9, 'n' || event_id % 4]) AS notebook FROM events WHERE event_id % 10 <> 0")
def x14(spark: SparkSession, d: str) -> DataFrame:
    payload = "CASE WHEN event_id % 10 = 0 THEN 'broken' ELSE concat('{\"notebooks\": [\"n', user_id % 9, '\", \"n', event_id % 4, '\"]}') END AS payload"
    return curation.attributed(table(spark, d, "events").selectExpr("event_id AS job_id", payload))


@query("y03_merged_scopes", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders QUALIFY pos <= 3), g AS (SELECT o_custkey AS chain, count(DISTINCT lower(o_orderstatus)) AS s, min(lower(o_orderstatus)) AS one, bool_or(o_orderkey % 4 = 0) AS w, bool_or(o_orderkey % 4 = 1) AS wo, arg_min(o_orderkey % 4, pos) AS f,
    count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END) AS p, min(CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) END) AS approx FROM o GROUP BY 1) SELECT chain, one || ',all' AS region, approx AS approximation FROM g WHERE s = 1 AND p <= 1 AND NOT (w AND wo) UNION ALL SELECT chain, 'all', approx FROM g WHERE s > 1 AND p <= 1 AND NOT (w AND wo)""")
def y03(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("*", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos").where("pos <= 3")
    scopes = rows.selectExpr("o_custkey AS chain", "pos", "array(o_orderstatus, 'All') AS region", "CASE o_orderkey % 4 WHEN 0 THEN array('With effect') WHEN 1 THEN array('without effect') ELSE array('long-channel') END AS assumptions", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS approximation", "CAST(NULL AS string) AS span")
    return curation.merged_scopes(scopes).select("chain", F.array_join("region", ",").alias("region"), "approximation")


@query("y11_clustered", "WITH s AS (SELECT p_partkey AS id, p_name AS name, lower(p_type) AS seed, split_part(lower(p_type), ' ', 1) AS w FROM part), m AS (SELECT w, min(seed) AS least FROM s GROUP BY 1), r AS (SELECT s.*, CASE WHEN length(seed) % 4 = 0 THEN seed ELSE least END AS root FROM s JOIN m USING (w)) SELECT id, 'K-' || substr(sha256(root), 1, 16) AS cluster, first_value(name) OVER (PARTITION BY root ORDER BY id) AS display FROM r")
def y11(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", "lower(p_type) AS seed")
    pairs = objects.selectExpr("seed AS b", "split(seed, ' ')[0] AS w").distinct().selectExpr("min(b) OVER (PARTITION BY w) AS a", "b")
    return curation.clustered(objects, pairs, pairs.where("length(b) % 4 = 0"))


@query("y20_relation_scores", shapes.with_("nodes", "relations") + r", t AS (SELECT r.id, list_distinct(regexp_extract_all(lower(a.name || ' ' || edge_type || ' ' || b.name), '[\p{L}\p{N}]+')) AS w FROM relations r JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst), s AS (SELECT id, len(list_intersect(['red', 'blue', 'green', 'bolt'], w)) / 4.0 AS k, CASE WHEN id % 2 = 0 THEN (id % 100) / 100.0 END AS v FROM t) SELECT id, round(CASE WHEN v IS NULL THEN k ELSE 0.4 * k + 0.6 * v END, 4) AS score FROM s WHERE CASE WHEN v IS NULL THEN k ELSE 0.4 * k + 0.6 * v END >= 0.12")
def y20(spark: SparkSession, d: str) -> DataFrame:
    name = lambda end: shapes.nodes(spark, d).select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    rows = shapes.relations(spark, d).select("id", "src", "dst", "edge_type").join(name("src"), "src").join(name("dst"), "dst")
    asked = F.array(*map(F.lit, ("red", "blue", "green", "bolt")))
    cover = retrieval.keyword_coverage(asked, T.tokens(F.concat_ws(" ", "src_name", "edge_type", "dst_name")))
    score = retrieval.fused(cover, F.when(F.col("id") % 2 == 0, (F.col("id") % 100) / 100.0))
    return rows.select("id", score.alias("s")).where(F.col("s") >= retrieval.FLOOR).select("id", F.round("s", 4).alias("score"))
