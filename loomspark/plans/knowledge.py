"""Retrieval, graph, entity, evaluation and change queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions import vectors as V
from loomspark.operators import chunking, entities, evaluation, graph, mentions, modularity, relational, retrieval, section_lookup, vector_index
from loomspark.plans import shapes
from loomspark.plans.registry import query
from loomspark.plans.relations import _TYPED
from loomspark.session import shared_dir, table
from loomspark.streaming import changes, packages

_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query("r00_vector_top", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def r00(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cosine_top(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 10, "vec_id")


@query("f02_all_similarities", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cosine_top(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), None, "vec_id")


@query("r01_keyword_coverage", f"WITH q AS (SELECT {_WORDS.format('text')} AS w FROM benchmark WHERE item_id = 0) SELECT doc_id, round(len(list_intersect(w, {_WORDS.format('text')})) * 1.0 / len(w), 6) AS coverage FROM documents, q")
def r01(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").where("item_id = 0").select(T.tokens(F.col("text")).alias("q"))  # one row
    return table(spark, d, "documents").crossJoin(F.broadcast(asked)).select("doc_id", F.round(retrieval.keyword_coverage(F.col("q"), T.tokens(F.col("text"))), 6).alias("coverage"))


@query("r02_score_fusion", "WITH s AS (SELECT vec_id AS id, (vec_id * 37 % 101) / 100.0 AS kw, CASE WHEN label = 0 THEN NULL ELSE round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) END AS sem FROM embeddings) SELECT id, round(CASE WHEN sem IS NULL THEN kw ELSE 0.4 * kw + 0.6 * sem END, 4) AS score FROM s WHERE CASE WHEN sem IS NULL THEN kw ELSE 0.4 * kw + 0.6 * sem END >= 0.12")
def r02(spark: SparkSession, d: str) -> DataFrame:
    sims = retrieval.cosine_top(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), None, "vec_id")
    rows = table(spark, d, "embeddings").select("vec_id", "label").join(sims, "vec_id")
    score = retrieval.fused((F.col("vec_id") * 37 % 101) / 100.0, F.when(F.col("label") != 0, F.col("score")))
    return rows.select(F.col("vec_id").alias("id"), score.alias("s")).where(F.col("s") >= retrieval.FLOOR).select("id", F.round("s", 4).alias("score"))


@query("r04_object_semantic", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT label AS object_id, round(round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)), 6), 5) AS score FROM embeddings, q WHERE vec_id <> 0 GROUP BY 1")
def r04(spark: SparkSession, d: str) -> DataFrame:
    sims = retrieval.cosine_top(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), None, "vec_id")
    return table(spark, d, "embeddings").where("vec_id <> 0").join(sims, "vec_id").groupBy(F.col("label").alias("object_id")).agg(F.round(F.max("score"), 5).alias("score"))


@query("r05_per_type_top", shapes.with_("nodes") + ", s AS (SELECT id, object_type, (id * 7919 % 1000) / 1000.0 AS score FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.12) SELECT id, object_type, CAST(rank AS INT) AS rank FROM r WHERE rank <= CASE WHEN object_type IN ('claim', 'formula') THEN 5 ELSE 4 END")
def r05(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.per_type_top(shapes.nodes(spark, d).withColumn("score", (F.col("id") * 7919 % 1000) / 1000.0)).select("id", "object_type", "rank")


@query("r06_bm25", rf"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    dl AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS dl FROM documents), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark), s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), c GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 3) AS score FROM s""")
def r06(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), asked).withColumn("score", F.round("score", 3))


@query("r07_rank_fusion", "WITH l AS (SELECT event_type AS list_id, user_id AS doc_id, max(value) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, doc_id) AS rank FROM l) SELECT doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM r GROUP BY 1")
def r07(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "events").groupBy(F.col("event_type").alias("list_id"), F.col("user_id").alias("doc_id")).agg(F.max("value").alias("score"))
    return retrieval.rank_fusion(lists).withColumn("score", F.round("score", 8))


@query("r08_mmr")
def r08(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.cosine_top(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 50, "vec_id")
    cands = table(spark, d, "embeddings").join(top, "vec_id").select(F.lit(0).alias("query_id"), F.col("vec_id").alias("id"), F.col("score").alias("relevance"), F.col("embedding").alias("vector"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("at"))
    return retrieval.mmr(cands, ["query_id"], 10)


@query("r09_quota_fusion", """WITH h AS (SELECT event_type AS query_id, user_id AS id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE max(value) END AS relevance FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY relevance DESC NULLS LAST, query_id) AS rn FROM h), l AS (SELECT id, relevance, CASE WHEN relevance IS NULL THEN NULL ELSE query_id END AS lane FROM b WHERE rn = 1)
    SELECT id, lane, CAST(row_number() OVER (PARTITION BY lane ORDER BY relevance DESC NULLS LAST, id) AS INT) AS turn FROM l ORDER BY lane IS NULL, turn, lane LIMIT 40""")
def r09(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("id")).agg(F.max("value").alias("v"))
    hits = hits.select("query_id", "id", F.when(F.col("id") % 10 != 0, F.col("v")).alias("relevance"))
    return retrieval.quota_fusion(hits, 40).select("id", "lane", "turn")


_SECTIONS = r"""WITH c AS (SELECT conv_id * 1000 + turn AS id, role AS source_id, 'Book > ' || regexp_extract(text, '^(\S+)', 1) || CASE WHEN turn % 2 = 0 THEN '' ELSE ' > ' || regexp_extract(text, '(\S+)$', 1) END AS section_path, conv_id * 1000 + turn AS pos, text, turn % 7 = 6 AS navigation FROM conversations),
    u AS (SELECT * FROM c WHERE NOT navigation), t AS (SELECT item_id AS q, nth, unnest([regexp_extract(text, '^(\S+)', 1), regexp_extract(text, '(\w{6,})', 1)]) AS term FROM (SELECT *, 0 AS nth FROM benchmark)),
    a AS (SELECT DISTINCT q, term, CASE WHEN term = (SELECT regexp_extract(text, '^(\S+)', 1) FROM benchmark b WHERE b.item_id = q) THEN 1 ELSE 2 END AS nth FROM t WHERE term <> ''),
    h AS (SELECT q, term, nth, u.*, row_number() OVER (PARTITION BY q, term ORDER BY source_id, pos, id) AS n FROM a JOIN u ON contains(lower(text), lower(term)) QUALIFY n <= 50),
    p AS (SELECT *, string_split(section_path, ' > ') AS s FROM h),
    g AS (SELECT *, coalesce(list_filter([array_to_string(s[1:1], ' > '), array_to_string(s[1:2], ' > '), array_to_string(s[1:3], ' > ')], lambda x: contains(lower(x), lower(term)))[1], section_path) AS group_path FROM p),
    o AS (SELECT q, source_id, group_path, id, min([nth, n]) AS f FROM g GROUP BY 1, 2, 3, 4),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hits DESC, length(group_path), group_path, source_id) AS section FROM (SELECT q, source_id, group_path, count(*) AS hits FROM o GROUP BY 1, 2, 3)) WHERE section <= 3),
    k AS (SELECT b.*, EXISTS (SELECT 1 FROM a WHERE a.q = b.q AND contains(lower(group_path), lower(term))) AS named FROM b),
    l AS (SELECT q, section, k.source_id, group_path, id, pos AS x, 0 AS y FROM k JOIN u ON named AND u.source_id = k.source_id AND (section_path = group_path OR starts_with(section_path, group_path || ' > '))
          UNION ALL SELECT q, section, source_id, group_path, id, f[1], f[2] FROM k JOIN o USING (q, source_id, group_path) WHERE NOT named),
    m AS (SELECT *, row_number() OVER (PARTITION BY q, section ORDER BY x, y, id) AS place FROM l QUALIFY place <= 12),
    z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY section) = 1)
    SELECT q, section, place, id, z.source_id, group_path, round((SELECT count(DISTINCT lower(term)) FROM a WHERE a.q = z.q AND contains(lower(u.section_path || ' ' || u.text), lower(term))) / (SELECT count(DISTINCT lower(term)) FROM a WHERE a.q = z.q), 6) AS relevance FROM z JOIN u USING (id)"""


@query("r11_section_lookup", _SECTIONS)
def r11(spark: SparkSession, d: str) -> DataFrame:
    """Turns are chunks under breadcrumbs of their own words; each benchmark item asks for its first word and its first long one."""
    word = lambda pattern: F.regexp_extract("text", pattern, 1)
    deeper = F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit(" > "), word(r"(\S+)$")))
    at = F.col("conv_id") * 1000 + F.col("turn")
    chunks = table(spark, d, "conversations").select(at.alias("id"), F.col("role").alias("source_id"), F.concat(F.lit("Book > "), word(r"^(\S+)"), deeper).alias("section_path"), at.alias("pos"), "text", (F.col("turn") % 7 == 6).alias("navigation"))
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.posexplode(F.array_distinct(F.array(word(r"^(\S+)"), word(r"(\w{6,})")))).alias("nth", "term"))
    return section_lookup.lookup_sections(chunks, terms)


@query("r12_trigram_recall", "WITH t AS (SELECT unnest(['license', 'idiot', 'erster', 'clown']) AS term) SELECT term, doc_id FROM documents, t WHERE contains(lower(text), term)")
def r12(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([("license",), ("idiot",), ("erster",), ("clown",)], "term string")
    return retrieval.trigram_recall(table(spark, d, "documents").select("doc_id", "text"), terms)


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))"


@query("r13_memory_hybrid", f"""WITH m AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, {_TOKENS} AS words, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 1 END AS authority FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 5 <> 4),
    q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS v, {_TOKENS} AS words FROM embeddings JOIN benchmark ON item_id = vec_id // 100 WHERE vec_id % 100 = 0),
    l AS (SELECT q, id, authority, coalesce(len(list_intersect(q.words, m.words)), 0) / len(q.words) AS lexical, round(list_cosine_similarity(q.v, m.v), 9) AS alike FROM q, m),
    w AS (SELECT q, id FROM l WHERE lexical > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY lexical DESC, id DESC) <= 64),
    n AS (SELECT q, id FROM l QUALIFY row_number() OVER (PARTITION BY q ORDER BY alike DESC, id) <= 256),
    s AS (SELECT l.*, round(0.4 * lexical + 0.6 * alike, 6) AS score FROM l JOIN (SELECT * FROM w UNION SELECT * FROM n) USING (q, id) WHERE lexical > 0 OR alike >= 0.8)
    SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, authority DESC, id DESC) AS rank, id, score, authority FROM s WHERE score >= 0.12 QUALIFY rank <= 10""")
def r13(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and the documents of their number are memories; benchmark items ask, with the vector of a hundred times their number."""
    v, text = table(spark, d, "embeddings"), table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    status = F.when(F.col("vec_id") % 5 == 4, "void").when(F.col("vec_id") % 3 == 0, "confirmed").otherwise("candidate")
    memories = v.join(text, "vec_id", "left").select(F.col("vec_id").alias("id"), "text", status.alias("status"), F.col("embedding").alias("vector"))
    items = table(spark, d, "benchmark").select((F.col("item_id") * 100).alias("vec_id"), "text")
    return retrieval.memory_hits(memories, v.join(items, "vec_id").select(F.col("vec_id").alias("q"), "text", F.col("embedding").alias("vector")))


@query("r15_participants", "SELECT s_suppkey, n_regionkey AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) ORDER BY n_regionkey, s_suppkey")
def r15(spark: SparkSession, d: str) -> DataFrame:
    scope = table(spark, d, "nation").where("n_regionkey IN (1, 3)").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("place"))
    return table(spark, d, "supplier").join(scope, "s_nationkey").select("s_suppkey", "place").orderBy("place", "s_suppkey")


@query("r17_protected_enrichment", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND o_totalprice <= 400000")
def r17(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    baseline = orders.where("o_totalprice > 400000").select("o_orderkey")
    proposal = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select("o_orderkey")
    return baseline.unionByName(relational.missing(proposal, baseline, ["o_orderkey"]))


@query("r18_manifest", "SELECT o_orderstatus, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
def r18(spark: SparkSession, d: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    return table(spark, d, "orders").where("o_totalprice > 300000").groupBy("o_orderstatus").agg(F.sha2(F.array_join(listed, ","), 256).alias("digest"))


@query("r20_chunk_cell_bridge", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS c FROM embeddings, q ORDER BY c DESC, vec_id LIMIT 60) SELECT label AS cell, round(max(c), 5) AS score FROM s GROUP BY 1")
def r20(spark: SparkSession, d: str) -> DataFrame:
    q = list(table(spark, d, "embeddings").where("vec_id = 1").select("embedding").first()[0])
    top = retrieval.cosine_top(table(spark, d, "embeddings"), "embedding", q, 60, "vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cell")).join(top, "vec_id").groupBy("cell").agg(F.round(F.max("score"), 5).alias("score"))


@query("r21_find_sources", "SELECT p_partkey, contains(lower(p_name), 'red') AS by_name, contains(lower(p_brand), 'brand#1') AS by_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'brand#1')")
def r21(spark: SparkSession, d: str) -> DataFrame:
    leg = lambda c, term, name: table(spark, d, "part").where(F.contains(F.lower(c), F.lit(term))).select("p_partkey", F.lit(name).alias("leg"))
    legs = leg("p_name", "red", "name").unionByName(leg("p_brand", "brand#1", "brand"))
    return legs.groupBy("p_partkey").agg(F.bool_or(F.col("leg") == "name").alias("by_name"), F.bool_or(F.col("leg") == "brand").alias("by_brand"))


@query("r22_unique_title", "SELECT p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) ') GROUP BY 1 HAVING count(*) < 40")
def r22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_name").rlike("^(red|blue) ")).groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n < 40").select("p_name")


@query("r25_evidence_budget", "WITH u AS (SELECT doc_id, source, substr(text, 1, 1200) AS t FROM documents), r AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM u) SELECT doc_id, length(substr(t, 1, CAST(6000 - used AS INT))) AS clipped FROM r WHERE used < 6000")
def r25(spark: SparkSession, d: str) -> DataFrame:
    return relational.running_budget(table(spark, d, "documents").select("doc_id", "source", "text"), ["source"], ["doc_id"], "text", 1200, 6000).select("doc_id", F.length("text").alias("clipped"))


@query("k01_ranking_graph", shapes.with_("relations") + "SELECT u, v, CAST(arg_min(weight, id) AS DOUBLE) AS weight FROM (SELECT id, weight, src AS u, dst AS v FROM relations WHERE src <> dst UNION ALL SELECT id, weight, dst, src FROM relations WHERE src <> dst) GROUP BY 1, 2")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return graph.ranking_graph(shapes.relations(spark, d))


def _rounds(n: int) -> str:
    out = []
    for k in range(n):
        out.append(f"m{k} AS (SELECT e.v AS id, sum(share * score) AS m FROM shares e JOIN s{k} ON s{k}.id = e.u GROUP BY 1), s{k + 1} AS (SELECT id, sum(p) AS score FROM (SELECT id, 0.5 * m AS p FROM m{k} UNION ALL SELECT id, r * (1 - 0.5 * (SELECT coalesce(sum(m), 0) FROM m{k})) FROM reset) GROUP BY 1)")
    return ", ".join(out)


@query("k02_personalized_rank", shapes.with_("relations") + ", one AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(weight, id) AS weight FROM relations WHERE src <> dst GROUP BY 1, 2), e AS (SELECT lo AS u, hi AS v, weight FROM one UNION ALL SELECT hi, lo, weight FROM one), shares AS (SELECT u, v, weight / sum(weight) OVER (PARTITION BY u) AS share FROM e), reset AS (SELECT p_partkey AS id, 1.0 / count(*) OVER () AS r FROM part WHERE p_partkey < 5), s0 AS (SELECT id, r AS score FROM reset), " + _rounds(4) + " SELECT id, round(score, 6) AS score FROM s4")
def k02(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.ranking_graph(shapes.relations(spark, d))
    seeds = shapes.nodes(spark, d).where("id < 5").select("id", F.lit(1.0).alias("weight"))
    return graph.personalized_rank(edges, seeds, rounds=4).withColumn("score", F.round("score", 6))


@query("k03_rank_to_tolerance", shapes.with_("nodes", "relations") + ", one AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(weight, id) AS weight FROM relations WHERE src <> dst AND status <> 'rejected' GROUP BY 1, 2), e AS (SELECT lo AS u, hi AS v, weight FROM one UNION ALL SELECT hi, lo, weight FROM one), shares AS MATERIALIZED (SELECT u, v, weight / sum(weight) OVER (PARTITION BY u) AS share FROM e), reset AS MATERIALIZED (SELECT id, 1.0 / count(*) OVER () AS r FROM nodes WHERE id % 50 = 0), s0 AS (SELECT id, r AS score FROM reset), "
       + _rounds(34).replace(" AS (", " AS MATERIALIZED (") + ", c AS (SELECT n.id, coalesce(s.score, 0) AS s FROM nodes n LEFT JOIN s34 s ON s.id = n.id WHERE object_type = 'claim') SELECT id, round((s - (SELECT min(s) FROM c)) / ((SELECT max(s) FROM c) - (SELECT min(s) FROM c)), 5) AS score FROM c")
def k03(spark: SparkSession, d: str) -> DataFrame:
    """Claims are passages; every fiftieth node is a seed."""
    nodes = shapes.nodes(spark, d)
    edges = graph.ranking_graph(shapes.relations(spark, d).where("status <> 'rejected'"))
    ranks = graph.push_rank(edges, nodes.where("id % 50 = 0").select("id", F.lit(1.0).alias("weight")), tolerance=1e-9)
    return graph.passage_scores(ranks, nodes.where("object_type = 'claim'")).withColumn("score", F.round("score", 5))


@query("k06_bounded_search", shapes.with_("relations") + ", f AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_type, id) AS rn FROM relations) WHERE rn <= 3), h0 AS (SELECT 7 AS id), h1 AS (SELECT DISTINCT dst AS id FROM f JOIN h0 ON src = id WHERE dst NOT IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT dst AS id FROM f JOIN h1 ON src = id WHERE dst NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1)) SELECT CAST(id AS BIGINT) AS id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2")
def k06(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(7,)], "id long")
    return graph.bounded_search(shapes.relations(spark, d), start, 2, 3)


@query("k07_one_hop", shapes.with_("relations") + "SELECT id, count(*) AS touching FROM (SELECT dst AS id FROM relations WHERE src < 3 UNION ALL SELECT src FROM relations WHERE dst < 3) GROUP BY 1")
def k07(spark: SparkSession, d: str) -> DataFrame:
    start = shapes.nodes(spark, d).where("id < 3").select("id")
    return graph.one_hop(shapes.relations(spark, d), start)


_CHAIN = shapes.with_("relations") + ", u AS (SELECT edge_type, src, dst, max(round(confidence * CASE status WHEN 'verified' THEN 1.0 ELSE 0.9 END * CASE tier WHEN 'base' THEN 1.0 ELSE 0.85 END, 6)) AS hop FROM relations WHERE edge_type IN ('derived_from', 'kind_of', 'part_of', 'precedes', 'prerequisite_of') AND status <> 'rejected' AND quote <> '' AND src <> dst GROUP BY 1, 2, 3), t AS (SELECT x.edge_type, x.src AS a, x.dst AS b, y.dst AS c, round(least(x.hop, y.hop) * 0.9, 6) AS trust FROM u x JOIN u y ON x.edge_type = y.edge_type AND x.dst = y.src AND x.src <> y.dst), ok AS (SELECT * FROM t WHERE trust >= 0.5 AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.edge_type = t.edge_type AND r.src = t.a AND r.dst = t.c)) "


@query("k08_follow_chains", _CHAIN + "SELECT edge_type, a, c, max(trust) AS trust, count(*) AS ways FROM ok GROUP BY 1, 2, 3")
def k08(spark: SparkSession, d: str) -> DataFrame:
    return graph.chains(shapes.relations(spark, d)).select("edge_type", "a", "c", "trust", "ways")


@query("y04_strongest_chains", _CHAIN + "SELECT edge_type, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY edge_type, a, c ORDER BY trust DESC, b) AS rn FROM ok) WHERE rn = 1 ORDER BY trust DESC, edge_type, a, c LIMIT 50")
def y04(spark: SparkSession, d: str) -> DataFrame:
    return graph.chains(shapes.relations(spark, d)).orderBy(F.desc("trust"), "edge_type", "a", "c").limit(50).select("edge_type", "a", "b", "c")


@query("k09_variant_stars", "SELECT a, p_partkey AS b, base FROM (SELECT p_partkey, lower(p_name) AS base, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS a FROM part) WHERE p_partkey <> a")
def k09(spark: SparkSession, d: str) -> DataFrame:
    return entities.variant_stars(shapes.nodes(spark, d).withColumn("name", F.concat("name", F.lit(" v"), F.col("p_size").cast("string"))))


@query("k11_relink")
def k11(spark: SparkSession, d: str) -> DataFrame:
    pairs = entities.shared_elements(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("element_id"), F.col("l_partkey").alias("id")))
    both = pairs.select("source_id", F.col("a").alias("id"), F.col("b").alias("other"), "overlap").unionByName(pairs.select("source_id", F.col("b").alias("id"), F.col("a").alias("other"), "overlap"))
    n = shapes.nodes(spark, d).select(F.col("id").alias("other"), (F.col("object_type") == "concept").alias("is_concept"), F.length("name").alias("name_length"))
    isolated = both.select("source_id", "id").distinct()
    return entities.relinked(isolated, both.join(n, "other").select("source_id", "id", "other", "overlap", "is_concept", "name_length"))


@query("k13_canonicalised", shapes.with_("nodes", "relations") + ", c AS (SELECT id, min(id) OVER (PARTITION BY object_type, name) AS canonical FROM nodes) SELECT DISTINCT a.canonical AS src, b.canonical AS dst, edge_type FROM relations JOIN c a ON a.id = src JOIN c b ON b.id = dst WHERE a.canonical <> b.canonical")
def k13(spark: SparkSession, d: str) -> DataFrame:
    n = shapes.nodes(spark, d).withColumn("mentions", F.lit(1))
    return entities.canonicalised(n, shapes.relations(spark, d), ["object_type", "name"])[1]


@query("k14_seed_clusters", shapes.with_("nodes") + "SELECT id, min(id) OVER (PARTITION BY object_type, lower(replace(name, ' ', ''))) AS canonical, count(*) OVER (PARTITION BY object_type, lower(replace(name, ' ', ''))) AS members FROM nodes")
def k14(spark: SparkSession, d: str) -> DataFrame:
    return entities.seed_clusters(shapes.nodes(spark, d))


@query("k15_communities")
def k15(spark: SparkSession, d: str) -> DataFrame:
    return modularity.communities(graph.ranking_graph(shapes.relations(spark, d)))


@query("k15_label_propagation")
def k15_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.ranking_graph(shapes.relations(spark, d)), rounds=6)


_ONE = "one AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(weight, id) AS weight FROM relations WHERE src <> dst GROUP BY 1, 2), e AS (SELECT lo AS u, hi AS v, weight FROM one UNION ALL SELECT hi, lo, weight FROM one)"


@query("k16_community_peers", shapes.with_("nodes", "relations") + f""", {_ONE}, c AS (SELECT n.id, n.name, n.p_size AS community, coalesce(w, 0)::DOUBLE AS w FROM nodes n LEFT JOIN (SELECT u, sum(weight) AS w FROM e GROUP BY 1) x ON x.u = n.id),
    f AS (SELECT p_partkey AS q, lower(p_name) AS key, list_distinct(['rank', split_part(p_name, ' ', 2), 'like']) AS asked FROM part WHERE p_partkey % 100 = 0),
    r AS (SELECT q, asked, c.id AS focal, community FROM f JOIN c ON lower(c.name) = key QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, c.id) = 1),
    s AS (SELECT q, c.id, c.name, w, round(len(list_filter(asked, lambda x: list_contains(string_split(lower(c.name), ' '), x))) / len(asked) * w, 6) AS score FROM r JOIN c ON c.community = r.community AND c.id <> r.focal)
    SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, w DESC, id) AS rank, id, name, score FROM s QUALIFY rank <= 8""")
def k16(spark: SparkSession, d: str) -> DataFrame:
    nodes = shapes.nodes(spark, d)
    query_ = F.concat(F.lit("Rank: "), F.split("p_name", " ")[1], F.lit(" like"))
    focals = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("name"), query_.alias("query"))
    return modularity.community_peers(nodes, nodes.select("id", F.col("p_size").alias("community")), graph.ranking_graph(shapes.relations(spark, d)), focals)


@query("k19_symmetric_ends", shapes.with_("relations") + "SELECT id, CASE WHEN edge_type = 'contrasts_with' AND dst < src THEN dst ELSE src END AS a, CASE WHEN edge_type = 'contrasts_with' AND dst < src THEN src ELSE dst END AS b FROM relations")
def k19(spark: SparkSession, d: str) -> DataFrame:
    a, b = graph.canonical_ends(F.col("edge_type"), F.col("src"), F.col("dst"))
    return shapes.relations(spark, d).select("id", a.alias("a"), b.alias("b"))


@query("b10_edge_validity", _TYPED + "SELECT id, valid, src_type IS NULL OR dst_type IS NULL OR valid AS queryable FROM checked")
def b10(spark: SparkSession, d: str) -> DataFrame:
    return graph.validity(graph.with_types(shapes.relations(spark, d), shapes.nodes(spark, d))).select("id", "valid", "queryable")


@query("k20_finding_zones", shapes.with_("relations") + "SELECT dst AS subject, CASE WHEN bool_or(status = 'rejected' AND tier = 'base') THEN 'dismissed' WHEN bool_or(status = 'verified') THEN 'decided' WHEN count(*) > 40 THEN 'relinked' ELSE 'open' END AS zone FROM relations GROUP BY 1")
def k20(spark: SparkSession, d: str) -> DataFrame:
    r = shapes.relations(spark, d).groupBy(F.col("dst").alias("subject")).agg(F.bool_or((F.col("status") == "rejected") & (F.col("tier") == "base")).alias("no"), F.bool_or(F.col("status") == "verified").alias("yes"), F.count(F.lit(1)).alias("n"))
    return r.select("subject", F.when(F.col("no"), "dismissed").when(F.col("yes"), "decided").when(F.col("n") > 40, "relinked").otherwise("open").alias("zone"))


@query("y05_canonical_relations", shapes.with_("nodes", "relations") + ", c AS (SELECT id, min(id) OVER (PARTITION BY object_type, name) AS canonical FROM nodes), m AS (SELECT r.id, edge_type, source_id, coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst FROM relations r LEFT JOIN c a ON a.id = src LEFT JOIN c b ON b.id = dst WHERE status <> 'rejected') SELECT src, edge_type, dst, count(*) AS support_count, greatest(count(DISTINCT source_id), 1) AS source_count, min(id) AS first_id FROM m WHERE src <> dst GROUP BY 1, 2, 3")
def y05(spark: SparkSession, d: str) -> DataFrame:
    n = shapes.nodes(spark, d)
    clusters = n.join(n.groupBy("object_type", "name").agg(F.min("id").alias("canonical")), ["object_type", "name"])
    return graph.canonical_relations(shapes.relations(spark, d), clusters).select("src", "edge_type", "dst", "support_count", "source_count", F.col("sample_ids")[0].alias("first_id"))


#: Names of things: every part's, and a phrase and an abbreviation from each benchmark item, which documents do hold.
_NAMED = r"""n AS (SELECT p_partkey AS id, lower(p_name) AS alias FROM part UNION ALL
    SELECT 1000000 + item_id, unnest([lower(regexp_extract(text, '^(\S+ \S+)', 1)), lower(regexp_extract(text, '([A-Za-z]{3,8})\W*$', 1))]) FROM benchmark),
    a AS (SELECT DISTINCT id, alias FROM n WHERE length(alias) >= 3)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    phrase, last = F.regexp_extract("text", r"^(\S+ \S+)", 1), F.regexp_extract("text", r"([A-Za-z]{3,8})\W*$", 1)
    items = table(spark, d, "benchmark").select((F.lit(1000000) + F.col("item_id")).alias("id"), F.explode(F.array(phrase, last)).alias("alias"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("alias")).unionByName(items).where(F.length("alias") >= 3)


_HITS = rf"WITH {_NAMED}, u AS (SELECT DISTINCT alias FROM a), t AS (SELECT doc_id AS text_id, lower(text) AS text FROM documents), h AS (SELECT text_id, alias FROM t, u WHERE contains(text, alias) AND regexp_matches(text, '(^|[^a-zA-Z0-9])' || regexp_escape(alias) || '($|[^a-zA-Z0-9])'))"


@query("y06_mention_edges", _HITS + ", g AS (SELECT alias FROM h GROUP BY 1 HAVING count(*) > greatest(5, 0.02 * (SELECT count(*) FROM documents))) SELECT DISTINCT text_id, id FROM h JOIN a USING (alias) WHERE alias NOT IN (SELECT alias FROM g)")
def y06(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return mentions.mention_edges(_named(spark, d), texts, share=0.02, floor=5)


_BRIDGE = r"""WITH c AS (SELECT item_id % 20 AS id, item_id % 3 AS source_id, regexp_extract(text, '^(\S+ \S+)', 1) AS head, upper(regexp_extract(text, '([A-Za-z]{3,8})\W*$', 1)) AS short FROM benchmark),
    k AS (SELECT id FROM c GROUP BY 1 HAVING count(DISTINCT source_id) >= 2),
    a AS (SELECT DISTINCT id, alias FROM (SELECT id, lower(head) AS alias FROM c WHERE length(head) >= 4 UNION ALL SELECT id, lower(short) FROM c WHERE short <> '') WHERE id IN (SELECT id FROM k)),
    t AS (SELECT conv_id * 1000 + turn AS text_id, lower(text) AS text FROM conversations), u AS (SELECT DISTINCT alias FROM a),
    h AS (SELECT DISTINCT text_id, alias FROM t, u WHERE contains(text, alias) AND regexp_matches(text, '(^|[^a-zA-Z0-9])' || regexp_escape(alias) || '($|[^a-zA-Z0-9])')),
    g AS (SELECT alias FROM h GROUP BY 1 HAVING count(*) > greatest(20, 0.02 * (SELECT count(*) FROM conversations))),
    e AS (SELECT DISTINCT text_id, id FROM h JOIN a USING (alias) WHERE alias NOT IN (SELECT alias FROM g))"""


@query("k17_mention_bridge", _BRIDGE + " SELECT x.id AS a, y.id AS b, count(*) AS together FROM e x JOIN e y ON x.text_id = y.text_id AND x.id < y.id GROUP BY 1, 2")
def k17(spark: SparkSession, d: str) -> DataFrame:
    head, short = F.regexp_extract("text", r"^(\S+ \S+)", 1), F.upper(F.regexp_extract("text", r"([A-Za-z]{3,8})\W*$", 1))
    named = F.when(short == "", head).otherwise(F.concat(head, F.lit(" ("), short, F.lit(")")))
    concepts = table(spark, d, "benchmark").select((F.col("item_id") % 20).alias("id"), named.alias("name"), (F.col("item_id") % 3).alias("source_id"))
    claims = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    return mentions.mention_bridge(concepts, claims, 0.02, 20)[1]


@query("y07_co_mentions", "WITH m AS (SELECT DISTINCT l_orderkey AS text_id, l_suppkey AS id FROM lineitem), f AS (SELECT text_id FROM m GROUP BY 1 HAVING count(*) <= 6) SELECT x.id AS a, y.id AS b, count(*) AS together FROM m x JOIN m y ON x.text_id = y.text_id AND x.id < y.id WHERE x.text_id IN (SELECT text_id FROM f) GROUP BY 1, 2")
def y07(spark: SparkSession, d: str) -> DataFrame:
    return entities.co_mentions(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("text_id"), F.col("l_suppkey").alias("id")).distinct(), 6)


@query("y08_sibling_peers", "WITH m AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS id FROM lineitem), p AS (SELECT x.id, y.id AS peer, count(*) AS n FROM m x JOIN m y ON x.t = y.t AND x.id <> y.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, peer) AS rn FROM p WHERE n >= 2) SELECT id, peer, n AS together FROM r WHERE rn <= 8")
def y08(spark: SparkSession, d: str) -> DataFrame:
    pairs = entities.co_mentions(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("text_id"), F.col("l_suppkey").alias("id")).distinct(), 1000).where("together >= 2")
    sides = pairs.select(F.col("a").alias("id"), F.col("b").alias("peer"), "together").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("peer"), "together"))
    return relational.latest(sides, ["id"], F.desc("together"), F.col("peer"), keep=8)


@query("y09_conflicts", shapes.with_("relations") + ", r AS (SELECT id, src, edge_type, dst FROM relations) SELECT 'shared_pair_diff_edge' AS kind, x.id AS id1, y.id AS id2 FROM r x JOIN r y ON x.src = y.src AND x.dst = y.dst AND x.edge_type <> y.edge_type AND x.id < y.id UNION ALL SELECT 'shared_head', x.id, y.id FROM r x JOIN r y ON x.src = y.src AND x.edge_type = y.edge_type AND x.dst <> y.dst AND x.id < y.id UNION ALL SELECT 'shared_tail', x.id, y.id FROM r x JOIN r y ON x.dst = y.dst AND x.edge_type = y.edge_type AND x.src <> y.src AND x.id < y.id")
def y09(spark: SparkSession, d: str) -> DataFrame:
    return entities.structural_conflicts(shapes.relations(spark, d))


@query("y10_contrasts", "SELECT DISTINCT x.p_name AS a_name, y.p_name AS b_name FROM part x JOIN part y ON split_part(x.p_name, ' ', 2) = split_part(y.p_name, ' ', 2) AND x.p_partkey < y.p_partkey AND ((split_part(x.p_name, ' ', 1) = 'red' AND split_part(y.p_name, ' ', 1) = 'blue') OR (split_part(x.p_name, ' ', 1) = 'blue' AND split_part(y.p_name, ' ', 1) = 'red'))")
def y10(spark: SparkSession, d: str) -> DataFrame:
    first_two = F.array(*[F.split_part("name", F.lit(" "), F.lit(k)) for k in (1, 2)])
    return entities.contrast_conflicts(shapes.nodes(spark, d).select("id", "name"), [("red", "blue")], first_two, 0).select("a_name", "b_name")


@query("y12_duplicates", shapes.with_("nodes") + "SELECT object_type, lower(replace(name, ' ', '')) AS seed, count(*) AS n, min(id) AS first FROM nodes GROUP BY 1, 2 HAVING count(*) > 1")
def y12(spark: SparkSession, d: str) -> DataFrame:
    return shapes.nodes(spark, d).groupBy("object_type", T.seed_v2(F.col("name"), False).alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")


@query("y13_source_totals", "SELECT owner, sum(n) AS n FROM (SELECT c_nationkey AS owner, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < -900) GROUP BY 1) GROUP BY 1")
def y13(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").where("o_orderstatus <> 'P'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    gone = table(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("s_nationkey"))
    kept = table(spark, d, "supplier").join(gone, "s_nationkey", "left_anti").groupBy(F.col("s_nationkey").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    return live.unionByName(kept).groupBy("owner").agg(F.sum("n").cast("double").alias("n"))


@query("y14_usage_signals", "SELECT user_id, max(event_id) AS last_seen, round(sum(value), 2) AS amount, count(CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 1 END) AS recent, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY 1")
def y14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_seen"), F.round(F.sum("value"), 2).alias("amount"), F.count_if(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).alias("recent"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("y15_metadata_states", "SELECT source, count(CASE WHEN l.quality IS NOT NULL AND l.quality = 1 THEN 1 END) AS has_meta, count(CASE WHEN l.quality = 0 THEN 1 END) AS marker, count(CASE WHEN l.quality IS NULL THEN 1 END) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def y15(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality")
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count_if(q == 1).alias("has_meta"), F.count_if(q == 0).alias("marker"), F.count_if(q.isNull()).alias("missing"))


@query("y16_enumeration", "SELECT count(*) AS known, least(count(*), 1250) AS returned, CASE WHEN count(*) > 1250 THEN 'row_cap' ELSE 'complete' END AS reason FROM part")
def y16(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, d, "part").agg(n.alias("known"), F.least(n, F.lit(1250)).alias("returned"), F.when(n > 1250, "row_cap").otherwise("complete").alias("reason"))


@query("y18_isolated_penalty", shapes.with_("nodes", "relations") + ", g AS (SELECT DISTINCT src AS id FROM relations UNION SELECT DISTINCT dst FROM relations) SELECT n.id, round((n.id * 7919 % 1000) / 1000.0 * CASE WHEN g.id IS NULL THEN 0.8 ELSE 1.0 END, 6) AS score FROM nodes n LEFT JOIN g ON g.id = n.id")
def y18(spark: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(shapes.relations(spark, d))
    return shapes.nodes(spark, d).join(deg, "id", "left").select("id", F.round((F.col("id") * 7919 % 1000) / 1000.0 * F.when(F.col("degree").isNull(), 0.8).otherwise(1.0), 6).alias("score"))


@query("y19_lane_interleave", "WITH l AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events WHERE event_type IN ('view', 'error')) SELECT event_id, turn FROM l ORDER BY turn, event_type = 'error' DESC")
def y19(spark: SparkSession, d: str) -> DataFrame:
    lanes = table(spark, d, "events").where("event_type IN ('view', 'error')")
    return relational.round_robin(lanes, "event_type", ["event_id"], [F.desc(F.col("event_type") == "error")]).select("event_id", "turn")


_RUN = "SELECT user_id AS query_id, event_id AS id, value AS score FROM events"


@query("v01_recall_mrr_ndcg", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_RUN})), g AS (SELECT user_id AS query_id, event_id AS id FROM events WHERE event_type = 'purchase'), h AS (SELECT query_id, count(CASE WHEN rank <= 10 THEN 1 END) AS found, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM r JOIN g USING (query_id, id) GROUP BY 1), w AS (SELECT query_id, count(*) AS want FROM g GROUP BY 1) SELECT query_id, round(coalesce(found * 1.0 / want, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= want), 0), 6) AS ndcg FROM w LEFT JOIN h USING (query_id)")
def v01(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"), "event_type")
    return evaluation.retrieval_measures(ev.drop("event_type"), ev.where("event_type = 'purchase'").select("query_id", "id"), 10)


@query("v03_precision_recall", "WITH c AS (SELECT user_id, count(CASE WHEN event_type = 'click' AND value > 40 THEN 1 END) AS tp, count(CASE WHEN value > 40 THEN 1 END) AS np, count(CASE WHEN event_type = 'click' THEN 1 END) AS ng FROM events GROUP BY 1), m AS (SELECT user_id, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE tp / np END AS p, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS r FROM c) SELECT user_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m")
def v03(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "click") & (F.col("value") > 40)).alias("tp"), F.count_if(F.col("value") > 40).alias("np"), F.count_if(F.col("event_type") == "click").alias("ng"))
    p, r, f = evaluation.precision_recall(F.col("tp"), F.col("np"), F.col("ng"))
    return c.select("user_id", p.alias("precision"), r.alias("recall"), f.alias("f1"))


@query("v05_weighted_total", "SELECT round(0.2 * count(CASE WHEN quality = 1 THEN 1 END) / count(*) + 0.8 * (1 - count(CASE WHEN toxic = 1 THEN 1 END) * 1.0 / count(*)), 6) AS total FROM labels")
def v05(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, d, "labels").agg(F.round(0.2 * F.count_if(F.col("quality") == 1) / n + 0.8 * (1 - F.count_if(F.col("toxic") == 1) / n), 6).alias("total"))


@query("v06_truncation_overlap")
def v06(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    cut_to = lambda ident, cut: rows.select(F.col("vec_id").alias(ident), V.truncated(F.col("embedding"), cut).alias("vector"))
    queries = lambda cut: cut_to("query_id", cut).where("query_id % 100 = 0")  # noqa: E731  a stated query set against all rows
    sims = lambda cut: vector_index.nearest(cut_to("id", cut), queries(cut), 10)
    return evaluation.topk_overlap(sims(64), sims(16), 10)


@query("v08_density_gate", shapes.with_("relations") + "SELECT tier, count(*) * 1.0 / count(DISTINCT src) >= 1.5 AS dense, round(count(CASE WHEN edge_type = 'composed_of' THEN 1 END) * 1.0 / count(*), 6) AS compound FROM relations GROUP BY 1")
def v08(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return shapes.relations(spark, d).groupBy("tier").agg((n / F.countDistinct("src") >= 1.5).alias("dense"), F.round(F.count_if(F.col("edge_type") == "composed_of") / n, 6).alias("compound"))


@query("v09_replay", "SELECT user_id AS query_id, user_id % 4 <> 0 AS same FROM (SELECT DISTINCT user_id FROM events)")
def v09(spark: SparkSession, d: str) -> DataFrame:
    run = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return evaluation.replayed(run, run.withColumn("score", F.when(F.col("query_id") % 4 == 0, F.col("score") + 1).otherwise(F.col("score"))))


@query("x01_majority", "SELECT source, lang FROM (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS tot FROM documents GROUP BY 1, 2) WHERE n >= 0.5 * tot AND tot >= 10")
def x01(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("tot", F.sum("n").over(Window.partitionBy("source")))
    return votes.where("n >= 0.5 * tot AND tot >= 10").select("source", "lang")


@query("x02_closed_fields", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def x02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("x04_window_counts", "SELECT conv_id, count(CASE WHEN turn BETWEEN 1 AND 3 THEN 1 END) AS shown, count(CASE WHEN turn < 1 THEN 1 END) AS earlier, count(CASE WHEN turn > 3 THEN 1 END) AS fresh FROM conversations GROUP BY 1")
def x04(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(t.between(1, 3)).alias("shown"), F.count_if(t < 1).alias("earlier"), F.count_if(t > 3).alias("fresh"))


@query("x05_folded_roles", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1")
def x05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("x06_orphans", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def x06(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return relational.missing(c.select("conv_id").distinct(), c.where("role = 'system'").select("conv_id"), ["conv_id"])


@query("x08_attestation", "SELECT doc_id AS id, CASE WHEN lang = 'es' THEN 'gone' WHEN lang = 'fr' THEN 'changed' ELSE 'same' END AS state FROM documents")
def x08(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    live = docs.where("lang <> 'es'").withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return entities.attested(docs.select("id", F.sha2("text", 256).alias("fingerprint")), live)


@query("x09_stripped_evidence", "SELECT l_orderkey, count(CASE WHEN l_suppkey >= 5 THEN 1 END) AS kept FROM lineitem GROUP BY 1")
def x09(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_linenumber")).alias("evidence"))
    return nested.select("l_orderkey", F.size(F.filter("evidence", lambda e: e["l_suppkey"] >= 5)).cast("long").alias("kept"))


@query("x11_preview")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("x12_patch_merge", "SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'patched' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def x12(spark: SparkSession, d: str) -> DataFrame:
    patch = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("patched").alias("patch"))
    return table(spark, d, "documents").select("doc_id", "source").join(patch, "doc_id", "left").select("doc_id", F.coalesce("patch", "source").alias("source"))


@query("x15_scale_class", "SELECT source, CASE WHEN sum(n_chars) > 200000 THEN 'index_required' ELSE 'copyable' END AS scale FROM documents GROUP BY 1")
def x15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.when(F.sum("n_chars") > 200000, "index_required").otherwise("copyable").alias("scale"))


@query("x18_page_edges")
def x18(spark: SparkSession, d: str) -> DataFrame:
    pages = shapes.elements(spark, d).withColumn("page", F.floor(F.col("pos") / 4))
    return chunking.without_page_edges(pages.select("doc_id", "page", "pos", "text")).select("doc_id", "page", "pos")


@query("w01_change_feed", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op FROM (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') a FULL OUTER JOIN (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW') b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus")
def w01(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = o.where("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    return relational.change_feed(o.where("o_orderstatus <> 'P'"), after, ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "op")


@query("w02_change_packages", """WITH e AS (SELECT user_id, event_id AS seq, event_type, value, event_type = 'view' AND event_id % 5 = 0 AS moved FROM events),
    x AS (SELECT user_id AS k, seq, CASE WHEN event_type = 'error' OR moved THEN NULL ELSE value END AS v FROM e UNION ALL SELECT user_id + 100000, seq, value FROM e WHERE moved),
    l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM x) SELECT seq, '{"user":"' || k || '"}' AS key, v AS value FROM l WHERE n = 1 AND v IS NOT NULL""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    """The events as a change log in three files: errors delete, every fifth view moves its user to another key."""
    at = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    named = lambda k: F.concat(F.lit('{"user": '), k.cast("string"), F.lit("}"))
    moved = (F.col("event_type") == "view") & (F.col("event_id") % 5 == 0)
    log = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("epoch"), F.lit("users").alias("table"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
        named(F.when(moved, F.col("user_id") + 100000).otherwise(F.col("user_id"))).alias("key"), F.when(moved, named(F.col("user_id"))).alias("old_key"),
        F.to_json(F.struct("value")).alias("row"), F.lit("nb").alias("owner"), F.lit(None).cast("string").alias("parent"),
    )
    log.repartition(3).write.parquet(f"{at}/in")
    packages.packaged(changes.followed(spark, f"{at}/in", packages.CHANGES), f"{at}/out", "home", f"{at}/checkpoint").awaitTermination()
    return packages.applied(spark, f"{at}/out", "users", "value double")


@query("w12_version_gate", "WITH n AS (SELECT count(*) AS n, max(event_id) AS seq FROM events) SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, true)) t(step, made), (SELECT n FROM n)")
def w12(spark: SparkSession, d: str) -> DataFrame:
    """One result asked for four times: as made, unchanged, after a change, and after a reset that brings the first number back."""
    store, events = f"{shared_dir(spark)}/versions/{uuid.uuid4().hex}", table(spark, d, "events")
    seq = events.agg(F.max("event_id")).head()[0]
    out = None
    for step, (epoch, at) in enumerate([(1, seq), (1, seq), (1, seq + 1), (2, seq)], 1):
        counts, made = packages.versioned(spark, store, "types", epoch, at, lambda: events.groupBy("event_type").count())
        one = counts.agg(F.sum("count").alias("n")).select(F.lit(step).alias("step"), F.lit(made).alias("made"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("w03_retention", "SELECT event_id FROM events WHERE event_id >= 300 OR ts >= TIMESTAMP '2024-01-25'")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return changes.retained(table(spark, d, "events"), "event_id", "ts", [500, None, 300, 900], "2024-01-25").select("event_id")


def _streamed(spark: SparkSession, d: str, build, mode: str = "complete") -> DataFrame:
    """Runs a stream over the events table to its end and returns the last state of its result, which each batch writes whole."""
    at, events = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}", table(spark, d, "events")
    events.write.parquet(f"{at}/in")
    numbers: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        numbers.append(number)

    stream = build(changes.followed(spark, f"{at}/in", events.schema.simpleString()[7:-1].replace(":", " ")))
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/batch={max(numbers)}")


@query("w08_stream_windows", "SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, lambda s: changes.tumbling(s, "ts", "1 day", "2 days", "event_type")).select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("w09_sessions")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return changes.sessions(table(spark, d, "events"), "ts", "3 hours", "user_id")


@query("w10_versioned_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def w10(spark: SparkSession, d: str) -> DataFrame:
    source = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    events.repartition(3).write.parquet(f"{source}/in")
    q = changes.upsert_into(changes.followed(spark, f"{source}/in", "user_id long, event_id long, event_type string"), f"{source}/out", ["user_id"], "event_id", f"{source}/checkpoint")
    q.awaitTermination()
    versions = spark.read.parquet(f"{source}/out")
    return versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).select("user_id", "event_id")
