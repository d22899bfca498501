"""Lexical, vector and fused retrieval."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import tokens
from loomspark.functions.vectors import cosine, unit
from loomspark.session import staged

#: Weights of the fused score, its floor, and results kept by object type.
KEYWORD_WEIGHT, SEMANTIC_WEIGHT, FLOOR = 0.4, 0.6, 0.12
TYPE_LIMITS = {"claim": 5, "formula": 5, "procedure": 4, "concept": 4}


def keyword_coverage(query: Column, document: Column) -> Column:
    """Share of the query's distinct tokens that the document holds."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, document)) / F.size(q))


def fused(keyword: Column, semantic: Column) -> Column:
    """Weighted sum where there is a vector, else the keyword score alone."""
    return F.when(semantic.isNull(), keyword).otherwise(KEYWORD_WEIGHT * keyword + SEMANTIC_WEIGHT * semantic)


def cosine_top(rows: DataFrame, vector: str, query: list[float], k: int | None, ident: str, cut: int | None = None) -> DataFrame:
    """ident and cosine to a query vector, the k best first, ties by ident; without k all of them, in no order. Vectors of another
    dimension are skipped."""
    q = F.array(*[F.lit(float(x)) for x in (query[:cut] if cut else query)])
    v = F.slice(vector, 1, cut) if cut else F.col(vector)
    scored = rows.where(F.size(vector) == len(query)).select(ident, F.round(cosine(v, q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), ident).limit(k) if k else scored


#: Distinct query terms that are sent to the texts; more meet them in a shuffle.
MANY_TERMS = 1_000_000


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score of documents (doc_id, text) that hold a term of the queries (query_id, text).

    Texts are cut where they are read; only occurrences of the queries' terms go on, with their text's length beside them.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= MANY_TERMS else terms
    cut = docs.select("doc_id", tokens(F.col("text")).alias("__t"))
    corpus = cut.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("__t")).alias("avgdl"))
    each = cut.select("doc_id", F.size("__t").alias("dl"), F.explode("__t").alias("term")).join(terms, "term", "left_semi")
    wanted = staged(each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = asked.join(wanted.join(df, "term"), "term").crossJoin(F.broadcast(corpus))  # one row
    return scored.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


#: Candidates of a question by words and by vector, the likeness that is enough without a word, and what a memory's
#: status weighs where scores are equal.
LEXICAL_CANDIDATES, VECTOR_CANDIDATES, LIKE_ENOUGH = 64, 256, 0.80
AUTHORITY = {"candidate": 1, "confirmed": 3}


def memory_hits(memories: DataFrame, questions: DataFrame, most: int = 10) -> DataFrame:
    """(q, rank, id, score, authority): memories (id, text, status, vector) for questions (q, text, vector), a stated query set.

    Candidates are the LEXICAL_CANDIDATES memories that hold most of a question's words and the VECTOR_CANDIDATES nearest by vector
    (all rows are looked at). A candidate stays if it shares a word or is LIKE_ENOUGH, and if its fused score reaches the floor;
    without a vector on both sides the words decide alone. Order is by score, then authority, then id, all descending. Memories of
    another status than AUTHORITY's take no part; a question without text or vector goes by what it has.
    """
    from loomspark.operators.vector_index import exact_neighbours

    usable = memories.where(F.col("status").isin(*AUTHORITY))
    rank = F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv])[F.col("status")]
    asked = questions.select("q", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("words"))
    terms = asked.select("q", F.size("words").alias("n"), F.explode("words").alias("term"))
    held = usable.select("id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    shared = staged(held.join(terms, "term").groupBy("q", "id").agg((F.count(F.lit(1)) / F.first("n")).alias("lexical")), "shared")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lexical"), F.desc("id")))
    by_words = shared.withColumn("__p", place).where(F.col("__p") <= LEXICAL_CANDIDATES).select("q", "id")
    # Questions have numbers of their own below 0, so that none is taken for the memory of the same number.
    posed = questions.select((-1 - F.col("q")).alias("id"), "vector")
    near = staged(exact_neighbours(usable.select("id", "vector"), posed, VECTOR_CANDIDATES).select((-1 - F.col("id")).alias("q"), F.col("other").alias("id")), "near")
    pairs = by_words.unionByName(near).distinct().join(shared, ["q", "id"], "left")
    full = pairs.join(usable.select("id", rank.alias("authority"), F.col("vector").alias("__m")), "id").join(questions.select("q", F.col("vector").alias("__q")), "q")
    alike = F.when(F.col("__m").isNotNull() & F.col("__q").isNotNull(), F.round(cosine(F.col("__m"), F.col("__q")), 9))
    scored = full.select("q", "id", "authority", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), alike.alias("alike"))
    scored = scored.where((F.col("lexical") > 0) | (F.coalesce("alike", F.lit(0.0)) >= LIKE_ENOUGH)).withColumn("score", F.round(fused(F.col("lexical"), F.col("alike")), 6)).where(F.col("score") >= FLOOR)
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("authority"), F.desc("id")))
    return scored.withColumn("rank", order).where(F.col("rank") <= most).select("q", "rank", "id", "score", "authority")


def rank_fusion(rankings: DataFrame, k: int = 60) -> DataFrame:
    """doc_id and the sum of 1 / (k + rank) over lists (list_id, doc_id, score)."""
    w = Window.partitionBy("list_id").orderBy(F.desc("score"), "doc_id")
    return rankings.withColumn("rank", F.row_number().over(w)).groupBy("doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def mmr(candidates: DataFrame, keys: list[str], k: int, balance: float = 0.5) -> DataFrame:
    """Per key, k of the candidates (id, relevance, vector): each step takes the best of relevance less likeness to those taken.

    Candidates of a key are a top-n; they are ranked in one task.
    """

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["at"]).reset_index(drop=True)
        v = np.array(df["vector"].tolist(), float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        rel, near = df["relevance"].to_numpy(float), np.zeros(len(df))
        left, order = np.ones(len(df), bool), []
        while left.any() and len(order) < k:
            score = np.where(left, balance * rel - (1 - balance) * near, -np.inf)
            best = int(score.argmax())
            order.append(best)
            left[best] = False
            sims = v @ v[best]
            near = sims if len(order) == 1 else np.maximum(near, sims)
        out = df.iloc[order][[*keys, "id"]].copy()
        out["rank"] = np.arange(1, len(order) + 1)
        return out

    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(*keys).applyInPandas(pick, ", ".join(f"{c} {types[c]}" for c in [*keys, "id"]) + ", rank int")


def quota_fusion(hits: DataFrame, n: int) -> DataFrame:
    """Round robin over sub-queries of hits (query_id, id, relevance): an id joins the sub-query where it does best; ids without
    a score form the last group."""
    best = hits.withColumn("__rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("relevance").desc_nulls_last(), "query_id"))).where("__rn = 1").drop("__rn")
    grouped = best.withColumn("lane", F.when(F.col("relevance").isNull(), F.lit(None)).otherwise(F.col("query_id")))
    turn = F.row_number().over(Window.partitionBy("lane").orderBy(F.col("relevance").desc_nulls_last(), "id"))
    return grouped.withColumn("turn", turn).orderBy(F.col("lane").isNull(), "turn", "lane").limit(n).select("id", "lane", "turn", "relevance")


def per_type_top(scored: DataFrame, limits: dict[str, int] = TYPE_LIMITS, floor: float = FLOOR) -> DataFrame:
    """The best of each object type above the floor."""
    limit = reduce(lambda acc, x: acc.when(F.col("object_type") == x[0], x[1]), limits.items(), F.when(F.lit(False), 0)).otherwise(0)
    ranked = scored.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(Window.partitionBy("object_type").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= limit)


#: Query terms that are looked for in one pass over the texts.
FEW_TERMS = 1000


def trigram_recall(docs: DataFrame, terms: DataFrame, n: int = 3, few: int = FEW_TERMS) -> DataFrame:
    """(term, doc_id) where the text holds the term (of n characters or more), capitals and small letters being the same.

    Up to `few` terms are a query set: they are sent to the texts, and one scan answers all. More terms meet the texts by an
    n-gram each, cut from a text in one pass; texts travel only to confirm what shares a gram.
    """
    asked = terms.where(F.length("term") >= n).select("term", F.lower("term").alias("__asked")).distinct()
    texts = docs.select("doc_id", F.lower("text").alias("__text"))
    if len(asked.limit(few + 1).take(few + 1)) <= few:
        return texts.join(F.broadcast(asked), F.contains("__text", "__asked")).select("term", "doc_id")
    grams = F.array_distinct(F.regexp_extract_all("__text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    by_gram = asked.withColumn("gram", F.left("__asked", F.lit(n)))
    listed = texts.select("doc_id", F.explode(grams).alias("gram")).join(by_gram, "gram").select("doc_id", "term", "__asked")
    return listed.join(texts, "doc_id").where(F.contains("__text", "__asked")).select("term", "doc_id").distinct()


#: Rows of a block of `knn_pairs`; two blocks meet in a task.
BLOCK_ROWS = 4000


def knn_pairs(rows: DataFrame, k: int, least: float, blocks: int | None = None) -> DataFrame:
    """Unordered pairs (a, b, score) where one is among the other's k nearest rows (id, vector) at cosine `least` or more.

    Exact, block by block: every row is sent to the block pairs it takes part in and each pair of blocks is one matrix
    product, so a task holds two blocks and no pair is made that fails the bound. Without `blocks` there are as many as keep
    them at BLOCK_ROWS; `vector_index.synonym_edges` is the way for tables where all pairs are too many.
    """
    blocks = blocks or max(1, -(-rows.count() // BLOCK_ROWS))
    placed = rows.select("id", unit(F.col("vector")).alias("v"), F.pmod(F.hash("id"), F.lit(blocks)).alias("block"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least(x, F.col("block")).alias("p"), F.greatest(x, F.col("block")).alias("q")))
    dealt = placed.select("id", "v", "block", F.explode(cells).alias("cell")).select("cell.p", "cell.q", "id", "v", "block")

    def near(df: pd.DataFrame) -> pd.DataFrame:
        p, q = int(df["p"].iloc[0]), int(df["q"].iloc[0])
        left, right = df[df["block"] == p], df[df["block"] == q]
        out = []
        if len(left) and len(right):
            s = np.round(np.array(left["v"].tolist()) @ np.array(right["v"].tolist()).T, 9)
            a, b = left["id"].to_numpy(), right["id"].to_numpy()
            for m, x, y in ((s, a, b), (s.T, b, a)):
                i, j = np.nonzero((m >= least) & (x[:, None] != y[None, :]))
                found = pd.DataFrame({"id": x[i], "other": y[j], "score": m[i, j]})
                out.append(found.sort_values(["id", "score", "other"], ascending=[True, False, True]).groupby("id").head(k))
                if p == q:
                    break
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "score": []})

    kind = rows.schema["id"].dataType.simpleString()
    near_rows = dealt.groupBy("p", "q").applyInPandas(near, f"id {kind}, other {kind}, score double")
    best = near_rows.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("rn") <= k)
    return best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.round("score", 6).alias("score")).distinct()


def reserved_evidence(hits: DataFrame, n: int) -> DataFrame:
    """n of the hits (library, id, score): the best of every library first, the rest by score."""
    first = F.row_number().over(Window.partitionBy("library").orderBy(F.desc("score"), "id")) == 1
    return hits.withColumn("reserved", first).orderBy(F.desc("reserved"), F.desc("score"), "library", "id").limit(n)
