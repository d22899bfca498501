"""The opN_ queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import chunked_bpe, divergence, exact_dedup, media, near_join, packing, pieces, pii, quality, ranked_search, repeats, token_counts, toxicity
from loomspark.llm.common import table

PIECE_MODEL, WORD_MODEL = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_report(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_MODEL)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", (F.col("toxic") * (1 - F.col("quality"))).alias("toxic_junk"))
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), labels, ["toxic_junk", "toxic"])
    return scored.withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_documents(table(spark, sf_dir, "documents"), labels, ~quality.held_out())
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encoding_report(table(spark, sf_dir, "documents"), WORD_MODEL)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_ngram_join": op4_ngram_join,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
    "op11_ranked_search": op11_ranked_search,
    "op12_bpe_encoding": op12_bpe_encoding,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
    "op11_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
             sized AS (SELECT doc_id, words, len(words) AS n FROM d WHERE len(words) > 0),
             stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
             uses AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM sized) GROUP BY ALL),
             df AS (SELECT term, count(*) AS df FROM uses GROUP BY term),
             w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, stats),
             asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
             scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
                        FROM asked JOIN uses USING (term) JOIN w USING (term), stats GROUP BY item_id, doc_id),
             ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             groups AS (SELECT DISTINCT lang, source FROM d),
             w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
             langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n_lang FROM kept GROUP BY lang),
             used AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
             totals AS (SELECT lang, source, sum(n)::HUGEINT AS n_group FROM used GROUP BY lang, source),
             dense AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS count,
                              1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (coalesce(t.n_group, 0) + l.v) AS p,
                              1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n_lang + l.v) AS q
                       FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
                       LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
                       LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
             sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
                      FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
                       FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                       LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
             terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM dense WHERE count > 0 AND p > q),
             ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
                        UNION ALL
                        SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
        SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
