"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Texts are equal when they are identical after every run of ASCII white space has become one space. The work is layered so
that a long text moves as seldom as possible:

1. each text becomes a fixed-size card (64-bit fingerprint, byte length, SHA-256); only cards are shuffled and counted;
2. texts whose card key occurs once are settled without ever leaving their scan task;
3. the others are cut into content-defined chunks; each distinct chunk moves once and is verified: an identifier that turns
   out to stand for two different chunk texts is refused, and the texts that contain it are compared whole;
4. rows are equal when their ordered identifier lists are equal.

Edge cases: a null text counts as empty and equals other empty or null texts (a text of white space only becomes one space,
which is not empty); an empty table gives an empty result; rows that repeat an id each get an own row and share their kept
flag; extra columns are ignored, whatever their names; very long texts are chunked whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import keyed, staged, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
#: A chunk ends at the first punctuation mark after MIN_CHUNK code points, or after MAX_CHUNK of them.
MIN_CHUNK, MAX_CHUNK = 512, 4096
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:[.!?,;:]|\z)|.{{1,{MAX_CHUNK}}}"


def normalised(col: str) -> Column:
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a text, in order; they join to the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("h"), F.octet_length(chunk).alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    card = [F.xxhash64("norm").alias("fp"), F.octet_length("norm").alias("n_norm")]
    key = ["fp", "n_norm"]
    cards = staged(rows.select("id", *card, F.sha2("norm", 256).alias("sha"), F.transform(chunks(F.col("norm")), identifier).alias("recipe")), "cards")
    counts = cards.groupBy(*key).agg(F.count(F.lit(1)).alias("same_card"))
    single = cards.join(counts.where("same_card = 1"), key).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), "sha")

    shared = counts.where("same_card > 1").select(*key)
    again = rows.select("norm", *card).join(shared, key, "left_semi").select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    verified = again.select(identifier(F.col("chunk")).alias("ident"), "chunk").distinct()
    refused = verified.groupBy("ident").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("ident")
    # Cards whose recipe holds a refused identifier; as good as always none at all, and then no text is compared whole.
    listed = cards.join(counts.where("same_card > 1"), key).select("id", "sha", *key, "recipe", F.lit("").alias("whole"))
    doubtful = staged(listed.select(*key, F.explode("recipe").alias("ident")).join(refused, "ident", "left_semi").select(*key).distinct(), "doubtful")
    if not doubtful.isEmpty():
        whole = rows.select("id", "norm", *card).join(doubtful, key, "left_semi")
        whole = whole.select("id", F.sha2("norm", 256).alias("sha"), *key, F.array().cast("array<struct<h:bigint,n:int>>").alias("recipe"), F.col("norm").alias("whole"))
        listed = listed.join(doubtful, key, "left_anti").unionByName(whole)
    same = [*key, "recipe", "whole"]
    groups = listed.groupBy(*same).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    several = listed.join(groups, same).select("id", "keep_id", "size", "sha")
    return single.unionByName(several).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were: the row with the least id.

    Where ids repeat or are null, rows are told apart by a number of their own; of equal rows one stays, and one with an id if
    there is any.
    """
    rows, key = keyed(docs, id_col)
    if key == id_col:
        dropped = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("__dropped"))
    else:
        named = rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.col(key).alias("row")).alias("key"), F.col(text_col).alias("text"))
        dropped = exact_dedup(named, "key", "text").where(~F.col("kept")).select(F.col("key.row").alias("__dropped"))
    return rows.join(dropped, rows[key] == dropped["__dropped"], "left_anti").select(*docs.columns)
