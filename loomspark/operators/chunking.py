"""Texts as elements, sections, chunks and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.segmentation import greedy_segments
from loomspark.session import staged


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, text, char_start of every line that is not blank."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "text"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).where(F.trim("text") != "")


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Typed blocks of Markdown texts, line by line runs: heading, list_item, table, code_block, image, blockquote, paragraph.

    Data-URI images and blank blocks are dropped. Offsets are code points into the text.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for ident, text in zip(df["doc_id"], df["text"], strict=True):
                out += [(ident, n, *b) for n, b in enumerate(_blocks(text or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "element_type", "line_start", "line_end", "char_start", "char_end", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, pos int, element_type string, line_start int, line_end int, char_start int, char_end int, text string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scan, schema)


def _kind(line: str) -> str:
    s = line.lstrip()
    if s.startswith("#") and s.lstrip("#")[:1] == " " and len(s) - len(s.lstrip("#")) <= 6:
        return "heading"
    if s.startswith("!["):
        return "image"
    if s.startswith("|"):
        return "table"
    if s.startswith(">"):
        return "blockquote"
    if s[:2] in ("- ", "* ", "+ ") or (s.split(". ")[0].isdigit() and ". " in s):
        return "list_item"
    return "paragraph"


def _blocks(text: str) -> Iterator[tuple]:
    at, run, fence = 0, None, False
    for n, line in enumerate([*text.split("\n"), None], 1):
        kind = None
        if line is not None:
            mark = line.lstrip().startswith("```")
            kind = "code_block" if fence or mark else _kind(line) if line.strip() else None
            fence = fence != mark
        if run and (kind != run[0] or kind in ("heading", "image", "list_item") or line is None):
            block = text[run[2] : run[4]]
            if not (run[0] == "image" and "](data:" in block):
                yield run[0], run[1], run[3], run[2], run[4], block
            run = None
        if kind:
            run = (kind, run[1] if run else n, run[2] if run else at, n, at + len(line))
        at += len(line or "") + 1


def section_paths(elements: DataFrame) -> DataFrame:
    """elements (doc_id, pos, element_type, text) with the breadcrumb of the heading they stand under.

    A numbered heading stands under the numbers it extends; one without a number under the last numbered chain.
    """
    title = F.trim(F.regexp_replace("text", r"^\s*#{1,6}\s+", ""))
    heading = F.col("element_type") == "heading"
    number = F.when(heading, F.nullif(F.regexp_extract(title, r"(?i)^(?:chapter|section)?\s*(\d+(?:\.\d+)*)\b", 1), F.lit("")))
    parts = F.split(number, r"\.")
    chain = F.when(number.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")), " > "))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chained = elements.withColumn("__chain", chain).withColumn("__held", F.last("__chain", True).over(w))
    own = F.when(heading, F.coalesce(F.col("__chain"), F.concat_ws(" > ", "__held", title)))
    return chained.withColumn("__own", own).withColumn("section_path", F.coalesce(F.last("__own", True).over(w), F.lit(""))).drop("__chain", "__held", "__own")


def chunks(elements: DataFrame, target: int = 600) -> DataFrame:
    """Neighbouring elements packed until `target` characters are reached; a heading begins a new chunk and names its section.

    doc_id, chunk, section_path, text, element_ids. A chunk's text begins with the last two parts of its section in brackets.
    Images and figures stay only where a `caption` column has one for them. Sections are told apart by window functions;
    within one, `segmentation` finds the chunks' ends from positions and sizes alone, and texts meet them once.
    """
    blank = F.lit(None).cast("string")
    rows = elements.select("doc_id", "pos", "element_type", F.trim(F.coalesce("text", F.lit(""))).alias("text"), *[(F.col(c) if c in elements.columns else blank).alias(c) for c in ("section_path", "caption")])
    in_order = Window.partitionBy("doc_id").orderBy("pos")
    heading = F.col("element_type") == "heading"
    named = lambda path: F.filter(F.transform(F.split(path, " > "), lambda part: F.trim(part)), lambda part: part != "")
    own = F.when(heading, F.when(F.size(named(F.coalesce("section_path", F.lit("")))) > 0, named("section_path")).otherwise(F.array("text")))
    placed = rows.withColumns({"section": F.sum(heading.cast("int")).over(in_order), "parts": F.coalesce(F.last(own, True).over(in_order), F.array().cast("array<string>"))})
    pictures = F.col("element_type").isin("image", "figure") & (F.coalesce("caption", F.lit("")) == "")
    body = placed.where(~heading & ~pictures & (F.col("text") != "")).select("doc_id", "section", "parts", "pos", "text", F.length("text").alias("size"))

    body = staged(body.withColumn("element", F.monotonically_increasing_id()), "body")
    places = greedy_segments(body.select("doc_id", "section", "pos", "element", "size"), ["doc_id", "section"], ["pos", "element"], "size", target=target)
    numbered = body.join(places.select("element", F.col("segment").alias("nth")), "element")
    packed = numbered.groupBy("doc_id", "section", "nth").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("items"))
    prefix = F.array_join(F.slice("parts", F.greatest(F.size("parts") - 1, F.lit(1)), F.lit(2)), " > ")
    text = F.array_join(F.transform("items", lambda x: x["text"]), "\n")
    return packed.select(
        "doc_id",
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "nth")) - 1).cast("int").alias("chunk"),
        F.array_join("parts", " > ").alias("section_path"),
        F.when(prefix == "", text).otherwise(F.concat(F.lit("["), prefix, F.lit("] "), text)).alias("text"),
        F.transform("items", lambda x: x["pos"].cast("string")).alias("element_ids"),
    )


def windows(docs: DataFrame, size: int = 9000, overlap: int = 450, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Overlapping character windows of each text: doc_id, window, char_start, char_end, text."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text_col) - overlap) / step), F.lit(1)).cast("int")
    spread = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    return spread.select("doc_id", "window", (F.col("window") * step).alias("char_start"), F.least(F.col("window") * step + size, F.length("text")).alias("char_end"), F.substr(F.col("text"), F.col("window") * step + 1, F.lit(size)).alias("text"))


def batches(candidates: DataFrame, key: str, order: list[str], most: int, chars: int) -> DataFrame:
    """Candidates (with `size` characters each) dealt to consecutive batches of at most `most` rows and `chars` characters; one that
    is longer is a batch of its own. No group has to fit a task."""
    return greedy_segments(candidates, [key], order, "size", most=most, chars=chars).withColumn("segment", F.col("segment").cast("int")).withColumnRenamed("segment", "batch")


def without_page_edges(elements: DataFrame, share: float = 0.5, pages: int = 3) -> DataFrame:
    """elements (doc_id, page, pos, text) without texts that stand first or last on at least `share` of a document's pages, their
    first occurrence excepted; documents under `pages` pages stay as they are."""
    w = Window.partitionBy("doc_id", "page")
    edge = elements.withColumn("__edge", (F.col("pos") == F.min("pos").over(w)) | (F.col("pos") == F.max("pos").over(w)))
    total = elements.groupBy("doc_id").agg(F.countDistinct("page").alias("__pages"))
    often = edge.where("__edge").groupBy("doc_id", "text").agg(F.countDistinct("page").alias("__on")).join(total, "doc_id").where((F.col("__pages") >= pages) & (F.col("__on") >= share * F.col("__pages")) & (F.col("__on") > 1)).select("doc_id", "text", F.lit(True).alias("__often"))
    marked = edge.join(often, ["doc_id", "text"], "left").withColumn("__drop", F.col("__edge") & F.coalesce("__often", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text", "__drop").orderBy("page", "pos"))
    return marked.withColumn("__nth", nth).where(~F.col("__drop") | (F.col("__nth") == 1)).drop("__edge", "__often", "__drop", "__nth")
