"""Sources and sinks: routed files, grids, logs and portable rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parser names by file extension.
PARSERS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "zip": "bundle", "docx": "docx", "pptx": "pptx", "csv": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "xls": "xls"}


def parser_of(path: Column) -> Column:
    """Parser id by the extension of a path or URL; plain text for any other."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for e, p in PARSERS.items():
        out = F.when(ext == e, p).otherwise(out)
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with the parser each is routed to."""
    return spark.read.format("binaryFile").load(path).withColumn("parser", parser_of(F.col("path")))


def first_parsed(*candidates: Column) -> Column:
    """The result of the first engine in order that gave one."""
    return F.coalesce(*candidates)


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (plain or gzip) with the source file; what cannot be read is kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_file", F.input_file_name())


def tail(df: DataFrame, seq: str, n: int, since: int | None = None, before: int | None = None) -> DataFrame:
    """The last n rows between two positions, newest first."""
    if since is not None:
        df = df.where(F.col(seq) > since)
    if before is not None:
        df = df.where(F.col(seq) < before)
    return df.orderBy(F.desc(seq)).limit(n)


@F.pandas_udf(StringType())
def _gbk(s: pd.Series) -> pd.Series:
    """A charset the JVM functions refuse."""
    return s.map(lambda b: bytes(b).decode("gbk", "replace"), na_action="ignore")


def decoded_text(content: Column) -> Column:
    """UTF-8 with or without a mark, else GBK."""
    return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(_gbk(content)), r"^\x{FEFF}", "")


def csv_grid(spark: SparkSession, path: str) -> DataFrame:
    """A CSV grid: ragged rows padded or cut, blank rows dropped; a blank or repeated heading is an error."""
    head = spark.read.text(path).limit(1).collect()
    names = [c.strip().strip('"') for c in head[0][0].lstrip("\ufeff").split(",")] if head else []
    if not names or "" in names or len(set(names)) < len(names):
        raise ValueError("a grid needs distinct headings that are not blank")
    grid = spark.read.option("mode", "PERMISSIVE").option("header", "true").schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return grid.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names]).isNotNull())


def pipe_rows(docs: DataFrame, text: str) -> DataFrame:
    """Rows of Markdown pipe tables: line number and cells; alignment rows go, <br> is a line end, an escaped pipe is text."""
    lines = docs.select("*", F.posexplode(F.split(text, "\n")).alias("line", "row")).where(F.trim("row").rlike(r"^\|.*\|$|.\|.") & ~F.trim("row").rlike(r"^\|?[\s:|-]+\|?$"))
    inner = F.regexp_replace(F.trim("row"), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.regexp_replace(F.replace(F.trim(c), F.lit("\\|"), F.lit("|")), r"(?i)<br\s*/?>", "\n"))
    return lines.withColumn("cells", cells).drop("row")


def _sheet(content: bytes) -> list[list[str]]:
    """Cells of the first sheet of a workbook, merged ranges filled with their first cell."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(space + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(space + "si")]
        root = ElementTree.fromstring(z.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))

    def place(ref: str) -> tuple[int, int]:
        letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
        col = 0
        for ch in letters:
            col = col * 26 + ord(ch) - 64
        return int(digits) - 1, col - 1

    cells: dict[tuple[int, int], str] = {}
    for c in root.iter(space + "c"):
        v, t = c.find(space + "v"), c.get("t")
        text = "".join(x.text or "" for x in c.iter(space + "t")) if t == "inlineStr" else "" if v is None else shared[int(v.text)] if t == "s" else v.text or ""
        cells[place(c.get("r"))] = text
    for m in root.iter(space + "mergeCell"):
        (r1, c1), (r2, c2) = map(place, m.get("ref").split(":"))
        for r in range(r1, r2 + 1):
            for k in range(c1, c2 + 1):
                cells[r, k] = cells.get((r1, c1), "")
    high, wide = (max((k[i] for k in cells), default=-1) + 1 for i in (0, 1))
    return [[cells.get((r, k), "") for k in range(wide)] for r in range(high)]


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of the first sheet of workbooks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for p, content in zip(df["path"], df["content"], strict=True):
                rows = _sheet(content)
                yield pd.DataFrame({"path": [p] * len(rows), "row": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row int, cells array<string>")


def portable(df: DataFrame) -> DataFrame:
    """Rows as JSON text with columns in the order of their names; bytes become {"$bytes": base64}; nulls are kept."""
    binary = {f.name for f in df.schema if f.dataType.simpleString() == "binary"}
    cols = [F.when(F.col(c).isNotNull(), F.struct(F.base64(c).alias("$bytes"))).alias(c) if c in binary else F.col(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_portable(df: DataFrame, path: str) -> None:
    portable(df).write.mode("overwrite").text(path)


def partitioned(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df written by key folders and read back; filters on the keys then prune folders."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)
