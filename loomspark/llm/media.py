"""Media columns: binary columns of progressive JPEG files, their tensors and features.

Edge cases: a null or empty text is one block of zeros; long texts become one large image; equal texts get equal files and
features; a file that cannot be decoded gives a null tensor and the reason, not a failed job; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import jpeg

#: Rows that are decoded before their results leave the worker.
ROWS = 200


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: the text's bytes as a progressive JPEG file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([jpeg.store(payload_of(t.as_py())) for t in some.column(1)], pa.binary())], names=["doc_id", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(write, "doc_id long, media binary").withColumnRenamed("doc_id", id_col)


def tensors(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """id, height, width, rgb (bytes, row by row, three a pixel) and error of each file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, m in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rgb = jpeg.decode(m.as_py() or b"").rgb()
                    row = (rgb.shape[0], rgb.shape[1], rgb.tobytes(), None)
                except (ValueError, IndexError, KeyError, TypeError, AttributeError, StopIteration) as e:
                    row = (None, None, None, str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.column(0).type), *[pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]], names=["id", "height", "width", "rgb", "error"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), media_col).mapInArrow(read, f"id {kind}, height int, width int, rgb binary, error string").withColumnRenamed("id", id_col)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored file back and tells both apart by their digests, with features of the tensor."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some, rows = batch.slice(at, ROWS), []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    media = jpeg.store(payload_of(text))
                    image = jpeg.decode(media)
                    back = jpeg.load(image)
                    rows.append((doc_id, len((text or "").encode("utf-8", "replace")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), jpeg.describe(image.rgb())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("doc_id", id_col)
