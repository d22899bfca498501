"""SentencePiece token counts from pre-token frequencies, without materialising ids.

Two characters that stand next to each other in no piece of the vocabulary are never merged, so a text falls apart at every
such place into pre-tokens whose piece counts add up (runs of letters, of punctuation, single digits, with the space mark
before them):

1. one pass turns each block of documents into a dictionary of its distinct pre-tokens and, per document, a packed vector of
   (dictionary index, frequency); this is all that is kept of the texts;
2. dictionary entries are dealt by pre-token and sorted; each run of equal ones is encoded once, by the library, and the count
   goes back to every block that asked;
3. each block's counts meet its vectors, and a document's count is the dot product of the two.

Blocks are bounded in documents and dictionary entries, so no task gathers more than one block, and a frequent pre-token has
one row per block, however many documents hold it.

Edge cases: null and empty texts have no tokens; texts are read whole; repeated rows and repeated ids each give a row; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import drop_shuffles, staged

MARK = "▁"
#: Runs of spaces begin a pre-token; a line feed is one of its own.
PRE_TOKEN = re.compile(" +[^ \n]*|[^ \n]+|\n")
BLOCK_DOCS, BLOCK_WORDS, SLICE = 20_000, 400_000, 4096


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, the library's leading space mark included."""
    return PRE_TOKEN.findall(" " + text.replace(MARK, " ")) if text else []


def joined_pairs(model: str) -> set[tuple[str, str]]:
    """Neighbouring characters of the vocabulary's pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ordinary = (sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k)))
    return {pair for piece in ordinary for pair in zip(piece, piece[1:], strict=False)}


class Splitter:
    """Parts of a word that no merge connects."""

    def __init__(self, model: str):
        self.pairs, self.known = joined_pairs(model), {}

    def __call__(self, word: str) -> list[str]:
        if (found := self.known.get(word)) is None:
            marked = word.replace(" ", MARK)
            cuts = [0, *(k for k in range(1, len(marked)) if (marked[k - 1], marked[k]) not in self.pairs), len(marked)]
            found = [marked[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            if len(self.known) < 200_000 and len(word) < 64:
                self.known[word] = found
        return found


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane: the high planes are zeros and compress away."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class PieceCounter:
    """Piece counts of pre-tokens by the library; the processor is loaded once a process."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)

    def __call__(self, words: list[str]) -> list[int]:
        # A line feed before the word keeps the library's own leading mark away from it; both are taken off again.
        return [len(ids) - 2 for ids in self.sp.encode(["\n" + w.replace(MARK, " ") for w in words], num_threads=1)]


def _blocks(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    split = Splitter(model)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number, rows, words = 0, [], {}

    def flush() -> pa.RecordBatch:
        block, listed = (part << 32) + number, list(words)
        slices = [(block, None, None, None, None, i, listed[i : i + SLICE]) for i in range(0, len(listed), SLICE)]
        cols = list(zip(*[*((block, *r, None, None) for r in rows), *slices], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            freq: Counter = Counter()
            for word, n in Counter(pre_tokens(text)).items():
                for w in split(word):
                    freq[w] += n
            index = np.fromiter((words.setdefault(w, len(words)) for w in freq), np.int64, len(freq))
            order = np.argsort(index)
            counts = np.fromiter(freq.values(), np.int64, len(freq))[order]
            rows.append((doc_id, len(text.encode()), planes(np.diff(index[order], prepend=0)), planes(counts)))
            if len(rows) >= BLOCK_DOCS or len(words) >= BLOCK_WORDS:
                yield flush()
                number, rows, words = number + 1, [], {}
    if rows:
        yield flush()


_NAMES = ["block", "doc_id", "n_bytes", "steps", "counts", "base", "words"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.string())]
_SCHEMA = "block long, doc_id long, n_bytes long, steps binary, counts binary, base int, words array<string>"


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs, for the SentencePiece model file at a path every executor has."""
    spark = docs.sparkSession
    blocks = staged(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda batches: _blocks(batches, model), _SCHEMA), "blocks")
    drop_shuffles(spark)
    entries = blocks.where("words IS NOT NULL").select("block", "base", F.posexplode("words").alias("pos", "word")).select("word", "block", (F.col("base") + F.col("pos")).alias("at"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries come sorted; a pre-token that runs on into the next batch keeps its count."""
        counter, last, n = PieceCounter(model), None, 0
        for batch in batches:
            runs = batch.column(0).dictionary_encode()
            listed = runs.dictionary.to_pylist()
            fresh = listed[1:] if listed and listed[0] == last else listed
            counts = [n] * (len(listed) - len(fresh)) + [c for k in range(0, len(fresh), 2000) for c in counter(fresh[k : k + 2000])]
            if listed:
                last, n = listed[-1], counts[-1]
            pieces = np.array(counts, np.int64)[runs.indices.to_numpy(zero_copy_only=False)] if listed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(pieces)], names=["of", "at", "pieces"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    known = entries.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(count, "of long, at int, pieces long")

    def dot(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by_index = np.zeros(int(right["at"].max()) + 1 if len(right) else 0, np.int64)
        by_index[right["at"].to_numpy()] = right["pieces"].to_numpy()
        totals = [int(by_index[np.cumsum(from_planes(s).astype(np.int64))] @ from_planes(c).astype(np.int64)) if s else 0 for s, c in zip(left["steps"], left["counts"], strict=True)]
        return pd.DataFrame({"doc_id": left["doc_id"].astype("Int64"), "n_bytes": left["n_bytes"].astype("int64"), "n_tokens": np.array(totals, np.int64)})

    vectors = blocks.where("words IS NULL").select("block", "doc_id", "n_bytes", "steps", "counts")
    out = vectors.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(dot, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("doc_id", id_col)
