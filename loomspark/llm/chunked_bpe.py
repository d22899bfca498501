"""BPE encoding and decoding with content-defined chunks: what documents share is encoded once.

1. Texts are cut where a rolling hash of the last 16 bytes is strictly least among its neighbours within REACH bytes on either
   side. The rule reads nothing but those bytes, so equal passages have equal cuts wherever they stand, and no chunk is shorter
   than REACH but at a text's ends. Periodic text has no strict minimum and stays whole.
2. A chunk's name is half its SHA-256. Names that two rows or more hold are shared; the row of least key encodes each of them
   once, and its ids go to every row that holds it. What nobody shares is encoded where it stands.
3. A document is put together from runs of its own and borrowed chunks. A cut may lie anywhere, so each join is repaired: the
   words next to it are encoded again as one, once the ids that both sides have for these words agree with what the words give
   alone. Where they do not, more words are taken, up to the whole part. Words end at white space, which this kind of tokenizer
   drops and never merges across, so agreement there makes the ids those of the whole text.
4. Ids are decoded by table where the tokenizer has no decoder of its own, else by the library.

Names (16 bytes a chunk) and borrowed ids are shuffled, texts once and compressed. A passage that many documents share is one
row for each holder, in a join whose large partitions Spark splits. The list of chunks to encode is broadcast behind a count,
and shuffled beyond it.

Edge cases: null and empty texts have no ids and decode to an empty text; rows that repeat an id, or have none, are encoded
each; an empty table gives an empty result; long texts are read whole, cut in blocks and encoded in pieces; only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import SMALL_ROWS, keyed, staged
from loomspark.llm.packing import WordIds

#: Bytes that the rolling hash reads, and how far a cut's hash is the least on either side.
WINDOW, REACH = 16, 256
#: Bytes cut at once.
BLOCK = 4_000_000
BASE, MIX = 0x01000193, 0x9E3779B1
SPACES = b" \t\n\r\x0b\x0c"
_HIGH = np.uint32(0xFFFFFFFF)


def _minima(buf: np.ndarray, valid: np.ndarray, reach: int) -> np.ndarray:
    """Places whose hash is strictly the least within reach; buf has `reach` bytes or more of margin at both ends."""
    h, base = buf.astype(np.uint32), BASE
    for k in (1, 2, 4, 8):
        g = h.copy()
        g[k:] += h[:-k] * np.uint32(base)
        h, base = g, base * base & 0xFFFFFFFF
    h = (h ^ (h >> 16)) * np.uint32(MIX)
    h ^= h >> 15
    h[~valid] = _HIGH
    low, have = h, 1
    while have < reach:  # low[i]: least of `have` hashes from i on
        step = min(have, reach - have)
        more = low.copy()
        np.minimum(low[:-step], low[step:], out=more[:-step])
        low, have = more, have + step
    here = h[reach:-1]
    return reach + np.flatnonzero((here < low[reach + 1 :]) & (here < low[: -reach - 1]))


def _cut_small(texts: list[bytes], reach: int) -> list[list[int]]:
    starts, at = [], reach
    for t in texts:
        starts.append(at)
        at += len(t) + reach
    buf, valid = np.zeros(at + 1, np.uint8), np.zeros(at + 1, bool)
    for s, t in zip(starts, texts, strict=True):
        buf[s : s + len(t)] = np.frombuffer(t, np.uint8)
        valid[s + WINDOW - 1 : s + len(t)] = True
    ends = _minima(buf, valid, reach) + 1
    for _ in range(3):  # not within a character
        ends = ends + ((buf[ends] & 0xC0) == 0x80)
    which = np.searchsorted(starts, ends, "right") - 1
    out: list[list[int]] = [[] for _ in texts]
    for k, e in zip(which.tolist(), ends.tolist(), strict=True):
        out[k].append(e - starts[k])
    return out


def _cut_long(text: bytes, reach: int, block: int) -> list[int]:
    """By blocks, each with the margin that its hashes and minima read."""
    ends, margin = [], reach + WINDOW + 4
    for a in range(0, len(text), block):
        low = max(0, a - margin)
        (some,) = _cut_small([text[low : a + block + margin]], reach)
        # The minimum lies up to 3 bytes before the end of a character; a cut belongs to the block that its end lies in.
        ends += [low + e for e in some if a < low + e <= a + block]
    return ends


def cuts(texts: list[bytes], reach: int = REACH, block: int = BLOCK) -> list[list[int]]:
    """Ends of the chunks of each text; the last is its length."""
    out: list[list[int]] = [[] for _ in texts]
    some, size = [], 0
    for k, t in enumerate([*texts, b""]):
        if some and (k == len(texts) or size + len(t) > block):
            for i, ends in zip(some, _cut_small([texts[i] for i in some], reach), strict=True):
                out[i] = ends
            some, size = [], 0
        if k < len(texts):
            if len(t) > block:
                out[k] = _cut_long(t, reach, block)
            else:
                some.append(k)
                size += len(t) + reach
    return [[*(e for e in ends if e < len(t)), len(t)] if t else [] for ends, t in zip(out, texts, strict=True)]


def name(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def head_of(text: bytes, words: int = 1) -> bytes:
    """Up to the end of so many words, or all of the text."""
    at = 0
    for _ in range(words):
        while at < len(text) and text[at] in SPACES:
            at += 1
        found = [k for s in SPACES if (k := text.find(bytes([s]), at)) >= 0]
        at = min(found) if found else len(text)
    return text[:at]


def tail_of(text: bytes, words: int = 1) -> bytes:
    at = len(text)
    for _ in range(words):
        while at and text[at - 1] in SPACES:
            at -= 1
        at = max(text.rfind(bytes([s]), 0, at) for s in SPACES) + 1
    return text[at:]


def _agreeing(text: bytes, ids: bytes, encode: Callable[[bytes], bytes], side: Callable, same: Callable) -> tuple[bytes, bytes]:
    """The fewest words at a side of the text, doubling, whose own ids the text's ids have at that side."""
    words = 1
    while True:
        some = side(text, words)
        alone = ids if len(some) == len(text) else encode(some)
        if len(some) == len(text) or same(ids, alone):
            return some, alone
        words *= 2


def put_together(parts: list[tuple[bytes, bytes]], encode: Callable[[bytes], bytes]) -> bytes:
    """Ids of the parts' texts as one, from (text, ids alone) of each part; encode gives a text's ids."""
    out: list[bytes] = []
    last, last_ids = b"", b""  # the part before, and the ids of it that are not written yet
    open_word: list[bytes] = []  # text since the last white space where that began before the last part
    for text, ids in parts:
        if not text:
            continue
        cut_word = (open_word or last) and (open_word[-1] if open_word else last)[-1] not in SPACES and text[0] not in SPACES
        if not cut_word:
            if open_word:
                last_ids, open_word = encode(b"".join(open_word)), []
            out.append(last_ids)
            last, last_ids = text, ids
            continue
        if not open_word:
            tail, alone = _agreeing(last, last_ids, encode, tail_of, lambda a, b: a.endswith(b))
            out.append(last_ids[: len(last_ids) - len(alone)])
            open_word = [tail]
        head, alone = _agreeing(text, ids, encode, head_of, lambda a, b: a.startswith(b))
        open_word.append(head)
        if len(head) < len(text):  # the word ends here: encoded again as a whole, and the rest of the part stays
            out.append(encode(b"".join(open_word)))
            last, last_ids, open_word = text[len(head) :], ids[len(alone) :], []
    out.append(encode(b"".join(open_word)) if open_word else last_ids)
    return b"".join(out)


class Decoder:
    """Text of packed ids; one a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.table = json.load(f)["decoder"] is None and [(self.tokenizer.id_to_token(k) or "").encode() for k in range(self.tokenizer.get_vocab_size())]

    def __call__(self, ids: bytes) -> bytes:
        listed = np.frombuffer(ids, "<u4").tolist()
        if self.table:
            table = self.table
            return b" ".join([table[k] for k in listed])
        return self.tokenizer.decode(listed, skip_special_tokens=False).encode()


_WORD_IDS: dict[str, WordIds] = {}
_DECODERS: dict[str, Decoder] = {}


def _tools(tokenizer: str) -> tuple[WordIds, Decoder]:
    if tokenizer not in _WORD_IDS:
        _WORD_IDS[tokenizer], _DECODERS[tokenizer] = WordIds(tokenizer), Decoder(tokenizer)
    return _WORD_IDS[tokenizer], _DECODERS[tokenizer]


def _slices(batches: Iterator[pa.RecordBatch], most: int = 100) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            yield batch.slice(first, most)


def _chunks(raw: bytes, ends: list[int]) -> list[bytes]:
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct chunk names."""
    for batch in _slices(batches):
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        found = [list({name(c) for c in _chunks(t, e)}) for t, e in zip(texts, cuts(texts), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["row", "names"])


def _owned(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Ids of the chunks that a row is to encode for all."""
    ids_of, _ = _tools(tokenizer)
    for batch in _slices(batches):
        texts = [t or b"" for t in batch.column(0).to_pylist()]
        asked = {}
        for t, ends, owned in zip(texts, cuts(texts), batch.column(1).to_pylist(), strict=True):
            wanted = set(owned)
            asked.update((k, c) for c in _chunks(t, ends) if (k := name(c)) in wanted)
        ids = ids_of.many([c.decode() for c in asked.values()])
        yield pa.RecordBatch.from_arrays([pa.array(list(asked), pa.binary()), pa.array(ids, pa.binary())], names=["name", "ids"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = zstandard.ZstdCompressor(level=1)
    for batch in _slices(batches):
        packed = [coder.compress(t or b"") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["row", "id", "packed"])


def _parts(raw: bytes, ends: list[int], borrowed: dict[bytes, bytes]) -> list[tuple[bytes, bytes | None]]:
    """Borrowed chunks with their ids, and runs of other chunks without."""
    parts, a, begun = [], 0, 0
    for b in ends:
        ids = borrowed.get(name(raw[a:b])) if borrowed else None
        if ids is not None:
            if begun < a:
                parts.append((raw[begun:a], None))
            parts.append((raw[a:b], ids))
            begun = b
        a = b
    if begun < len(raw):
        parts.append((raw[begun:], None))
    return parts


def _assembled(batches: Iterator[pa.RecordBatch], tokenizer: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, packed text, borrowed names, borrowed ids)."""
    ids_of, decode = _tools(tokenizer)
    unpack = zstandard.ZstdDecompressor()
    for batch in _slices(batches):
        texts = [unpack.decompress(p) for p in batch.column(1).to_pylist()]
        lent = [dict(zip(k, v, strict=True)) if k else {} for k, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        listed = [_parts(*x) for x in zip(texts, cuts(texts), lent, strict=True)]
        # Everything that is surely encoded goes to the library at once: runs, and the words on both sides of a join.
        fresh = [t for parts in listed for t, ids in parts if ids is None]
        for parts in listed:
            for (left, _), (right, _) in zip(parts, parts[1:], strict=False):
                if left[-1] not in SPACES and right[0] not in SPACES:
                    tail, head = tail_of(left), head_of(right)
                    fresh += [tail, head, tail + head]
        known = dict(zip(fresh, ids_of.many([t.decode() for t in fresh]), strict=True))

        def encode(text: bytes, known: dict[bytes, bytes] = known) -> bytes:
            found = known.get(text)
            return ids_of(text.decode()) if found is None else found

        ids = [put_together([(t, known[t] if i is None else i) for t, i in parts], encode) for parts in listed]
        columns = [batch.column(0), pa.array(ids, pa.binary()), *[pa.array([decode(i) for i in ids], pa.binary()).cast(pa.string())] * decoded]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", *["decoded"] * decoded])


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The id, `ids` (packed little-endian 32-bit) and with decoded the text the ids give, of every row, for the tokenizer file at
    a path every executor has. The tokenizer must drop white space."""
    rows, key = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")), "id")
    rows = rows.select(F.col(key).alias("row"), "id", "text")
    names = staged(rows.select("row", "text").mapInArrow(_names, "row long, names array<binary>"), "names")
    places = names.select("row", F.explode("names").alias("name"))
    shared = staged(places.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("row")).where("rows > 1").select("name", "row"), "shared")
    owners = shared.groupBy("row").agg(F.collect_list("name").alias("owned"))
    owners = F.broadcast(owners) if shared.count() <= SMALL_ROWS else owners
    once = staged(rows.join(owners, "row").select("text", "owned").mapInArrow(lambda b: _owned(b, tokenizer), "name binary, ids binary"), "encoded")
    lent = places.join(once, "name").groupBy("row").agg(F.collect_list(F.struct("name", "ids")).alias("lent"))
    packed = rows.mapInArrow(_packed, "row long, id long, packed binary")
    met = packed.join(lent, "row", "left").select("id", "packed", F.col("lent.name").alias("names"), F.col("lent.ids").alias("ids"))
    out = met.mapInArrow(lambda b: _assembled(b, tokenizer, decoded), "id long, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def encoding_report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    both = encode_documents(docs, tokenizer, id_col, text_col, decoded=True)
    return both.select(id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
