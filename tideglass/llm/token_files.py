"""Token ids as Simple-8b coded files.

`encode_documents` tokenizes whole texts and writes Parquet rows, each one block of documents in
ascending doc_id order; `decode_documents` reads them back. A block's `words` hold 64-bit
little-endian words: the top 4 bits select how many ids of how many bits the other 60 hold.
Selector 15 is the escape: the next word holds one id of up to 64 bits as it is. `word_start` and
`id_start` give each document's first word and the number of its ids, so a reader can jump to any
document; every document begins at a word of its own, and all words of a block decode at once.

Defined results: a null text is written as an empty one (the end id alone); repeated doc_ids are
kept, ordered by text hash; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm._common import parallelism, text_bytes

#: The ids that selectors 0..13 hold in a word, and the bits of each; 14 is a single id of 60 bits, 15 the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 64])
ESCAPE = 15
#: The bits that ids under 2 ** 16 need.
_BITS = np.maximum(1, np.frexp(np.arange(1 << 16).astype(float))[1]).astype(np.int8)
#: Ids that a block gathers before it is written, and cached words of text.
BLOCK_IDS, CACHED = 1 << 16, 1 << 19
# --- Simple-8b ----------------------------------------------------------------------------------


def pack(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each run): ids (uint64) coded in runs that begin at starts, every run in words of its own.

    Each word takes the selector with the most ids that fit from its place on within the run.
    """
    n = len(ids)
    ends = np.r_[starts[1:], n]
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    if int(ids.max()) < 1 << 16:
        bits = _BITS[ids.astype(np.uint16)]
    else:
        low = ids & np.uint64((1 << 32) - 1)
        high = ids >> np.uint64(32)
        bits = np.where(high > 0, 32 + np.frexp(high.astype(float))[1], np.maximum(1, np.frexp(low.astype(float))[1])).astype(np.int8)
    room = np.minimum(np.repeat(ends, ends - starts) - np.arange(n), 60).astype(np.int8)  # ids left in the run
    selector = np.full(n, 13, np.int8)
    np.copyto(selector, ESCAPE, where=bits > 60)
    widest, span = np.full(n + 64, 127, np.int8), 1  # the most bits among the span ids from here on
    widest[:n] = bits
    for k in range(12, -1, -1):
        need, width = int(COUNTS[k]), int(WIDTHS[k])
        while span * 2 <= need:
            widest[:n] = np.maximum(widest[:n], widest[span : n + span])
            span *= 2
        fits = np.maximum(widest[:n], widest[need - span : n + need - span]) <= width
        fits &= room >= need
        if not fits.any():
            break  # a larger count of narrower ids fits only where this one does
        np.copyto(selector, k, where=fits)
    step = COUNTS.astype(np.uint8)[selector].tobytes()
    at, begun = 0, []
    while at < n:
        begun.append(at)
        at += step[at]
    first = np.array(begun)
    chosen = selector[first].astype(np.int64)
    size = 1 + (chosen == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    words[place[chosen == ESCAPE] + 1] = ids[first[chosen == ESCAPE]]
    for k in np.unique(chosen[chosen != ESCAPE]):
        of = chosen == k
        begin = first[of]
        value = ids[begin]
        for j in range(1, int(COUNTS[k])):
            value |= ids[begin + j] << np.uint64(j * int(WIDTHS[k]))
        words[place[of]] |= value
    return words, np.r_[place, len(words)][np.searchsorted(first, starts)]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids (uint64) of words, in order."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    code = np.ones(len(words), bool)  # false: the raw word after an escape
    for k in np.flatnonzero(selector == ESCAPE):
        if code[k] and k + 1 < len(words):
            code[k + 1] = False
    at = np.flatnonzero(code)
    chosen = selector[at]
    count = COUNTS[chosen]
    begin = np.cumsum(count) - count
    ids = np.zeros(int(count.sum()), np.uint64)
    for k in np.unique(chosen):
        of = chosen == k
        if k == ESCAPE:
            ids[begin[of]] = words[at[of] + 1]
            continue
        width, value = int(WIDTHS[k]), words[at[of]] & np.uint64((1 << 60) - 1)
        for j in range(int(COUNTS[k])):
            ids[begin[of] + j] = (value >> np.uint64(j * width)) & np.uint64((1 << width) - 1)
    return ids


# --- texts to ids -------------------------------------------------------------------------------


#: Of a tokenizer that may be asked word by word: it lower-cases, drops white space, and cuts words into these pieces.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: What a text may consist of to be lower-cased and cut into pieces here (ASCII and precomposed Latin letters,
#: which normalization leaves alone), and its pieces. Other texts are cut at white space only.
_LATIN = bytes([9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t\n\ra-z0-9\xdf-\xf6\xf8-\xff]+")
_SPACE = re.compile("[ \t\n\r]+")


def _is_latin(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _LATIN)
    except UnicodeEncodeError:
        return False


class Encoder:
    """Whole texts to ids by the tokenizers library.

    A tokenizer set up as _WORDWISE gives a text the ids of its pieces, so each distinct piece is asked
    for once and cached; other tokenizers, and texts that hold a special token's string, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        self.wordwise = all(setup[k] == v for k, v in _WORDWISE.items()) and setup["model"]["type"] == "BPE"
        self.model = self.tokenizer.model
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytewise = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in [*range(33, 127), *range(0xDF, 0x100)]}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        ids = self.model.tokenize
        return [b"".join([t.id.to_bytes(4, "little") for t in ids(p.translate(self.bytewise))]) for p in pieces]

    def _known(self, cache: dict[str, bytes], cut: list[list[str]], encode) -> dict[str, bytes]:
        """cache with all that the lists hold; it starts anew when it is full."""
        distinct = set().union(*cut)
        if len(cache) + len(distinct) > CACHED:
            cache.clear()
        new = list(distinct.difference(cache))
        cache.update(zip(new, encode(new)))
        return cache

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.wordwise:
            return self._encode(texts)
        whole = [any(s in t for s in self.special) for t in texts]
        latin = [not w and _is_latin(t) for t, w in zip(texts, whole)]
        cut = [[] if w else _PIECE.findall(t.lower()) if x else _SPACE.split(t) for t, w, x in zip(texts, whole, latin)]
        pieces = self._known(self.pieces, [c for c, x in zip(cut, latin) if x], self._pieces).__getitem__
        words = self._known(self.words, [c for c, x in zip(cut, latin) if not x], self._encode).__getitem__
        return [self._encode([t])[0] if w else b"".join(map(pieces if x else words, c)) for t, w, x, c in zip(texts, whole, latin, cut)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its cache stays."""
    return Encoder(path)


SCHEMA = "shard int, before bigint, n_ids bigint, doc_ids array<{id}>, word_start array<bigint>, id_start array<bigint>, words binary"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, shard = _encoder(path), TaskContext.get().partitionId()
    ids, coded, size, before = [], [], 0, 0
    end = np.array([end_id], "<u4").tobytes()

    def block() -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(coded), "<u4").astype(np.uint64)
        lengths = np.array([len(c) // 4 for c in coded], np.int64)
        starts = np.cumsum(lengths) - lengths
        words, first = pack(flat, starts)
        row = {"shard": shard, "before": before, "n_ids": len(flat), "doc_ids": ids, "word_start": first.tolist(), "id_start": starts.tolist(), "words": words.astype("<u8").tobytes()}
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [(t or b"").decode() for t in text_bytes(part, 1)]
            for doc_id, code in zip(part.column(0).to_pylist(), encoder(texts)):
                ids.append(doc_id)
                coded.append(code + end)
                size += len(code) // 4 + 1
                if size >= BLOCK_IDS:
                    yield block()
                    ids, coded, size, before = [], [], 0, before + size
    if ids:
        yield block()


def encode_documents(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Writes the ids of all texts, each followed by end_id, to folder, in ascending doc_id order over shards and blocks."""
    shards = shards or 2 * parallelism(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    id_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    cols = docs.select(F.col("doc_id").cast("bigint" if id_type == pa.int64() else "string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    cols = cols.withColumn("tie", F.xxhash64("text"))
    ordered = cols.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    run = partial(_encode, path=tokenizer, end_id=end_id, id_type=id_type)
    blocks = ordered.mapInArrow(run, SCHEMA.format(id=dict(cols.dtypes)["doc_id"]))
    blocks.write.option("compression", "zstd").parquet(folder)


def _decode(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            ids = unpack(np.frombuffer(row["words"], "<u8").astype(np.uint64)).astype("<u4")
            starts = np.array([*row["id_start"], len(ids)])
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip((4 * starts).tolist(), (4 * starts[1:]).tolist())]
            columns = [np.full(len(crcs), row["shard"], np.int32), row["doc_ids"], row["before"] + starts[:-1], np.diff(starts), crcs]
            types = [pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "doc_id", "within", "n_tokens", "ids_crc32"])


def decode_documents(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; start counts the ids of all documents before it.

    Only one row a shard (as many as partitions wrote) goes through the unpartitioned window and the broadcast.
    """
    blocks = spark.read.schema(SCHEMA.format(id=id_type)).parquet(folder)
    run = partial(_decode, id_type=pa.int64() if id_type == "bigint" else pa.string())
    docs = blocks.select("shard", "before", "doc_ids", "id_start", "words").mapInArrow(
        run, f"shard int, doc_id {id_type}, within bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shard_start"))
    return docs.join(F.broadcast(shards), "shard").select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
