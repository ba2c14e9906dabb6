"""Token ids of whole texts in fixed-width bit-packed blocks, written and read by Spark.

Format: a Parquet table with one row per block.  A block holds whole documents, about
``BLOCK_IDS`` ids or one longer document: ``part`` and ``block`` (its place), ``first`` (ids
of the part before it), ``n_ids``, ``bits`` (width of an id), ``doc_ids``, ``ends`` (place
after each document's last id, counted in ids from the block's start) and ``payload``, all
ids of the block with the most significant bit first.  Id number i lies at bit ``i * bits``,
so any range is read without what stands before it.  Parts ascend by doc_id.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.worker_memory import remember_for
from gaugeline.sources.files import work_dir

BLOCK_IDS = 16_384
END_ID = 1
#: Pieces remembered by a Python worker, and characters encoded at a time.
REMEMBERED, CHARACTERS = 1_000_000, 1 << 18
#: Texts of these characters only are cut into pieces by our own code: ASCII and Latin
#: letters, for which every Unicode version agrees on letters, digits, spaces and case.
PLAIN = re.compile("[\t\n\r -~¡-įı-ſ]*")
#: A tokenizer's splitting pattern and, for lower-case texts of ``PLAIN``, an equal one that
#: names the letters and digits of that range.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _DIGITS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
PLAIN_WORDS = re.compile(
    rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+"
)


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (max(vocabulary, END_ID + 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    parts = []
    for start in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        piece = ids[start : start + (1 << 16)].astype(np.uint32)
        parts.append(np.packbits(((piece[:, None] >> shifts) & 1).astype(np.uint8)).tobytes())
    return b"".join(parts)


def unpack(payload, bits: int, start: int = 0, count: int = 0) -> np.ndarray:
    """``count`` ids from id number ``start`` on."""
    first, last = start * bits, (start + count) * bits
    raw = np.frombuffer(payload, np.uint8)[first // 8 : -(-last // 8)]
    found = np.unpackbits(raw)[first % 8 : first % 8 + count * bits].reshape(count, bits)
    ids = np.zeros(count, np.uint32)
    for column in range(bits):
        ids = (ids << np.uint32(1)) | found[:, column]
    return ids


class Encoder:
    """A tokenizer that remembers the ids of pieces.

    When the tokenizer lower-cases, drops white space and splits by a pattern, a text's ids
    are those of its pieces in order; each distinct piece is encoded once.  Other tokenizers
    and texts beyond ``PLAIN`` are encoded as a whole.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[str, bytes] = {}
        self.special = [x["content"] for x in json.loads(definition).get("added_tokens") or ()]
        self.pattern = self._pattern(json.loads(definition))

    @staticmethod
    def _pattern(definition: dict):
        steps = [x["type"] for x in (definition.get("normalizer") or {}).get("normalizers", ())]
        split = (definition.get("pre_tokenizer") or {}).get("pretokenizers", ())
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"]:
            return None
        by, level = split
        neat = by["behavior"] == "Removed" and by["invert"] and "Regex" in by["pattern"]
        if not neat or level["add_prefix_space"] or level["use_regex"] or definition["model"]["type"] != "BPE":
            return None
        known = by["pattern"]["Regex"] == WORDS
        return PLAIN_WORDS if known else regex.compile(by["pattern"]["Regex"])

    def _pieces(self, text: str) -> list[str] | None:
        if self.pattern is None or not PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return None
        return self.pattern.findall(text.lower())

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [self._pieces(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in set().union(*(c for c in cut if c)) if p not in self.known]
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(found.ids, np.uint32).tobytes()
        for text, pieces in zip(texts, cut, strict=True):
            if pieces is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint32)

    def encode(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= CHARACTERS:
                yield from self._some(waiting)
                waiting, size = [], 0
        yield from self._some(waiting)


_encoders: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    remember_for("token files", _encoders.clear)
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


BLOCKS = (
    "part int, block bigint, first bigint, n_ids bigint, bits int, doc_ids array<bigint>, "
    "ends array<bigint>, payload binary"
)


def _writer(shared, bits: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        part = TaskContext.get().partitionId()
        block = first = 0
        doc_ids, pieces, ends = [], [], [0]

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            row = (part, block, first, len(ids), bits, doc_ids, ends[1:], pack(ids, bits))
            kinds = (
                pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                pa.list_(pa.int64()), pa.binary(),
            )
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names=names
            )

        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                doc_ids.append(doc_id)
                pieces.append(np.append(ids, np.uint32(END_ID)))
                ends.append(ends[-1] + len(pieces[-1]))
                if ends[-1] >= BLOCK_IDS:
                    yield flush()
                    block, first = block + 1, first + ends[-1]
                    doc_ids, pieces, ends = [], [], [0]
        if doc_ids:
            yield flush()

    return write


def write_blocks(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode (doc_id, text) of every row and write blocks to a new ``path``.

    A null text is empty and has the end id only.  Rows are in ascending order of doc_id,
    null first; rows of one id in the order of their texts' hash and then their texts.
    Other columns are not read; an empty table writes no block.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    vocabulary = Encoder(definition).tokenizer.get_vocab_size()
    shared = spark.sparkContext.broadcast(definition)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    keys = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text")
    ordered.mapInArrow(_writer(shared, width(vocabulary)), BLOCKS).write.parquet(path)


def _with_start(blocks: DataFrame) -> DataFrame:
    """Blocks with the ids of the whole table before them; one small row per part is broadcast."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("first"))


def _documents(blocks: DataFrame, make, column: str, kind: pa.DataType, spark_kind: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, bits, doc_ids, ends = (batch.column(k)[i].as_py() for k in range(4))
                if not doc_ids:
                    continue
                ids = unpack(batch.column(4)[i].as_buffer(), bits, 0, ends[-1])
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([start + b for b in begins], pa.int64()),
                        pa.array([e - b for b, e in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([make(ids[b:e]) for b, e in zip(begins, ends, strict=True)], kind),
                    ],
                    names=["doc_id", "start", "n_tokens", column],
                )

    chosen = _with_start(blocks).select("start", "bits", "doc_ids", "ends", "payload")
    return chosen.mapInArrow(
        read, f"doc_id bigint, start bigint, n_tokens bigint, {column} {spark_kind}"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the blocks."""
    return _documents(spark.read.parquet(path), lambda x: x.tolist(), "ids", pa.list_(pa.int64()), "array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as 32-bit integers."""
    return _documents(
        spark.read.parquet(path), lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32",
        pa.int64(), "bigint",
    )


def read_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of the whole table on; reads the blocks that hold them only."""
    rows = _with_start(spark.read.parquet(path)).where(
        (F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start)
    )
    pieces = [np.zeros(0, np.uint32)]
    for r in rows.select("start", "n_ids", "bits", "payload").orderBy("start").toLocalIterator():
        low, high = max(start - r.start, 0), min(start + count - r.start, r.n_ids)
        pieces.append(unpack(r.payload, r.bits, low, high - low))
    return np.concatenate(pieces)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write blocks under the shared folder and read the documents' digests back from them."""
    path = work_dir(docs.sparkSession, "token-blocks")
    write_blocks(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path)
