"""Token ids as length-delimited binary records with an offset index.

A shard file is a run of blocks, each followed by one line feed (the separator
Spark's text writer puts behind a row):

    block   b"RBK1", frames u32, bytes of the frames u64, frames
    frame   length u32, masked CRC-32 of those four bytes u32,
            payload, masked CRC-32 of the payload u32
    payload flags u8 (1: no document id, 2: four-byte ids), document id i64, ids

All numbers are little-endian.  The mask rotates the checksum right by 15 bits
and adds 0xA282EAD8, so that a checksum of data with checksums stays useful.
Ids take two bytes each if all of the document's fit.  Shards follow document
id order; shard k holds what ``part-k`` files hold.  The index is a separate
Parquet table with each record's shard, byte offset and size, from which any
record can be read without its neighbours.

Files are written and read by Spark's own writers and readers, so they go to
any file system Spark knows, and lost tasks are committed once.  Texts move
once (range partitions over document ids); a shard holds about ``SHARD_BYTES``
of text, one file of it is in memory at a time.
"""
from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordfold.llm import common

SHARD_BYTES = 16 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024
MEMO = 300_000
MAGIC = b"RBK1"
_BLOCK, _FRAME, _HEAD = struct.Struct("<4sIQ"), struct.Struct("<II"), struct.Struct("<Bq")
NO_ID, WIDE = 1, 2
#: Letters of which a run is one pre-token if an ASCII character that is no letter, or the end, follows.
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WHITE = "\t-\r \x85\xa0  -     　"


_PLAIN = re.compile(f" ?[{_LETTER}]+")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    flags = (NO_ID if doc_id is None else 0) | (WIDE if wide else 0)
    payload = _HEAD.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<I", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def block(frames: list[bytes]) -> pa.RecordBatch:
    body = b"".join(frames)
    return pa.RecordBatch.from_pydict({"block": pa.array([_BLOCK.pack(MAGIC, len(frames), len(body)) + body], pa.binary())})


def read_frame(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids as u32, next offset) of the record at an offset; raises on damage."""
    length, check = _FRAME.unpack_from(data, at)
    payload = bytes(data[at + 8:at + 8 + length])
    if check != masked_crc(data[at:at + 4]) or len(payload) != length \
            or struct.unpack_from("<I", data, at + 8 + length)[0] != masked_crc(payload):
        raise ValueError(f"damaged record at byte {at}")
    flags, doc_id = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=_HEAD.size)
    return None if flags & NO_ID else doc_id, ids.astype("<u4"), at + 12 + length


def read_shard(data: memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, bytes, document id, ids) of every record of a shard file."""
    at = 0
    while at < len(data):
        magic, n, size = _BLOCK.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += _BLOCK.size
        end = at + size
        for _ in range(n):
            doc_id, ids, after = read_frame(data, at)
            yield at, after - at, doc_id, ids
            at = after
        if at != end or bytes(data[at:at + 1]) != b"\n":
            raise ValueError(f"damaged block before byte {at}")
        at += 1


class TextEncoder:
    """The tokenizers library with a memo of pieces of texts.

    No pre-token of a byte-level vocabulary continues from a character that is
    no white space into white space, or from a letter into an ASCII character
    that is none, so a text may be cut there and every distinct piece encoded
    once.  Plain words are handed over many in one text, a line each.  Texts
    with a special string go to the library whole.  The memo is of bounded size:
    when full it becomes the older half, and the half before it is dropped."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        self.cut = None
        if kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec["normalizer"]:
            self.cut = re.compile(f"[{_WHITE}]*[{_LETTER}]+(?=[\\x00-@\\[-`{{-\x7f]|$)|[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        known = self.older
        self.memo.update((p, known[p]) for p in pieces if p in known)
        fresh = [p for p in pieces if p not in known]
        plain = [p for p in fresh if _PLAIN.fullmatch(p)] if len(self.line) == 1 else []
        for i in range(0, len(plain), 2000):
            part = plain[i:i + 2000]
            ids = np.array(self.tokenizer.encode("\n".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.line[0])
            raw = ids.tobytes()
            starts = [0, *(4 * (cuts + 1)).tolist()]
            ends = [*(4 * cuts).tolist(), len(raw)]
            self.memo.update((p, raw[a:b]) for p, a, b in zip(part, starts, ends, strict=True))
        rest = [p for p in fresh if p not in self.memo]
        self.memo.update(zip(rest, self._encode(rest)))

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 5000):
            out += [np.array(e.ids, "<u4").tobytes() for e in
                    self.tokenizer.encode_batch_fast(texts[i:i + 5000], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        whole = [k for k, t in enumerate(texts) if not self.cut or self.special and self.special.search(t)]
        direct = dict(zip(whole, self._encode([texts[k] for k in whole])))
        cut = [[] if k in direct else self.cut.findall(t) for k, t in enumerate(texts)]
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        new: set[str] = set()
        for c in cut:
            new.update(c)
        self._learn([p for p in new if p not in self.memo])
        get = self.memo.__getitem__
        return [direct[k] if k in direct else b"".join(map(get, c)) for k, c in enumerate(cut)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


# ---------------------------------------------------------------- on Spark

def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int) -> None:
    """Encode every row's text (null: empty), append ``end_id`` and write shard
    files in ascending doc_id order (null ids first, equal ids by text hash).
    Every input row is one record; an empty table writes no record."""
    common.bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(int(shards), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches):
        held, size = [], 0
        enc = encoder(tokenizer)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, e in zip(ids, enc.encode(common.texts(b.column("text")))):
                held.append(frame(i, np.frombuffer(e + end, "<u4")))
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)
    # the cast keeps the bytes as they are
    ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")) \
        .write.option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(shard.alias("shard"), "content")


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """Read the shard files, verify every record and write the index table:
    shard, seq (in the shard), offset, bytes, doc_id, shard_start (ids before it
    in the shard), n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    common.bounded_batches(spark)
    schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()),
                        ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def scan(batches):
        def rows():
            for b in batches:
                for shard, content in zip(b.column("shard").to_pylist(), b.column("content")):
                    start = 0
                    for seq, (at, size, doc_id, ids) in enumerate(read_shard(memoryview(content.as_buffer()))):
                        yield shard, seq, at, size, doc_id, start, len(ids), zlib.crc32(ids.tobytes())
                        start += len(ids)
        return common.rows_to_batches(rows(), schema)
    _files(spark, path).mapInArrow(scan, ", ".join(f"{f.name} bigint" for f in schema)).write.parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index with ``start``: ids of all records before it, over all shards."""
    rows = spark.read.parquet(index)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row a shard file
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(totals.select("shard", before.alias("base")), "shard") \
        .withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records at the index rows ``wanted`` (shard, offset), in any order, as
    rows (shard, offset, doc_id, ids)."""
    at = wanted.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))  # at most a shard's records
    schema = pa.schema([("shard", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches):
        def rows():
            for b in batches:
                for shard, content, offsets in zip(b.column("shard").to_pylist(), b.column("content"), b.column("offsets").to_pylist()):
                    data = memoryview(content.as_buffer())
                    for o in offsets:
                        doc_id, ids, _ = read_frame(data, o)
                        yield shard, o, doc_id, ids.tolist()
        return common.rows_to_batches(rows(), schema, 200)
    return _files(spark, path).join(at, "shard").mapInArrow(read, "shard bigint, offset bigint, doc_id bigint, ids array<bigint>")
