"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of key. Layout, integers little-endian:

    data blocks | index | Bloom filter | footer

A block has up to BLOCK_BYTES of entries, packed with zstd; an entry is how many leading bytes of
its key it shares with the key before (varint), how many follow (varint), the length of its value (varint),
those key bytes, the value. A key is the identifier as 8 big-endian bytes with the sign bit
flipped, so that byte order is number order, or for text its UTF-8 bytes after one more byte;
null sorts first, as an empty key. The index has for
each block its last key, place, size, entries and ids; the Bloom filter has BLOOM_BITS bits a key.
The footer has the places of both, the counts and a magic number. A lookup asks the filter, then
binary-searches the index and reads one block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.llm.common import Scratch, texts_of
from noticeflow.llm.tokens import SPACED, codec, ids32

MAGIC, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = b"NFSSTAB2", 1 << 18, 10, 7
_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_FOOTER = struct.Struct("<QQQQQQBxxxxxxx8s")  # index, its size, Bloom filter, its size, documents, ids, bytes of an id, magic
_INDEX = struct.Struct("<HQIIQ")  # bytes of the last key, block, its size, entries, ids


def key_of(doc_id: int | str | None) -> bytes:
    if doc_id is None:
        return b""
    return b"=" + doc_id.encode() if isinstance(doc_id, str) else struct.pack(">Q", doc_id + (1 << 63))


def number_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def text_of(key: bytes) -> str | None:
    return key[1:].decode() if key else None


#: Types of ids that are stored as numbers; others are stored as text.
NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to an open stream; keys must come in ascending order, repeats allowed."""

    def __init__(self, sink, id_bytes: int):
        self.sink, self.id_bytes = sink, id_bytes
        self.at = self.n_docs = self.n_ids = 0
        self.block, self.last, self.entries, self.ids, self.size = [], b"", 0, 0, 0
        self.index, self.keys = [], []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        self.block += (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value)
        self.entries, self.ids, self.last = self.entries + 1, self.ids + len(value) // self.id_bytes, key
        self.size += len(value) + 12
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            packed = _pack.compress(b"".join(self.block))
            self.sink.write(packed)
            self.index.append(_INDEX.pack(len(self.last), self.at, len(packed), self.entries, self.ids) + self.last)
            self.at, self.n_docs, self.n_ids = self.at + len(packed), self.n_docs + self.entries, self.n_ids + self.ids
            self.block, self.entries, self.ids, self.size = [], 0, 0, 0

    def close(self) -> tuple[int, int, int]:
        """Writes index, filter and footer; documents, ids and bytes of the shard."""
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        bloom[[p for k in self.keys for p in _bloom_places(k, bits)]] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        footer = _FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.n_docs, self.n_ids, self.id_bytes, MAGIC)
        self.sink.write(index + packed + footer)
        return self.n_docs, self.n_ids, self.at + len(index) + len(packed) + len(footer)


class Reader:
    """Reads one shard from a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_ids, self.id_bytes, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        data, at, self.blocks = self._at(index_at, index_size), 0, []
        while at < len(data):
            key_size, *place = _INDEX.unpack_from(data, at)
            at += _INDEX.size + key_size
            self.blocks.append((data[at - key_size : at], *place))
        bloom = self._at(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """Keys and values of a block."""
        _, place, size, entries, _ = self.blocks[i]
        data, at, key = _unpack.decompress(self._at(place, size)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more + length
            yield key, data[at - length : at]

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, none if it isn't there."""
        if not self.blocks or not self.may_have(key):
            return []
        low, high = 0, len(self.blocks)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.blocks[middle][0] < key else (low, middle)
        out = []
        while low < len(self.blocks):
            out += [v for k, v in self.block(low) if k == key]
            if self.blocks[low][0] > key:
                break
            low += 1
        return out


def write_token_shards(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, kind: str = SPACED, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Encodes docs and writes their ids in shards below folder; returns shard, path, n_docs, n_ids, n_bytes, one row per shard.

    Shards and the documents in them ascend by id, null ids first; rows with one id lie next to each other,
    by text. Null texts are empty. end_id ends each document. A shard is written under a name
    of its attempt and then renamed, so a task that runs twice leaves one file. No rows
    leave no shards. Whole numbers as ids are stored and ordered as such, ids of other types as text. There are as many shards as
    asked for, or by default as many as shuffle partitions, or as docs has partitions where these are more: a table's partitions are of bounded
    size, so a shard and its writer are as well, whatever the input. Strings of special tokens are encoded as the library does, or as ordinary text. Other columns are ignored.
    """
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    key = F.col(id_col).cast("long" if dict(docs.dtypes)[id_col] in NUMBERS else "string")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    fields = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, shard, writer = codec(vocabulary, kind, special_as_text), TaskContext.get().partitionId(), None
        store, root = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], code.type).tobytes()
        for batch in batches:
            if batch.num_rows and writer is None:
                store.create_dir(root, recursive=True)
                mine = f"{root}/_attempt-{shard}-{uuid.uuid4().hex}"
                sink = store.open_output_stream(mine)
                writer = Writer(sink, code.type.itemsize)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), code.encode_bounded(texts_of(batch, "text")), strict=True):
                writer.add(key_of(doc_id), ids + end)
        if writer is None:
            return
        counts = writer.close()
        sink.close()
        path = f"{root}/shard-{shard:06d}.sst"
        store.move(mine, path)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, path, *counts), fields, strict=True)], schema=fields)

    return rows.mapInArrow(run, "shard int, path string, n_docs long, n_ids long, n_bytes long")


def read_token_shards(spark: SparkSession, shards: DataFrame, folder: str, with_ids: bool = False, as_text: bool = False) -> DataFrame:
    """Each document of the shards (as write_token_shards returned them, written to a table): doc_id, start, n_tokens, ids_crc32 (and ids).

    start: ids of all documents before it. Files are read block by block, one task for each shard. as_text: ids are text and no numbers.
    """
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = shards.withColumn("before", before).repartition(n, "shard")
    fields = [pa.field("doc_id", pa.string() if as_text else pa.int64()), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_crc32", pa.int64())] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        own = text_of if as_text else number_of
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    reader = Reader(source)
                    kind = np.dtype(f"<u{reader.id_bytes}")
                    for i in range(len(reader.blocks)):
                        out = []
                        for key, value in reader.block(i):
                            ids = np.frombuffer(value, kind)
                            out.append((own(key), start, len(ids), zlib.crc32(ids32(ids)), *([ids.tolist()] if with_ids else [])))
                            start += len(ids)
                        columns = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return listed.mapInArrow(run, f"doc_id {'string' if as_text else 'long'}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_shards(spark: SparkSession, docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """docs written to shards in the shared folder and read back."""
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("shards")
    shards = scratch.cut(write_token_shards(spark, docs, folder, vocabulary, **how), "listing")
    return read_token_shards(spark, shards, folder, as_text=dict(docs.dtypes)[how.get("id_col", "doc_id")] not in NUMBERS)
