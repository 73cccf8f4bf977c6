"""Token ids in binary shards, with a minimal perfect hash index for access by document key.

Format of a shard (little-endian; numbers are unsigned):
    magic     8 bytes   b"WFTSHRD1"
    header    7 x 8     documents, keys, ids, bytes of an id (2 or 4), levels, bits of all levels, 64-bit words of bits
    levels    8 each    bits of each level of the hash
    bits      8 each    the levels' bit arrays, one after the other
    ranks     4 each    ones before each word
    prints    4 each    by slot: fingerprint of the key
    records   4 each    by slot: the key's first document in the shard
    keys      8 each    by document: its key (signed), ascending
    nulls     1 each    by document: 1 if the key is null (these come first)
    offsets   8 each    one more than documents: first id of each
    payload             raw ids of all documents in order

Keys are hashed with a new seed at each level; those that meet no other key set a bit there, the rest
go to the next level. The ones before a key's bit number it, without gaps and collisions; its
fingerprint tells keys that the shard doesn't have. Every look-up takes constant time.

Documents go to shards by ranges of the key. A null text is empty; each document ends with end_id.
Rows that share a key stand together (in the order of their texts), the index leads to the first; null
keys come first and have no slot. Very long texts are one document's ids, however many; empty tables
give no shard. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batch, materialise, partitions, prepare, scratch_dir
from weftline.llm.pieces import ByteVocabulary, byte_vocabulary

MAGIC = b"WFTSHRD1"
#: Bits for each key on a level.
GAMMA = 2.0
_OPEN: dict[str, ByteVocabulary] = {}


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, by levels of bit arrays."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.levels, self.bits, self.ranks = levels, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(levels)]).astype(np.uint64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, arrays, left = [], [], keys
        while len(left):
            size = -(-int(GAMMA * len(left) + 1) // 64) * 64
            at = _mixed(left, len(levels)) % np.uint64(size)
            counts = np.bincount(at.astype(np.int64), minlength=size)
            arrays.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            levels.append(size)
            left = left[counts[at.astype(np.int64)] != 1]
        bits = np.concatenate(arrays) if arrays else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(_ones(bits))[:-1]]).astype("<u4") if len(bits) else np.zeros(0, "<u4")
        return cls(np.array(levels, "<u8"), bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1; keys that were not built in may get any slot."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.levels):
            if not len(open_):
                break
            at = _mixed(keys[open_], level) % np.uint64(size) + self.starts[level]
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.bits[word]
            hit = ((held >> bit) & np.uint64(1)).astype(bool)
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[word].astype(np.int64) + _ones(below))[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


def shard_bytes(keys: list[int | None], ids: list[bytes], wide: bool = False) -> bytes:
    """The shard of documents in ascending order of key, nulls first; ids are packed 32-bit ones."""
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([0 if k is None else k for k in keys], "<i8")
    own, first = np.unique(key[null == 0], return_index=True)
    index = PerfectHash.build(own)
    slot = index.slots(own)
    prints, records = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    prints[slot], records[slot] = fingerprints(own), first + int(null.sum())
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    payload = np.frombuffer(b"".join(ids), "<u4").astype("<u4" if wide else "<u2")
    header = np.array([len(keys), len(own), offsets[-1], payload.itemsize, len(index.levels), int(index.levels.sum()), len(index.bits)], "<u8")
    return MAGIC + b"".join(x.tobytes() for x in (header, index.levels, index.bits, index.ranks, prints, records, key, null, offsets, payload))


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.data, self.at = data, 8
        documents, keys, ids, width, levels, _, words = (int(x) for x in self._take("<u8", 7))
        sizes, bits, ranks = self._take("<u8", levels), self._take("<u8", words), self._take("<u4", words)
        self.index = PerfectHash(sizes, bits, ranks)
        self.prints, self.records = self._take("<u4", keys), self._take("<u4", keys)
        self.keys, self.nulls, self.offsets = self._take("<i8", documents), self._take("u1", documents), self._take("<u8", documents + 1)
        self.payload = self._take(f"<u{width}", ids)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First document of each key, or -1 where the shard has no such key (but for equal fingerprints, 1 in 2**32)."""
        slot = self.index.slots(keys) if len(self.prints) else np.full(len(keys), -1)
        out = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.prints[slot[hit]] == fingerprints(keys[hit])]
        out[hit] = self.records[slot[hit]]
        return out

    def ids(self, document: int) -> np.ndarray:
        return self.payload[int(self.offsets[document]) : int(self.offsets[document + 1])]


class ShardFile:
    """A shard in a random-access file: each look-up reads the header, one slot and one document's range."""

    def __init__(self, file):
        self.file = file
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a shard of token ids")
        self.documents, self.keys, _, self.width, levels, _, self.words = (int(x) for x in np.frombuffer(self._read(8, 56), "<u8"))
        self.levels = np.frombuffer(self._read(64, 8 * levels), "<u8")
        self.bits = 64 + 8 * levels
        self.ranks = self.bits + 8 * self.words
        self.prints = self.ranks + 4 * self.words
        self.records = self.prints + 4 * self.keys
        self.names = self.records + 4 * self.keys
        self.offsets = self.names + 9 * self.documents
        self.payload = self.offsets + 8 * (self.documents + 1)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _number(self, at: int, kind: str) -> int:
        return int(np.frombuffer(self._read(at, np.dtype(kind).itemsize), kind)[0])

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with that key; none if the shard hasn't got it."""
        one, start = np.array([key], np.int64), 0
        for level, size in enumerate(self.levels.tolist()):
            at = start + int(_mixed(one, level)[0] % np.uint64(size))
            held = self._number(self.bits + 8 * (at // 64), "<u8")
            if held >> (at % 64) & 1:
                slot = self._number(self.ranks + 4 * (at // 64), "<u4") + (held & ((1 << (at % 64)) - 1)).bit_count()
                return self._documents(key, slot) if self._number(self.prints + 4 * slot, "<u4") == int(fingerprints(one)[0]) else []
            start += size
        return []

    def _documents(self, key: int, slot: int) -> list[np.ndarray]:
        k, out = self._number(self.records + 4 * slot, "<u4"), []
        while k < self.documents and self._number(self.names + 8 * k, "<i8") == key:
            a, b = np.frombuffer(self._read(self.offsets + 8 * k, 16), "<u8").tolist()
            out.append(np.frombuffer(self._read(self.payload + self.width * a, self.width * (b - a)), f"<u{self.width}"))
            k += 1
        return out


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, shard_mb: float = 24) -> DataFrame:
    """Writes the shards and returns their manifest: shard, file, documents, ids, low and high key, ascending by key.

    A file has a name of its own until it is whole, so that a task that is run again or twice leaves
    only whole files; the manifest names those that count.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _OPEN.setdefault(path, None) or _OPEN.__setitem__(path, byte_vocabulary(path)) or _OPEN[path]
        keys: list[int | None] = []
        ids: list[bytes] = []
        for rows in batches:
            keys += rows.column(0).to_pylist()
            ids += [x + end for x in words.encode(rows.column(1))]
        if keys:
            file = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.ids"
            system, at = _file_system(file)
            wide = any(len(x) and int(np.frombuffer(x, "<u4").max()) > 0xFFFF for x in ids)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(at + ".part") as f:
                f.write(shard_bytes(keys, ids, wide))
            system.move(at + ".part", at)
            yield batch(schema, shard=[TaskContext.get().partitionId()], file=[file], documents=[len(keys)], ids=[sum(map(len, ids)) // 4], low=[next((k for k in keys if k is not None), None)], high=[keys[-1]])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = partitions(spark, rows, shard_mb)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(run, "shard long, file string, documents long, ids long, low long, high long"))


def _file_system(uri: str):
    """Any store that pyarrow knows: file, hdfs, s3, gs. Driver and executors must both reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the shards, each found by its key: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        ddl += ", ids array<long>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for file, before in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                system, at = _file_system(file)
                with system.open_input_stream(at) as f:
                    shard = Shard(f.readall())
                n = len(shard.keys)
                document = np.arange(n)
                named = np.flatnonzero(shard.nulls == 0)
                found = shard.find(shard.keys[named])
                if len(named) and ((found < 0).any() or (shard.keys[found] != shard.keys[named]).any()):
                    raise ValueError(f"the index of {file} doesn't lead to its documents")
                repeat = np.arange(len(named)) - np.searchsorted(shard.keys[named], shard.keys[named])
                document[named] = found + repeat
                for a in range(0, n, 2000):
                    own = document[a : a + 2000]
                    ids = [shard.ids(k) for k in own]
                    out = {
                        "doc_id": [None if shard.nulls[k] else int(shard.keys[k]) for k in own],
                        "start": before + shard.offsets[own].astype(np.int64),
                        "n_tokens": [len(x) for x in ids],
                        "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                    }
                    yield batch(schema, **out, **({"ids": [x.tolist() for x in ids]} if with_ids else {}))

    # one row for each shard: totals of shards before it, not of documents
    before = (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before")
    files = manifest.select("file", before)
    n = max(1, manifest.count())
    return files.repartition(n, "file").mapInArrow(run, ddl)


def lookup(manifest: DataFrame, keys: Sequence[int]) -> DataFrame:
    """doc_id and ids of the documents with these keys, a row for each; only headers, slots and their ranges are read.

    keys are few (they travel with the plan); those that no shard has give no row.
    """
    spark = manifest.sparkSession
    prepare(spark)
    wanted = spark.createDataFrame([(int(k),) for k in sorted(set(keys))], "doc_id long")
    placed = manifest.select("file", "low", "high").join(F.broadcast(wanted), F.col("doc_id").between(F.col("low"), F.col("high"))).select("file", "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            by_file: dict[str, list[int]] = {}
            for file, key in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                by_file.setdefault(file, []).append(key)
            for file, own in by_file.items():
                system, at = _file_system(file)
                with system.open_input_file(at) as f:
                    shard = ShardFile(f)
                    found = [(key, ids.tolist()) for key in own for ids in shard.get(key)]
                yield batch(schema, doc_id=[key for key, _ in found], ids=[ids for _, ids in found])

    return placed.repartition("file").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, shard_mb: float = 24) -> DataFrame:
    """Writes the shards and reads every document back from them. The folder is one in the shared scratch folder if not given."""
    return read(write(docs, path, folder or scratch_dir(docs.sparkSession), end_id, shard_mb))
