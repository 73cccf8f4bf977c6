"""Packing of documents into sequences, shortest pack first over the histogram of lengths.

Documents are tokenised once and cut into pieces of at most max_tokens. Of the pieces, only the
counts by length (max_tokens numbers) reach the driver. Lengths are placed longest first, all pieces
of a length at once: each goes to the shortest pack that has room, which turns part of a packing
pattern's count into a longer pattern's. Pieces are then ranked within their length, and the rank
says which pattern, which copy of it and which place in it a piece takes.

Null texts are empty ones; each document ends with end_id, so that none is without ids. Repeated
rows and repeated or null doc ids give their own pieces; very long texts give as many as they need, an
empty table none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batch, materialise, prepare
from weftline.llm.pieces import WordVocabulary

#: Pieces that are ranked together within a length, about: a length of more is dealt out by salt.
RANKED = 1000
_OPEN: dict[str, WordVocabulary] = {}


def cut(docs: DataFrame, path: str, max_tokens: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents: doc_id, start, length, ids_crc32, doc_tokens (and ids, packed little-endian 32 bits)."""
    prepare(docs.sparkSession)
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        fields.append(("ids", pa.binary()))
        ddl += ", ids binary"
    schema, end = pa.schema(fields), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _OPEN.setdefault(path, None) or _OPEN.__setitem__(path, WordVocabulary(path)) or _OPEN[path]
        for rows in batches:
            out = defaultdict(list)
            for key, ids in zip(rows.column(0).to_pylist(), words.encode(rows.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, max_tokens):
                    own = ids[4 * start : 4 * (start + max_tokens)]
                    for name, x in zip(schema.names, (key, start, len(own) // 4, zlib.crc32(own), total, own), strict=False):
                        out[name].append(x)
            if out:
                yield batch(schema, **out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with their counts. Work and output are bounded by max_tokens, not by the pieces."""
    packs: list[list[list]] = [[] for _ in range(max_tokens + 1)]  # by tokens held: [pattern, count]
    shortest = max_tokens + 1
    for length in range(max_tokens, 0, -1):
        left = histogram.get(length, 0)
        while left:
            at = shortest
            while at <= max_tokens - length and not packs[at]:
                at += 1
            if at > max_tokens - length:
                # a new pack takes as many pieces of this length as it can hold, if there are so many
                times = min(max_tokens // length, left)
                packs[times * length].append([((length, times),), left // times])
                shortest = min(shortest, times * length)
                left %= times
                continue
            pattern, count = packs[at].pop()
            room = (max_tokens - at) // length
            times = min(room, max(1, -(-left // count)))  # spread over all copies of the pattern
            used = min(count, left // times)
            if used < count:
                packs[at].append([pattern, count - used])
            packs[at + times * length].append([(*pattern, (length, times)), used])
            left -= used * times
    return [(pattern, count) for held in packs for pattern, count in held]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: first rank, pattern's first sequence, pieces of the length in the pattern, offset of the first."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: Counter[int] = Counter()
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            by_length[length].append((taken[length], sequence, times, offset))
            taken[length] += count * times
            offset += length * times
        sequence += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in by_length.items()}


def pack(docs: DataFrame, path: str, max_tokens: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece, as cut gives it, with sequence_id and offset.

    with_ids keeps the pieces' ids: the packed data itself is then the rows of a sequence in the order of offset.
    """
    pieces = materialise(cut(docs, path, max_tokens, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    salts = F.lit(1)
    if many := {length: n // RANKED + 1 for length, n in histogram.items() if n > RANKED}:
        salts = F.coalesce(F.create_map(*[F.lit(int(x)) for pair in many.items() for x in pair])[F.col("length").cast("int")], salts)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts))
    held = pieces.groupBy("length", "salt").count()  # at most max_tokens + pieces / RANKED rows
    before = held.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    places = docs.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, max_tokens)))  # a few rows for each length

    at = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    order = pieces.withColumn("rank", F.row_number().over(at) - 1).join(before, ["length", "salt"])
    order = order.select(*[c for c in pieces.columns if c != "salt"], (F.col("rank") + F.col("before")).alias("rank"))
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lengths, ranks = (np.asarray(rows.column(n)) for n in ("length", "rank"))
            sequence, offset = np.zeros((2, len(lengths)), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, start, times, begins = places.value[int(length)]
                k = np.searchsorted(first, ranks[own], "right") - 1
                copy, nth = np.divmod(ranks[own] - first[k], times[k])
                sequence[own], offset[own] = start[k] + copy, begins[k] + nth * length
            new = batch(schema, sequence_id=sequence, offset=offset)
            kept = [n for n in rows.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), *new.columns], names=[*kept, *schema.names])

    ddl = ", ".join(f"{n} {t}" for n, t in order.dtypes if n != "rank").replace("bigint", "long")
    return order.mapInArrow(place, ddl + ", sequence_id long, offset long")
