"""Byte-level BPE, encoding and decoding, by a monoid reduction over a balanced tree.

The ids of two neighbouring stretches determine those of both together: only near the seam can they
change. A sequence of tokens is what BPE makes of its bytes if and only if that holds for each two
neighbours, so after re-encoding a window around the seam it is enough to look at the pairs at the
window's two edges; while one of them is not stable, the window grows. Halves are encoded
recursively and joined so; decoding concatenates up a tree.

Nulls count as empty texts, which have no ids and decode to no bytes; repeated rows give one row each.
Doc ids may be null or repeat. An empty table gives an empty result. Very long texts, and single matches
of a megabyte, take time in proportion to n log n. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batch, prepare
from weftline.llm.pieces import ByteVocabulary

#: Memo tables are dropped at this size; that bounds memory and changes no result.
MEMO = 400_000
#: Bytes in a leaf of the tree.
LEAF = 4
#: Windows of more bytes are merged with a heap, and not kept.
LONG = 64


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_of[k] = token
        self.windows: dict[bytes, list[int]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    def window(self, data: bytes) -> list[int]:
        """Merges of lowest rank first, for the few bytes around a seam."""
        if len(data) > LONG:
            return self._long_window(data)
        if (found := self.windows.get(data)) is not None:
            return found
        parts, ranks = [data[k : k + 1] for k in range(len(data))], self.ranks
        while len(parts) > 1:
            best = at = -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1], -1)
                if rank >= 0 and (best < 0 or rank < best):
                    best, at = rank, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = [ranks[p] for p in parts]
        if len(self.windows) >= MEMO:
            self.windows.clear()
        self.windows[data] = out
        return out

    def _long_window(self, data: bytes) -> list[int]:
        """The same with a heap of mergeable neighbours, in time n log n."""
        ranks, tokens = self.ranks, [data[k : k + 1] for k in range(len(data))]
        after, before = [*range(1, len(data) + 1)], [*range(-1, len(data) - 1)]
        known: dict[tuple[bytes, bytes], int] = {}

        def rank(a: bytes, b: bytes) -> int:
            if (found := known.get((a, b))) is None:
                found = known[a, b] = ranks.get(a + b, -1)
            return found

        heap = [found << 40 | k for k in range(len(data) - 1) if (found := rank(tokens[k], tokens[k + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            k = top & 0xFFFFFFFFFF
            other = after[k]
            if not tokens[k] or other >= len(data) or rank(tokens[k], tokens[other]) != top >> 40:
                continue  # one of the two was merged meanwhile
            tokens[k] += tokens[other]
            tokens[other] = b""
            far = after[k] = after[other]
            if far < len(data):
                before[far] = k
                if (found := rank(tokens[k], tokens[far])) >= 0:
                    heapq.heappush(heap, found << 40 | k)
            if before[k] >= 0 and (found := rank(tokens[before[k]], tokens[k])) >= 0:
                heapq.heappush(heap, found << 40 | before[k])
        return [ranks[t] for t in tokens if t]

    def is_stable(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (found := self.stable.get(pair)) is None:
            if len(self.stable) >= MEMO:
                self.stable.clear()
            found = self.stable[pair] = self.window(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: ids of the two stretches together."""
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        before = after = 1
        while True:
            a, b = max(0, len(left) - before), min(len(right), after)
            middle = self.window(b"".join([self.bytes_of[t] for t in left[a:]]) + b"".join([self.bytes_of[t] for t in right[:b]]))
            begins, ends = a == 0 or self.is_stable(left[a - 1], middle[0]), b == len(right) or self.is_stable(middle[-1], right[b])
            if begins and ends:
                return left[:a] + middle + right[b:]
            before, after = before if begins else 3 * before, after if ends else 3 * after

    def reduce(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.window(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.reduce(data) if data else []

    def decode(self, ids: list[int]) -> bytes:
        """Blocks of ids, then their concatenations in pairs up the tree."""
        get = self.bytes_of.__getitem__
        level = [b"".join(map(get, ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def split_pattern(pattern: str) -> regex.Pattern:
    """White space as Unicode has it, whichever library reads the pattern."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def tree_vocabulary(path: str, pattern: str) -> tuple[TreeBpe, ByteVocabulary]:
    bpe, find = TreeBpe(read_ranks(path)), split_pattern(pattern).findall

    def plain(texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            ids: list[int] = []
            for match in find(t):
                ids += bpe.encode(match.encode())
            out.append(np.array(ids, "<u4").tobytes())
        return out

    return bpe, ByteVocabulary(lambda words: [np.array(bpe.encode(w.encode()), "<u4").tobytes() for w in words], plain)


_OPEN: dict[tuple[str, str], tuple[TreeBpe, ByteVocabulary]] = {}


def encode_decode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, sha256 of the ids (little-endian, 32 bits) and of the decoded bytes.

    with_ids adds ids (array<int>) and decoded (binary), the real outputs. No shuffle: rows are independent.
    """
    prepare(docs.sparkSession)
    fields = [(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = f"`{id_column}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
        ddl += ", ids array<int>, decoded binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern)
        if key not in _OPEN:
            _OPEN[key] = tree_vocabulary(path, pattern)
        bpe, words = _OPEN[key]
        for rows in batches:
            packed = words.encode(rows.column(1))
            out = {"n_tokens": [len(p) // 4 for p in packed], "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed], "decoded_sha256": []}
            if with_ids:
                out |= {"ids": [], "decoded": []}
            for p in packed:
                ids = np.frombuffer(p, "<u4").tolist()
                decoded = bpe.decode(ids)
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded)
            yield batch(schema, **{id_column: rows.column(0)}, **out)

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, ddl)
