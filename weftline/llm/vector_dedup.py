"""Near-duplicate vectors of a label by spherical-cap filters.

Directions are structured: a filter is a pair of random unit vectors, one for each half of the
(randomly rotated) space, so that the filters that a vector exceeds follow from sums alone. A vector
goes to all filters whose sum is within a gap of its best, however many they are. The gap is GAP
standard deviations of the difference that two vectors of cosine `least` have in a filter, whatever
the number of codes. Two vectors of 64 dimensions and cosine 0.98 share a filter but for fewer than
one pair in 20,000 at each number of codes (missed in measurement: 7 of 1,000,000 at 128 codes, 1 of
500,000 at 500, 0 of 200,000 at 1,581, 0 of 60,000 at 5,000); all that share one are compared in double
precision.

Equal vectors are one node with a weight. No pairs leave a filter: what does is, for each member, the
weight of its links that this filter is the first to show, and one member of its component. A filter
with many members is dealt out in blocks, which meet in pairs in different tasks.

Odd rows: vectors that are null, zero or hold null or non-finite components, and rows with a null
label, link with nothing; so do vectors of different lengths. A null vec_id has a null component_id
and kept true. Rows that share a vec_id count as vectors of their own with one id. An empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batch, materialise, partitions, prepare
from weftline.llm.graph import components

#: How far under its best filter a vector's filters reach.
GAP = 1.8
#: Members of a filter that are compared in one block.
BLOCK = 2000


def codes(size: int, each: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation, and the codes of either half: as many as asked for, but in few dimensions no more than lie apart."""
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(size, size)))[0]
    halves = [np.random.default_rng(k + 3).normal(size=(min(each, 4 * 3 ** min(n, 16)), n)) for k, n in enumerate((size - size // 2, size // 2))]
    halves = [h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300) for h in halves]
    return turn, [np.array([[-1.0], [1.0]]) if h.shape[1] == 1 else h if h.shape[1] else h[:1] for h in halves]


def decode(unit: np.ndarray, turn: np.ndarray, halves: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The filters of all rows of unit vectors, one row's after the other's, and how many each row has."""
    turned = unit @ turn
    cut = halves[0].shape[1]
    gap = GAP * (2 * max(1 - least, 0.0)) ** 0.5 * (2 / unit.shape[1]) ** 0.5 + 1e-9
    near = []  # codes of a half that are within the gap of the half's best, by row
    for own, code in ((turned[:, :cut], halves[0]), (turned[:, cut:], halves[1])):
        s = own @ code.T
        s = s.max(1, keepdims=True) - s
        row, k = np.nonzero(s <= gap)
        near.append((row, k, s[row, k]))
    (row, i, short), (other, j, rest) = near
    n = np.bincount(other, minlength=len(unit))
    at = np.repeat((np.cumsum(n) - n)[row] - np.cumsum(n[row]) + n[row], n[row]) + np.arange(n[row].sum())
    row, i, short = (np.repeat(x, n[row]) for x in (row, i, short))
    keep = short + rest[at] <= gap
    return i[keep] * len(halves[1]) + j[at[keep]], np.bincount(row[keep], minlength=len(unit))


def _encoded(vectors: DataFrame, each: int, least: float, kind: str) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("vector", pa.binary()), ("filters", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for rows in batches:
            keys, labels, lists = (rows.column(k).to_pylist() for k in range(3))
            out = {"vec_id": keys, "digest": [None] * len(keys), "vector": [None] * len(keys), "filters": [None] * len(keys)}
            by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
            for k, (label, values) in enumerate(zip(labels, lists, strict=True)):
                if label is None or not values or None in values:
                    continue
                v = np.array(values, np.float64)
                if np.isfinite(v).all() and v.any():
                    by_size.setdefault(len(v), []).append((k, v))
            for size, own in by_size.items():
                if size not in known:
                    known[size] = codes(size, each)
                v = np.stack([x for _, x in own])
                scaled = v / np.abs(v).max(1, keepdims=True)
                found, n = decode(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), *known[size], least)
                for (k, x), f in zip(own, np.split(found, np.cumsum(n)[:-1]), strict=True):
                    space = hashlib.blake2b(f"{size}/{labels[k]}".encode(), digest_size=8).digest()
                    out["vector"][k] = x.astype(kind).tobytes()
                    out["digest"][k] = hashlib.blake2b(space + x.tobytes(), digest_size=16).digest()
                    out["filters"][k] = np.sort(f * np.int64(0x5851F42D4C957F2D) ^ np.frombuffer(space, np.int64)[0]).tobytes()
            yield batch(schema, **out)

    return vectors.mapInArrow(run, "vec_id long, digest binary, vector binary, filters binary")


def _filters(nodes: DataFrame) -> DataFrame:
    schema = pa.schema([("filter", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                filters = rows.column(1).to_pylist()
                yield batch(schema, filter=np.frombuffer(b"".join(filters), np.int64), node=np.repeat(np.asarray(rows.column(0)), [len(f) // 8 for f in filters]))

    return nodes.select("node", "filters").mapInArrow(run, "filter long, node long")


def _below(key: int, filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which list, and filter, of all filters under key."""
    flat = np.frombuffer(b"".join(filters), np.int64)
    low = flat < key
    return np.repeat(np.arange(len(filters)), [len(f) // 8 for f in filters])[low], flat[low]


def _shared(a: np.ndarray, b: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether rows a and b of each pair have one of the lists' filters in common; the filters are gone through in parts."""
    own, other = np.unique(a), np.unique(b)
    rows = np.union1d(own, other)
    named = np.isin(lists[0], rows)
    row = np.searchsorted(rows, lists[0][named])
    _, column, count = np.unique(lists[1][named], return_inverse=True, return_counts=True)
    column, row = column[(often := count[column] > 1)], row[often]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(own), len(other)), bool)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        part = slice(*np.searchsorted(column, (first, first + 2048)))
        has = np.zeros((len(rows), min(2048, int(column[-1]) + 1 - first)), np.float32)
        has[row[part], column[part] - first] = 1
        out |= has[np.searchsorted(rows, own)] @ has[np.searchsorted(rows, other)].T > 0
    return out[np.searchsorted(own, a), np.searchsorted(other, b)]


def _compared(cross: bool, block: np.ndarray, node: np.ndarray, weight: np.ndarray, vector: np.ndarray, filters: tuple[np.ndarray, np.ndarray], least: float):
    """Links of a cell: (node, weight of links first shown here, a member of the node's component); filters: those under the cell's."""
    scale = np.abs(vector).max(1, keepdims=True)
    unit = vector / scale
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    n = len(node)
    total, root = np.zeros(n, np.int64), np.arange(n)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    linked = np.zeros(n, bool)
    for at in range(0, n, 500):
        a, b = np.nonzero(unit[at : at + 500] @ unit.T >= least)
        a += at
        keep = (a < b) & (block[a] != block[b]) if cross else a < b
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        first = ~_shared(a, b, filters)
        np.add.at(total, a[first], weight[b[first]])
        np.add.at(total, b[first], weight[a[first]])
        linked[a] = linked[b] = True
        for x in np.unique(a):
            own = find(x)
            for y in b[a == x].tolist():
                if (r := find(y)) != own:
                    root[r] = own
    keep = np.flatnonzero(linked)
    return node[keep], total[keep], node[[find(k) for k in keep]]


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of its label at cosine >= least), component_id, kept."""
    spark = vectors.sparkSession
    prepare(spark)
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # singles are doubles when they are compared, but travel as they came
    vectors = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    each = max(128, int(vectors.count() ** 0.5 / 2))  # filters grow with the rows, so that members of one do not
    rows = materialise(_encoded(vectors, each, least, kind))
    valid = rows.filter("digest is not null and vec_id is not null")
    classes = valid.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    nodes = materialise(valid.join(classes, "digest").filter("vec_id = node").dropDuplicates(["digest"]).select("node", "weight", "vector", "filters"))

    members = _filters(nodes)
    crowds = members.groupBy("filter").agg(F.count("*").alias("n")).filter("n > 1").select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(crowds, "filter").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("filter", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    n = max(partitions(spark, vectors, 1), nodes.rdd.getNumPartitions())
    cells = cells.join(nodes, "node").repartition(n, "filter", "i", "j").sortWithinPartitions("filter", "i", "j", "node")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, block, node, weight = (np.asarray(table.column(c).combine_chunks()) for c in ("filter", "i", "j", "block", "node", "weight"))
            vector, filters = (table.column(c).to_pylist() for c in ("vector", "filters"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            at = [*np.flatnonzero(new).tolist(), len(key)]
            found = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 1:
                    f = _below(int(key[a]), filters[a:b])
                    v = np.frombuffer(b"".join(vector[a:b]), kind).astype(np.float64).reshape(b - a, -1)
                    own = _compared(bool(i[a] != j[a]), block[a:b], node[a:b], weight[a:b], v, f, least)
                    if len(own[0]):
                        found.append(own)
            if found:
                yield batch(schema, **{name: np.concatenate(x) for name, x in zip(schema.names, zip(*found, strict=True), strict=True)})

        for rows in batches:
            table = pa.Table.from_batches([rows])
            table = pa.concat_tables([left, table]) if left is not None else table
            if not len(table):
                continue
            key, i, j = (np.asarray(table.column(c).combine_chunks()) for c in ("filter", "i", "j"))
            last = int(np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[-1]) + 1 if ((key != key[-1]) | (i != i[-1]) | (j != j[-1])).any() else 0
            if last:
                yield from done(table.slice(0, last))
            left = table.slice(last)
        if left is not None and len(left):
            yield from done(left)

    links = materialise(cells.mapInArrow(run, "node long, n long, other long"))
    joined = components(links.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left").join(counts, "node", "left").join(joined, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component", "node", "vec_id"))
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
