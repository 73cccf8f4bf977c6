"""Near-duplicate documents by SetSketch registers over word shingles.

A register is the largest, over a document's distinct shingles, of floor(1 - log_b h): exponential
variates on an exponentially spaced scale, cut off at both ends. Registers of a union are the maxima
of the parts' registers, and two sets' registers agree with nearly the probability of their Jaccard
similarity. Bands of register values find candidates; the joint likelihood of (larger, smaller, equal)
registers rules out hopeless ones; what is left is confirmed on the full sets.

No group is expanded into pairs. Documents with equal sets are one node. In each band's bucket, nodes
are first compared with two of its members. Buckets whose nodes the confirmed links leave unconnected
are then gone through, in blocks, where the registers leave pairs possible: a task compares full sets
of pairs that nothing connects yet and returns only links that connect.

Results for odd rows: null or blank texts have no shingles and are linked with nothing; fewer than
`words` words are one shingle; equal rows are linked; rows that share a doc_id are one document with
all their links; a null doc_id is linked with nothing (component_id null, kept true). Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batch, groups, materialise, prepare, slices
from weftline.llm.graph import components

#: Registers: BANDS bands of ROWS. Two sets of similarity 0.8 miss each other with probability 3e-5, at 0.85 with 3e-7, at 0.9 with 3e-11.
BANDS, ROWS = 26, 5
#: Base of the scale and rate of the variates; values stay under 2**16.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: A pair is ruled out if its registers are e**DOUBT times likelier under a lower similarity than under the threshold.
DOUBT = 18.0
#: Members of a bucket that meet in one task, and their shingles: those of a block are this many at most, on average.
BLOCK, ROOM = 1000, 2_000_000
#: Cells over which the pairs of one node are dealt.
CELLS = 256
#: Pairs of a cell whose registers are compared together.
PAIRS = 4096
_MASK = 0x2AAAAAAAAAAAAAAA
_RANDOM = np.random.default_rng(20_240_607)
_BYTE = _RANDOM.integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**64, 64, np.uint64) | np.uint64(1)
_FACTORS = _RANDOM.integers(1, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space, A-Z lower-cased), and where each text's words begin."""
    parts = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    gap = _SPACE[data]
    first = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    last = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) + 1
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    at = np.arange(len(data), dtype=np.int64)
    at -= np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(data)]])))
    value = _BYTE[data] * _PLACE[at & 63]
    far = np.flatnonzero(at > 63)  # in long words: the place within 64 bytes, and which 64 bytes
    value[far] = _mix(value[far] + (at[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value[gap] = 0
    return _mix(np.add.reduceat(value, first) + (last - first).astype(np.uint64)), bounds


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    hashes, bounds = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled[: n - k] += hashes[k:] * _PLACE[k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = (hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(_mix(short + _PLACE[-(b - a)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty: one uint16 for each register."""
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[k : k + 1024] * _FACTORS[:, None]).min(1))
    variate = -np.log1p(-((least >> np.uint64(32)) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype("<u2")


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch (null for an empty set)."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], words)
                yield batch(schema, doc_id=keys[a:b], n_shingles=[len(s) for s in sets], digest=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], sketch=[registers(s).tobytes() if len(s) else None for s in sets])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def band_keys(sketch_rows: DataFrame) -> DataFrame:
    """(node, band, key) for each band of each sketch."""
    schema = pa.schema([("node", pa.int64()), ("band", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            values = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.zeros(values.shape[:2], np.uint64)
            for k in range(ROWS):
                keys = _mix(keys + (values[:, :, k] + np.uint64(1)) * _PLACE[k])
            keys = _mix(keys ^ _FACTORS[:BANDS])
            yield batch(schema, node=np.repeat(np.asarray(rows.column(0)), BANDS), band=np.tile(np.arange(BANDS, dtype=np.int32), rows.num_rows), key=keys.ravel().view(np.int64))

    return sketch_rows.select("node", "sketch").mapInArrow(run, "node long, band int, key long")


def may_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Whether registers x and y (a row for each pair) and the sets' sizes leave similarity >= least possible."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - less
    u, v = nx / (nx + ny), ny / (nx + ny)

    def likelihood(similarity: np.ndarray) -> np.ndarray:
        p, q = (-np.log1p(-np.clip(w, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE) for w in (u - v * similarity, v - u * similarity))
        rest = np.clip(1 - p - q, 1e-12, 1)
        return more * np.log(np.clip(p, 1e-12, 1)) + less * np.log(np.clip(q, 1e-12, 1)) + same * np.log(rest)

    most = np.minimum(nx, ny) / np.maximum(nx, ny)  # similarity is the sizes' ratio at most
    high = likelihood(np.minimum(least + (1 - least) * np.arange(9)[:, None] / 8, most)).max(0)
    low = likelihood(np.minimum(least * np.arange(25)[:, None] / 24, most)).max(0)
    return (most >= least - 1e-9) & (high >= low - DOUBT)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * intersection >= percent * union; nodes has node, n_shingles and sketch."""
    sides = [nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                x, y = (np.frombuffer(b"".join(rows.column(n).to_pylist()), "<u2").reshape(rows.num_rows, -1) for n in ("sa", "sb"))
                keep = may_reach(x, y, np.asarray(rows.column("na")).astype(float), np.asarray(rows.column("nb")).astype(float), percent / 100)
                yield batch(schema, a=np.asarray(rows.column("a"))[keep], b=np.asarray(rows.column("b"))[keep])

    left = materialise(both.mapInArrow(likely, "a long, b long").distinct())
    sets = materialise(full_sets(docs, left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), words))
    return _starred(left, sets, percent)


def _starred(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with sets alike enough; sets has node and items, a row for each text of a node.

    The pairs of one a are dealt over CELLS cells. The set of a goes to each cell once, before those of
    the cell's b, and a task holds one batch besides it, however many pairs an a has.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("b"), F.lit(CELLS)).cast("int"))
    heads = dealt.select("a", "cell").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "cell", F.lit(0).alias("member"), F.col("a").alias("b"), "items")
    members = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "cell", F.lit(1).alias("member"), "b", "items")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for rows in batches:
            found = []
            a, cell, member, b = (rows.column(c).to_pylist() for c in ("a", "cell", "member", "b"))
            ends, values = rows.column("items").offsets.to_numpy(), rows.column("items").values.to_numpy().view(np.uint64)
            for k in range(rows.num_rows):
                items = values[ends[k] : ends[k + 1]]
                if (a[k], cell[k]) != at:
                    at, heads = (a[k], cell[k]), []
                if member[k]:
                    if any(_alike(x, items, percent) for x in heads):
                        found.append((a[k], b[k]))
                elif not any(np.array_equal(x, items) for x in heads):
                    heads.append(items.copy())
            yield batch(schema, a=[x for x, _ in found], b=[x for _, x in found])

    rows = heads.union(members).repartition(n, "a", "cell").sortWithinPartitions("a", "cell", "member")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets of which neither is empty."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, items): sorted shingle hashes of the documents that wanted names."""
    schema = pa.schema([("node", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for a, b in slices(texts):
                yield batch(schema, node=keys[a:b], items=[x.view(np.int64) for x in shingle_sets(texts[a:b], words)])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    return texts.join(wanted.hint("shuffle_hash"), "node", "left_semi").mapInArrow(run, "node long, items array<long>")


def _possible(rows: pa.RecordBatch, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell that its bucket is the first to bring together, as far as registers and components leave them open; PAIRS or so are looked at together."""
    cross = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    band, block, component, n = (rows.column(c).to_numpy() for c in ("band", "block", "component", "n_shingles"))
    values = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u2").reshape(rows.num_rows, -1)
    n = n.astype(float)
    firsts, seconds, held = [], [], 0
    for k in range(rows.num_rows - 1):
        open_ = (component[k + 1 :] != component[k]) & (np.minimum(n[k], n[k + 1 :]) >= (least - 1e-9) * np.maximum(n[k], n[k + 1 :]))
        if cross:
            open_ &= block[k + 1 :] != block[k]
        seconds.append(np.flatnonzero(open_) + k + 1)
        firsts.append(np.full(len(seconds[-1]), k))
        held += len(seconds[-1])
        if held >= PAIRS or held and k == rows.num_rows - 2:
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            firsts, seconds, held = [], [], 0
            first = (values[a] == values[b]).reshape(len(a), BANDS, ROWS).all(2).argmax(1) == band[0]
            a, b = a[first], b[first]
            likely = may_reach(values[a], values[b], n[a], n[b], least)
            yield a[likely], b[likely]


def _linked(rows: pa.RecordBatch, percent: int) -> list[tuple[int, int]]:
    """Links that connect components of a cell, confirmed on full sets; pairs that are connected are not compared."""
    ends, values = rows.column("items").offsets.to_numpy(), rows.column("items").values.to_numpy().view(np.uint64)
    items, nodes = [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], rows.column("node").to_pylist()
    component = rows.column("component").to_pylist()
    root = {c: c for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for firsts, seconds in _possible(rows, percent / 100):
        for a, b in zip(firsts.tolist(), seconds.tolist(), strict=True):
            x, y = find(component[a]), find(component[b])
            if x != y and _alike(items[a], items[b], percent):
                root[max(x, y)] = min(x, y)
                out.append((nodes[a], nodes[b]))
    return out


def _within_buckets(apart: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket; apart has key, band, node and component."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = apart.join(nodes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node")
    counts = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / ROOM)).cast("int").alias("blocks"))
    placed = apart.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "band", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cells = placed.join(nodes, "node")
    at = ["key", "i", "j"]
    some = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, at):
            found = {k for a, b in _possible(rows, percent / 100) for k in (*a.tolist(), *b.tolist())}
            if found:
                names = rows.column("node").to_pylist()
                yield batch(some, key=[rows.column("key")[0].as_py()] * len(found), node=[names[k] for k in found])

    wanted = materialise(cells.repartition(n, *at).sortWithinPartitions(*at, "node").mapInArrow(possible, "key long, node long").distinct())
    sets = materialise(full_sets(docs, wanted.select("node").distinct(), words))
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, at):
            found = _linked(rows, percent)
            yield batch(links, a=[a for a, _ in found], b=[b for _, b in found])

    rest = cells.join(wanted, ["key", "node"], "left_semi").join(sets, "node")
    return rest.repartition(n, *at).sortWithinPartitions(*at, "node").mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    rows = materialise(sketches(docs, words))
    named = rows.filter("doc_id is not null and sketch is not null")
    sets = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    members = materialise(rows.select("doc_id", "n_shingles", "digest").join(sets, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")))
    nodes = named.join(sets, "digest").filter("doc_id = node").select("node", "n_shingles", "sketch")

    keys = band_keys(nodes)
    heads = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("one"), F.min(F.col("node").bitwiseXOR(_MASK)).bitwiseXOR(_MASK).alias("two"))
    buckets = materialise(keys.join(heads.filter("n > 1"), "key").select("key", "band", "node", "one", "two"))
    star = buckets.select(F.explode(F.array("one", "two")).alias("a"), F.col("node").alias("b")).filter("a != b")
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    again = members.filter("node is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("doc_id")
    same = members.join(again, "doc_id", "left_semi").filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = materialise(confirmed(star, nodes, docs, words, percent).union(same))
    first = components(links)

    placed = buckets.select("key", "band", "node").join(first, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    apart = materialise(placed.join(mixed, "key", "left_semi"))
    found = components(links.union(_within_buckets(apart, nodes, docs, words, percent)))

    out = members.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
