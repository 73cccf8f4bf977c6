"""Exact top-k by inner product with an M-tree, best first.

Vectors are turned into integers, floor(scale * x). With one more coordinate, sqrt(most - |x|^2), all
vectors of a tree have the same length, so that a larger inner product is a smaller distance and a
metric tree finds it. A tree's pages hold routing objects with covering radius and distance to the
parent's routing object; leaf pages hold vectors with that distance. Search takes pages in the order
of the least distance they can hold and leaves out, by the triangle inequality and stored distances,
entries whose distance need not even be computed. Bounds have slack for rounding; scores are integers.

Rows are dealt evenly to trees of about TREE rows, queries to blocks; each tree meets each block in
one task, and the best of all trees are merged. That is all queries against all rows, which the task
asks for, in blocks of bounded size.

Odd rows: vectors null, empty or holding null or non-finite components, and null ids, take no part, nor
do vectors so long that scores would not fit a long (squared length of the integers from 2**62 on); an
empty table gives an empty result, other columns are not read; vectors of different lengths do not meet; a query is never its own candidate, nor are rows that share its id;
repeated rows are one query and one candidate, of an id with several vectors the best score counts;
fewer candidates than k give fewer ranks; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batch, materialise, prepare

#: Entries of a page, rows of a tree, queries of a block. A page is compared at once, so that it pays to be large.
PAGE, TREE, QUERIES = 256, 8192, 4096
#: Vectors whose squared length is below this have scores that fit a long (by Cauchy and Schwarz).
LARGEST = 2.0**62


class MTree:
    """pages: (is_leaf, entries, distances to the page's routing object, covering radii, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.repeats = len(np.unique(ids)) < len(ids)
        self.most = float((vectors.astype(np.float64) ** 2).sum(1).max())
        self._lift()
        self.pages: list[tuple] = []
        self._random = np.random.default_rng(11)
        self.root = self._build(np.arange(len(ids)), None)

    def __getstate__(self) -> dict:
        """Without the lifted points, which follow from the vectors."""
        return {k: x for k, x in self.__dict__.items() if k not in ("points", "_random")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._lift()

    def _lift(self) -> None:
        norms = (self.vectors.astype(np.float64) ** 2).sum(1)
        self.points = np.concatenate([self.vectors.astype(np.float64), np.sqrt(np.maximum(self.most - norms, 0))[:, None]], 1)

    def _build(self, own: np.ndarray, parent: int | None) -> int:
        """Bulk loading: rows go to the nearest of a page's routing objects, which lie far apart."""
        to_parent = np.zeros(len(own)) if parent is None else self._distance(own, self.points[parent])
        if len(own) <= PAGE:
            self.pages.append((True, own, to_parent, None, None))
            return len(self.pages) - 1
        heads = [int(self._random.integers(len(own)))]
        near = self._distance(own, self.points[own[heads[0]]])
        nearest = np.zeros(len(own), np.int64)
        while len(heads) < min(PAGE, -(-len(own) * 2 // PAGE)) and near.max() > 0:
            heads.append(int(near.argmax()))
            d = self._distance(own, self.points[own[heads[-1]]])
            nearest[d < near] = len(heads) - 1
            near = np.minimum(near, d)
        if len(heads) == 1:  # equal vectors: pages of them, one after the other
            groups = np.array_split(own, min(PAGE, -(-len(own) // PAGE)))
            heads = [0] * len(groups)
            routing = np.array([g[0] for g in groups])
        else:
            groups = [own[nearest == k] for k in range(len(heads))]
            routing = own[heads]
        radii = np.array([self._distance(g, self.points[r]).max() for g, r in zip(groups, routing, strict=True)])
        children = np.array([self._build(g, int(r)) for g, r in zip(groups, routing, strict=True)])
        self.pages.append((False, routing, np.zeros(len(routing)) if parent is None else self._distance(routing, self.points[parent]), radii, children))
        return len(self.pages) - 1

    def _distance(self, own: np.ndarray, point: np.ndarray) -> np.ndarray:
        d = self.points[own] - point
        return np.sqrt((d * d).sum(1))

    def search(self, query: np.ndarray, k: int, own_id: int) -> list[tuple[int, int]]:
        """(score, id) of the best k ids, best first."""
        point = np.append(query.astype(np.float64), 0.0)
        base = float(point @ point) + self.most
        slack = 1e-6 * (1 + base**0.5)
        exact = self.most * float(point @ point) < 2.0**104  # then no score or part of one is over 2**52
        vectors, factor = (self.points[:, :-1], point[:-1]) if exact else (self.vectors, query)
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst on top
        held: dict[int, int] = {}  # its scores by id
        limit = np.inf
        queue: list[tuple[float, int, float]] = [(0.0, self.root, -1.0)]
        while queue:
            least, page, from_parent = heapq.heappop(queue)
            if least > limit:
                break
            leaf, entries, to_parent, radii, children = self.pages[page]
            if from_parent >= 0 and limit < np.inf:
                gap = np.abs(from_parent - to_parent) - (0 if leaf else radii)
                keep = np.flatnonzero(gap <= limit)
            else:
                keep = np.arange(len(entries))
            if not len(keep):
                continue
            if leaf:
                own = entries[keep]
                scores = (vectors[own] @ factor).astype(np.int64)
                names = self.ids[own]
                if (names == own_id).any():
                    names, scores = names[names != own_id], scores[names != own_id]
                if self.repeats:  # the best of each id
                    order = np.lexsort((-scores, names))
                    names, first = np.unique(names[order], return_index=True)
                    scores = scores[order[first]]
                if len(names) > 4 * k:  # of the page's, only the k best and their ties can count
                    high = scores >= np.partition(scores, len(names) - k)[len(names) - k]
                    names, scores = names[high], scores[high]
                if len(best) == k:
                    better = scores >= best[0][0]
                    names, scores = names[better], scores[better]
                for score, name in zip(scores.tolist(), names.tolist(), strict=True):
                    if name in held:
                        if score > held[name]:
                            best.remove((held[name], -name))
                            best.append((score, -name))
                            heapq.heapify(best)
                            held[name] = score
                    elif len(best) < k:
                        heapq.heappush(best, (score, -name))
                        held[name] = score
                    elif (score, -name) > best[0]:
                        del held[-heapq.heapreplace(best, (score, -name))[1]]
                        held[name] = score
                if len(best) == k:
                    limit = max(base - 2.0 * best[0][0], 0.0) ** 0.5 + slack
            else:
                d = self._distance(entries[keep], point)
                low = np.maximum(d - radii[keep], 0.0)
                for x, child, at in zip(low.tolist(), children[keep].tolist(), d.tolist(), strict=True):
                    if x <= limit:
                        heapq.heappush(queue, (x, child, at))
        return [(score, -name) for score, name in sorted(best, reverse=True)]


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, size and packed int64 components of the vectors that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            for key, values in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                if key is None or not values or None in values or not np.isfinite(v := scale * np.array(values, np.float64)).all():
                    continue
                v = np.floor(v)
                if np.abs(v).max() < LARGEST and v @ v < LARGEST:
                    out["vec_id"].append(key)
                    out["size"].append(len(v))
                    out["vector"].append(v.astype(np.int64).tobytes())
            yield batch(schema, **out)

    return vectors.mapInArrow(run, "vec_id long, size int, vector binary")


def _packed(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(-1, size)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each vector whose id is divisible by every."""
    prepare(vectors.sparkSession)
    rows = materialise(_integers(vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")), scale))
    trees = -(-rows.count() // TREE) or 1
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    blocks = -(-queries.count() // QUERIES) or 1

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(pdf["vec_id"].to_numpy(np.int64), _packed(pdf["vector"], key[1]))
        return pd.DataFrame({"tree": [key[0]], "size": [key[1]], "data": [pickle.dumps(tree)]})

    dealt = rows.withColumn("tree", F.pmod(F.monotonically_increasing_id(), F.lit(trees)).cast("int"))
    built = materialise(dealt.groupBy("tree", "size").applyInPandas(build, "tree int, size int, data binary"))
    left = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))

    def search(pages: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(own):
            tree = pickle.loads(pages["data"].iloc[0])
            for name, q in zip(own["vec_id"].tolist(), _packed(own["vector"], int(pages["size"].iloc[0])), strict=True):
                out += [(name, found, score) for score, found in tree.search(q, k, name)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ("tree", "size", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id of several vectors is found in several trees
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
