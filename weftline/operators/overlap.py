"""Best targets of each source by weighted overlap of their terms, in groups of sources against blocks of targets.

A term that stands in many pages pairs each with each, so a join on terms makes far more rows than it
keeps, and blocks that travel to every group of sources are written as often as there are groups. Here
the posting lists of a block of targets are written once, to the folder that driver and executors share,
and each task, which has a group of sources, reads them one after the other; only the best targets of a
source leave the task. Groups and blocks have a bounded size, whatever the table.

Within a block the rare terms of a source are added up over all targets. Its frequent terms, which have a
row of their own in the block, are added in whole numbers, rounded up: a bound that costs little. Targets
whose bound can't reach a place among the best k are left out, the others' scores are added up exactly.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import scratch_dir, ship

#: Pages of a group of sources, of a block of targets, and of all blocks that a task holds before it writes one.
SOURCES, TARGETS, HELD = 2_000, 32_000, 48_000
#: Terms of a file of weights.
WEIGHTS = 1_000_000
#: Terms of one target in so many have a row in their block.
FREQUENT = 16


def _file_system(uri: str):
    return fs.FileSystem.from_uri(uri)


class Block:
    """Posting lists of some pages: keys, sorted, and for each the places of its pages, ascending, and how often they have it."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, begins: np.ndarray, places: np.ndarray, tf: np.ndarray):
        self.ids, self.keys, self.begins, self.places, self.tf = ids, keys, begins, places, tf

    @classmethod
    def build(cls, ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, tf: np.ndarray) -> Block:
        """ids of pages, how many terms each has, and those of one page after the other."""
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        rank[by_id] = np.arange(len(ids))
        place = np.repeat(rank, sizes)
        order = np.lexsort((place, numbers))
        keys, begins = np.unique(numbers[order], return_index=True)
        small = np.uint16 if not len(tf) or tf.max() < 1 << 16 else np.int64
        return cls(ids[by_id], keys, np.append(begins, len(order)), place[order], tf[order].astype(small))

    def write(self, folder: str) -> str:
        system, at = _file_system(folder)
        system.create_dir(at, recursive=True)
        name, held = uuid.uuid4().hex, io.BytesIO()
        np.savez(held, ids=self.ids, keys=self.keys, begins=self.begins, places=self.places, tf=self.tf)
        with system.open_output_stream(f"{at}/{name}") as out:
            out.write(held.getbuffer())
        return f"{folder}/{name}"

    @classmethod
    def read(cls, uri: str) -> Block:
        system, at = _file_system(uri)
        with system.open_input_stream(at) as file:
            return cls(**np.load(io.BytesIO(file.readall())))

    def narrowed(self, numbers: np.ndarray) -> Held:
        return Held(self, numbers)


class Held:
    """A block as seen by sources whose terms are numbers, sorted: lists by their place there, and rows of the frequent ones."""

    def __init__(self, block: Block, numbers: np.ndarray):
        at = np.searchsorted(block.keys, numbers)
        known = at < len(block.keys)
        known[known] = block.keys[at[known]] == numbers[known]
        at = np.where(known, at, 0)
        self.ids, self.places, self.tf = block.ids, block.places, block.tf
        self.begins, self.sizes = np.where(known, block.begins[at], 0), np.where(known, block.begins[at + 1] - block.begins[at], 0)
        often = np.flatnonzero(self.sizes * FREQUENT > len(block.ids))
        self.row = np.full(len(numbers), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(block.ids)), block.tf.dtype)
        for n, k in enumerate(often):
            own = slice(self.begins[k], self.begins[k] + self.sizes[k])
            self.rows[n, self.places[own]] = self.tf[own]

    def scores(self, terms: np.ndarray, tf: np.ndarray, idf: np.ndarray, norm: float, own_id: int, best: tuple, k: int, min_shared: int) -> tuple:
        """(ids, shared, scores) of the best k among best and this block."""
        def least(found: tuple) -> float:
            """What a target's sum must reach to be among the k; those of the same score count if their id may be smaller."""
            if len(found[0]) < k:
                return -1.0
            return (found[2][-1] + (0.49999e-4 if self.ids[0] > found[0][-1] else -0.50001e-4)) * norm

        low = least(best)
        if low >= (1 + 0.4e-4) * norm:
            return best
        n, row = len(self.ids), self.row[terms]
        rare, often = np.flatnonzero(row < 0), np.flatnonzero(row >= 0)
        sizes = self.sizes[terms[rare]]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[terms[rare]] - ends + sizes, sizes)
        place = self.places[at]
        total = np.bincount(place, np.repeat(idf[rare], sizes) * np.minimum(np.repeat(tf[rare], sizes), self.tf[at]), n).astype(float, copy=False)
        counted = np.bincount(place, minlength=n)
        row, weight, most = row[often], idf[often], tf[often]

        def whole(found: np.ndarray) -> tuple:
            there = self.rows[row[:, None], found]
            counts = counted[found] + (there > 0).sum(0)
            keep = (counts >= min_shared) & (self.ids[found] != own_id)
            sums = total[found] + weight @ np.minimum(there, most[:, None])
            scores = np.floor(np.minimum(1.0, sums[keep] / norm) * 1e4 + 0.5) / 1e4
            ids, counts, scores = (np.concatenate(x) for x in zip(best, (self.ids[found[keep]], counts[keep], scores), strict=True))
            first = np.lexsort((ids, -scores))[:k]
            return ids[first], counts[first], scores[first]

        if n <= 8 * k or self.rows.dtype != np.uint16 or tf.sum() > 30_000:
            return whole(np.arange(n))
        scale = (65_533 - tf.sum()) / norm  # no bound is over 65,535, as none of the sums is over norm
        bound, own = (total * scale + 1).astype(np.uint16), np.empty(n, np.uint16)
        for r, w, m in zip(row, np.ceil(weight * scale).astype(np.uint16), most.astype(np.uint16), strict=True):
            own.fill(m)  # an array, as numpy is slow with the minimum of an array and a number
            np.minimum(self.rows[r], own, out=own)
            np.multiply(own, w, out=own)
            np.add(bound, own, out=bound)
        if low < 0:  # nothing known yet: those of the highest bounds give one
            low = least(whole(np.flatnonzero(bound >= np.partition(bound, n - 2 * k)[n - 2 * k])))
        found = np.flatnonzero(bound >= int(max(0.0, low) * scale))
        return whole(found) if len(found) else best


def _blocks(targets: DataFrame, pages: int) -> list:
    """Rows lang_code, file: the blocks of targets (post_id, lang_code, numbers, tfs), written to the shared folder."""
    folder = scratch_dir(targets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def put(lang: str) -> pa.RecordBatch:
            ids, sizes, numbers, tf = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            return pa.RecordBatch.from_pydict({"lang_code": [lang], "file": [Block.build(ids, sizes, numbers, tf).write(folder)]})

        for rows in batches:
            table = pa.Table.from_batches([rows])
            for lang in pc.unique(table["lang_code"]).to_pylist():
                own = table.filter(pc.equal(table["lang_code"], lang)).combine_chunks()
                flat = [pc.list_flatten(own[c]).to_numpy().astype(np.int64) for c in ("numbers", "tfs")]
                held.setdefault(lang, []).append((own["post_id"].to_numpy().astype(np.int64), pc.list_value_length(own["numbers"]).to_numpy().astype(np.int64), *flat))
                if sum(len(x[0]) for x in held[lang]) >= TARGETS:
                    yield put(lang)
            while (counts := {x: sum(len(p[0]) for p in parts) for x, parts in held.items()}) and sum(counts.values()) > HELD:
                yield put(max(counts, key=counts.get))
        for lang in list(held):
            yield put(lang)

    return targets.coalesce(max(1, -(-pages // HELD))).mapInArrow(run, "lang_code string, file string").collect()  # a row for each block


def best_overlaps(sources: DataFrame, targets: DataFrame, weights: DataFrame, k: int, min_shared: int = 2) -> DataFrame:
    """best_of_pages() of rows of single terms.

    sources: post_id, lang_code, term, tf, idf; targets: post_id, lang_code, term, tf; weights: term and a
    number other than 0 for each term that more than one page has (others are shared by none).
    """
    numbered = weights.filter("number != 0").toDF("term", "number")
    lists = targets.join(numbered, "term").groupBy("post_id", "lang_code").agg(F.collect_list(F.struct("number", "tf")).alias("list"))
    return best_of_pages(sources.join(numbered, "term", "left").na.fill(0, ["number"]), lists.selectExpr("post_id", "lang_code", "list.number AS numbers", "list.tf AS tfs"), k, min_shared)


def best_of_pages(sources: DataFrame, targets: DataFrame, k: int, min_shared: int = 2) -> DataFrame:
    """source_id, target_id, shared, score, rank: of each source the k targets of its language with the highest score.

    sources: post_id, lang_code, number, tf, idf, a row for each term; number stands for the term and is 0
    if no other page has it. targets: a row for each page with post_id, lang_code and the arrays numbers
    and tfs of its terms. The score is the sum of idf * the smaller tf over shared terms by the source's sum
    of idf * tf, 1 at most, to four places; ties go to the smaller id; fewer than min_shared terms make no pair.
    """
    counts = sources.select("lang_code", "post_id").distinct().groupBy("lang_code").count()
    return _by_groups(sources.select("lang_code", "post_id", "number", "tf", "idf"), counts, targets, lambda rows: rows, k, min_shared)


def best_of_lists(sources: DataFrame, targets: DataFrame, weights: DataFrame, single: float | None, k: int, min_shared: int = 2) -> DataFrame:
    """best_of_pages() of sources that are rows of pages, as targets are: post_id, lang_code, numbers, tfs.

    weights: number and idf of each term that more than one page has, idf null for those that don't count; single is
    the idf of all others. Weights are written once, as blocks are, so that no term is shuffled to meet its own.
    """
    ship(sources.sparkSession)
    files = _weight_files(weights)

    def weighed(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["numbers"].map(len).to_numpy(np.int64)
        numbers, tf = (np.concatenate([np.zeros(0, np.int64), *rows[c]]).astype(np.int64) for c in ("numbers", "tfs"))
        known, idf = np.zeros(len(numbers), bool), np.full(len(numbers), np.nan if single is None else single)
        for file in files:
            keys, own = _read_weights(file)
            at = np.minimum(np.searchsorted(keys, numbers), len(keys) - 1)
            found = keys[at] == numbers
            idf[found] = own[at[found]]
            known |= found
        out = pd.DataFrame({"lang_code": np.repeat(rows["lang_code"].to_numpy(object), sizes), "post_id": np.repeat(rows["post_id"].to_numpy(np.int64), sizes), "number": np.where(known, numbers, 0), "tf": tf, "idf": idf})
        return out[~np.isnan(idf)]

    sources = sources.filter("post_id IS NOT NULL AND size(numbers) > 0")
    return _by_groups(sources.select("lang_code", "post_id", "numbers", "tfs"), sources.groupBy("lang_code").count(), targets, weighed, k, min_shared)


def _weight_files(weights: DataFrame) -> list[str]:
    """Files of number and idf, by number, in the shared folder; none is empty."""
    folder = scratch_dir(weights.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            system, at = _file_system(folder)
            system.create_dir(at, recursive=True)
            name, out = uuid.uuid4().hex, io.BytesIO()
            numbers, idf = (np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in held]) for c in (0, 1))
            order = np.argsort(numbers, kind="stable")
            np.savez(out, numbers=numbers[order].astype(np.int64), idf=idf[order].astype(float))
            with system.open_output_stream(f"{at}/{name}") as file:
                file.write(out.getbuffer())
            held.clear()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"]})

        for rows in batches:
            held += [rows] if rows.num_rows else []
            if sum(r.num_rows for r in held) >= WEIGHTS:
                yield put()
        if held:
            yield put()

    return [r["file"] for r in weights.select("number", "idf").mapInArrow(run, "file string").collect()]  # a row for each file


def _read_weights(uri: str) -> tuple[np.ndarray, np.ndarray]:
    system, at = _file_system(uri)
    with system.open_input_stream(at) as file:
        held = np.load(io.BytesIO(file.readall()))
        return held["numbers"], held["idf"]


def _by_groups(sources: DataFrame, counts: DataFrame, targets: DataFrame, rows_of: Callable[[pd.DataFrame], pd.DataFrame], k: int, min_shared: int) -> DataFrame:
    """best_of_pages() of sources with lang_code and post_id, of which rows_of makes the rows of single terms; counts: how many pages a language has, or more."""
    spark = sources.sparkSession
    ship(spark)
    targets = targets.filter("lang_code IS NOT NULL AND post_id IS NOT NULL")
    files: dict[str, list[str]] = {}
    for r in _blocks(targets.select("post_id", "lang_code", "numbers", "tfs"), targets.count()):
        files.setdefault(r["lang_code"], []).append(r["file"])

    def score(found: pd.DataFrame) -> pd.DataFrame:
        rows = rows_of(found)
        rows = rows.sort_values(["post_id", "number"], kind="stable")
        norms = rows["idf"] * rows["tf"]
        page = rows["post_id"].to_numpy(np.int64)
        first = np.flatnonzero(np.append(True, page[1:] != page[:-1])) if len(page) else np.zeros(0, np.int64)
        pages, norm = page[first], np.add.reduceat(norms.to_numpy(float), first) if len(page) else np.zeros(0)
        rows = rows[rows["number"] != 0]
        page = np.searchsorted(pages, rows["post_id"].to_numpy(np.int64))
        at = np.searchsorted(page, np.arange(len(pages) + 1))
        numbers, terms = np.unique(rows["number"].to_numpy(np.int64), return_inverse=True)
        tf, idf = rows["tf"].to_numpy(np.int64), rows["idf"].to_numpy(float)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(pages)
        for file in files.get(rows["lang_code"].iloc[0], []) if len(rows) else []:
            block = Block.read(file).narrowed(numbers)
            for p in range(len(pages)):
                own = slice(at[p], at[p + 1])
                best[p] = block.scores(terms[own], tf[own], idf[own], norm[p], pages[p], best[p], k, min_shared)
        sizes = [len(b[0]) for b in best]
        columns = [np.concatenate([np.zeros(0, kind), *(b[c] for b in best)]) for c, kind in enumerate((np.int64, np.int64, float))]
        return pd.DataFrame({"source_id": np.repeat(pages, sizes), "target_id": columns[0], "shared": columns[1], "score": columns[2], "rank": np.concatenate([np.arange(1, s + 1) for s in sizes]) if sizes else []})

    groups = {r["lang_code"]: -(-r["count"] // SOURCES) for r in counts.collect() if r["lang_code"] in files}  # a row for each language
    if not groups:
        return spark.createDataFrame([], "source_id long, target_id long, shared long, score double, rank int")
    sizes = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    dealt = sources.filter(F.col("lang_code").isin(*groups)).withColumn("i", F.pmod(F.xxhash64("post_id"), sizes[F.col("lang_code")]).cast("int"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * sum(groups.values()))
    return dealt.repartition(n, "lang_code", "i").groupBy("lang_code", "i").applyInPandas(score, "source_id long, target_id long, shared long, score double, rank int")
