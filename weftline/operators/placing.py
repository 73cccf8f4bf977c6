"""The first phrase of a target that stands in a source's text, for pairs of sources and targets.

A target has many sources, so a join would write its phrases once for each pair, and texts that travel to
their pairs take more disk than they do in their table. Here phrases and pairs are written once, in files in
the folder that driver and executors share; each task reads texts where they lie, a group at a time, and the
pairs and phrases that belong to the group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import scratch_dir, ship

#: Pages of a group of sources, bytes of their texts, and pages of a block of targets.
SOURCES, BYTES, TARGETS = 4_000, 32_000_000, 50_000


class Phrases:
    """Texts, whose words stand between single spaces, and the phrases that stand in them."""

    def __init__(self, texts: pa.Array, rows: np.ndarray, sizes: range):
        """rows: a number for each text."""
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        self.known, self.sizes = coded.dictionary, sizes
        self.words = coded.indices.to_numpy().astype(np.int64)
        self.rows = np.repeat(rows, pc.list_value_length(words).to_numpy())

    def hits(self, phrases: pa.Array) -> np.ndarray:
        """row * len(phrases) + the place of the phrase, ascending, for each row whose texts hold it."""
        words = pc.split_pattern(phrases, " ")
        lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
        codes = pc.index_in(words.flatten(), value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        v, out = max(1, len(self.known)), [np.zeros(0, np.int64)]
        live = np.flatnonzero((lengths >= 1) & (lengths < self.sizes.stop))  # phrases that are not ruled out, and the number of their words so far
        live = live[codes[begins[live]] >= 0]
        run = codes[begins[live]]
        first = np.zeros(v, bool)
        first[run] = True
        at = np.flatnonzero(first[self.words])  # where such words begin in the texts, and the number of those
        here = self.words[at]
        for n in range(1, self.sizes.stop):
            if n in self.sizes:
                own = lengths[live] == n
                order = np.argsort(run[own], kind="stable")
                runs, numbers = run[own][order], live[own][order]
                left, right = np.searchsorted(runs, here), np.searchsorted(runs, here, "right")  # phrases are distinct, so one at most
                found = left < right
                out.append(self.rows[at[found]] * len(phrases) + numbers[left[found]])
            more = lengths[live] > n
            live, run = live[more], run[more]
            word = codes[begins[live] + n]
            live, keys = live[word >= 0], (run * v + word)[word >= 0]
            on = at + n < len(self.words)
            at, here = at[on], here[on]
            same = self.rows[at + n] == self.rows[at]
            at, here = at[same], here[same] * v + self.words[at[same] + n]
            known, run = np.unique(keys, return_inverse=True)
            if not len(known):
                break
            place = np.minimum(np.searchsorted(known, here), len(known) - 1)
            found = known[place] == here
            at, here = at[found], place[found]
        return np.unique(np.concatenate(out))


def _blocks(lists: DataFrame) -> list[str]:
    """Files of lists (post_id, phrases, spelled) in the shared folder."""
    folder = scratch_dir(lists.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            system, at = fs.FileSystem.from_uri(folder)
            system.create_dir(at, recursive=True)
            name, table = uuid.uuid4().hex, pa.Table.from_batches(held).sort_by("post_id")
            with system.open_output_stream(f"{at}/{name}") as out, pa.ipc.new_file(out, table.schema) as file:
                file.write_table(table)
            held.clear()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"]})

        for rows in batches:
            held.append(rows)
            if sum(r.num_rows for r in held) >= TARGETS:
                yield put()
        if held:
            yield put()

    return [r["file"] for r in lists.mapInArrow(run, "file string").collect()]  # a row for each block


def _pair_files(pairs: DataFrame) -> list[tuple[str, int, int]]:
    """Files of pairs in the shared folder, by source, with their smallest and greatest source."""
    folder = scratch_dir(pairs.sparkSession)
    pairs.repartitionByRange("source_id").sortWithinPartitions("source_id", "rank").write.option("parquet.block.size", 4 << 20).parquet(folder)
    sides = pairs.sparkSession.read.parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.min("source_id"), F.max("source_id"))
    return [tuple(r) for r in sides.collect()]  # a row for each file


def _pairs_of(files: list[tuple[str, int, int]], ids: np.ndarray) -> pa.Table:
    """The pairs of sources, which are sorted, in their order."""
    low, high, found = int(ids[0]), int(ids[-1]), []
    for file, least, most in files:
        own = ids[np.searchsorted(ids, least) : np.searchsorted(ids, most, "right")]
        if len(own):
            system, at = fs.FileSystem.from_uri(unquote(file) if file.startswith("file:") else file)
            source = pc.field("source_id")
            data = dataset.dataset(at, format="parquet", filesystem=system)
            found.append(data.to_table(["source_id", "target_id", "score", "rank"], filter=(source >= low) & (source <= high) & source.isin(pa.array(own))))
    return pa.concat_tables(found).combine_chunks().sort_by("source_id") if found else None


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows whose last column is a text, in groups of bounded size, in one piece; without those that have no text."""
    held: list[pa.RecordBatch] = []

    def put() -> pa.Table:
        table = pa.Table.from_batches(held)
        held.clear()
        return table.filter(pc.is_valid(table[table.num_columns - 1])).combine_chunks()

    for batch in batches:
        for rows in (batch.slice(k, 250) for k in range(0, batch.num_rows, 250)):
            held.append(rows)
            if sum(r.num_rows for r in held) >= SOURCES or sum(r.nbytes for r in held) >= BYTES:
                yield put()
    if held:
        yield put()


def _small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # whole texts


def standing(bodies: DataFrame, needles: list[str]) -> DataFrame:
    """source_id, lang_code, needle: for each row of bodies (post_id, lang_code, body) the needles that its body holds.

    Bodies and needles begin and end with a space; needles are few and distinct.
    """
    spark = bodies.sparkSession
    ship(spark)
    _small_batches(spark)
    most = max((n.count(" ") for n in needles), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = pa.array([n[1:-1] for n in needles], pa.string())
        for texts in _groups(batches):
            if len(texts) and needles:
                row, phrase = np.divmod(Phrases(texts["body"].combine_chunks(), np.arange(len(texts)), range(1, most)).hits(phrases), len(phrases))
                found = texts.take(pa.array(row)).combine_chunks()
                yield from pa.table({"source_id": found["post_id"], "lang_code": found["lang_code"], "needle": pa.array(needles).take(pa.array(phrase))}).to_batches()

    return bodies.select("post_id", "lang_code", "body").mapInArrow(run, "source_id long, lang_code string, needle string")


def first_placed(pairs: DataFrame, bodies: DataFrame, lists: DataFrame, sizes: range) -> DataFrame:
    """source_id, target_id, score, rank, phrase of the pairs of which a phrase stands in the source's text.

    pairs: source_id, target_id, score, rank; bodies: post_id, body, with words between single spaces;
    lists: a row for each target with post_id, phrases, in order, and spelled, the same as they would stand
    in a body; sizes: how many words a phrase may have.
    """
    spark = pairs.sparkSession
    ship(spark)
    _small_batches(spark)
    files = _blocks(lists.select("post_id", "phrases", "spelled"))
    if not files or pairs.isEmpty():
        return spark.createDataFrame([], "source_id long, target_id long, score double, rank int, phrase string")
    kept = _pair_files(pairs.select("source_id", "target_id", F.col("score").cast("double"), F.col("rank").cast("int")))

    def place(texts: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = texts.filter(pc.is_valid(texts["post_id"]))
        ids, row = np.unique(texts["post_id"].to_numpy(), return_inverse=True)
        found = _pairs_of(kept, ids) if len(ids) else None
        if found is None or not len(found):
            return
        source, target = np.searchsorted(ids, found["source_id"].to_numpy()), found["target_id"].to_numpy()
        text = Phrases(texts["body"].combine_chunks(), row.astype(np.int64), sizes)
        for file in files:
            system, at = fs.FileSystem.from_uri(file)
            with system.open_input_file(at) as data:
                block = pa.ipc.open_file(data).read_all()
            known = block["post_id"].to_numpy()
            where = np.minimum(np.searchsorted(known, target), len(known) - 1)
            own = np.flatnonzero(known[where] == target)
            rows, back = np.unique(where[own], return_inverse=True)
            lists = block.take(pa.array(rows)).combine_chunks()
            if not len(rows):
                continue
            spelled = lists["spelled"].combine_chunks()
            lengths = pc.list_value_length(spelled).fill_null(0).to_numpy().astype(np.int64)
            coded = spelled.flatten().dictionary_encode()
            code, begins = coded.indices.to_numpy().astype(np.int64), np.cumsum(lengths) - lengths
            hits = text.hits(coded.dictionary)
            pair = np.repeat(np.arange(len(own)), lengths[back])
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(lengths[back]) - lengths[back], lengths[back])
            at = np.repeat(begins[back], lengths[back]) + nth
            keys = source[own][pair] * len(coded.dictionary) + code[at]
            there = np.minimum(np.searchsorted(hits, keys), len(hits) - 1)
            stands = np.flatnonzero(hits[there] == keys) if len(hits) else np.zeros(0, np.int64)
            _, first = np.unique(pair[stands], return_index=True)  # of each pair the first phrase that stands there
            stands = stands[first]
            got = found.take(pa.array(own[pair[stands]])).append_column("place", pa.array(nth[stands].astype(np.int32))).append_column("phrase", lists["phrases"].combine_chunks().flatten().take(pa.array(at[stands])))
            yield from got.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _groups(batches):
            yield from place(texts)

    hits = bodies.select("post_id", "body").mapInArrow(run, "source_id long, target_id long, score double, rank int, place int, phrase string")
    return hits.groupBy("source_id", "target_id", "score", "rank").agg(F.min_by("phrase", "place").alias("phrase"))  # texts that share an id may lie in several groups
