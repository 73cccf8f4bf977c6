"""What the operators of this package share: scratch tables, partition counts, batches of text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.session import ship

#: Folder used where the session names none (tests, a laptop); removed at exit.
_OWN: list[str] = []

#: Rows in an Arrow batch. Texts are long, so that the default of 10,000 would hold too much at once.
ROWS_PER_BATCH = 1000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; only a local session may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="weftline-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: computed once, and safe from lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors, once, and keeps Arrow batches of whole texts to a few MB."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def partitions(spark: SparkSession, df: DataFrame, mb: float = 32) -> int:
    """Partitions for a shuffle of what df reads: its size in the plan's statistics by mb, the session's number at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 10**17 else 0  # Spark's stand-in for a size that it doesn't know
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(200_000, int(size / (mb * 1e6)) + 1))


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts that together hold about that many characters, so that word lists stay small."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by keys, one record batch for each group of them; holds a group and a batch at most."""
    left: list[pa.RecordBatch] = []
    last: tuple | None = None
    for rows in batches:
        if not rows.num_rows:
            continue
        columns = [rows.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        at = [*np.flatnonzero(new).tolist(), rows.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if left and key != last:
                yield _whole(left)
                left = []
            left.append(rows.slice(a, b - a))
            last = key
    if left:
        yield _whole(left)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
