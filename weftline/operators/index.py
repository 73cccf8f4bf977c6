"""Tables that many queries read, written once: the index of pages, their postings, related pages.

A stored table lies in the session's shared folder and is kept under the files that it was made from
(path, size and time of change), so that new data make a new one; forget() drops what is known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.session import scratch_dir

_STORED: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return path, status.getLen(), status.getModificationTime()


def stored(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> str:
    """The path of a table of that name over these files, made if there is none yet."""
    key = (spark.sparkContext.applicationId, name, *(_state(spark, p) for p in sources))
    if key not in _STORED:
        path = scratch_dir(spark)
        make().write.parquet(path)
        _STORED[key] = path
    return _STORED[key]


def forget(name: str | None = None) -> None:
    """Flushes one table, or all: the next reader makes it anew."""
    for key in [k for k in _STORED if name is None or k[1] == name]:
        del _STORED[key]
