"""Jobs that go on over many ticks: state, a lock, batches in the order of a key, rows that fail set aside."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.store import KeyedTable

#: Seconds for which a lock holds, rows of a batch, batches of a tick.
LOCK, ROWS, BATCHES = 120, 15, 5
IDLE = {"state": "idle", "done": 0, "total": 0, "cursor": None}


class Progress:
    """State of a job in a shared folder: idle, running, paused or complete; rows done of a total; the last key done.

    What failed is in the keyed table `failed` (key, error).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.failed = KeyedTable(spark, f"{self.path}/failed", ["key"])

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _get(self, name: str) -> dict | None:
        system, at = self._at(name)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict, replace: bool = True) -> None:
        system, at = self._at(name)
        out = system.create(at, replace)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def read(self) -> dict:
        return self._get("STATE") or dict(IDLE)

    def write(self, **changes) -> dict:
        state = self.read() | changes
        self._put("STATE", state)
        return state

    def start(self, total: int) -> dict:
        self.failed.truncate()
        return self.write(state="running", done=0, total=total, cursor=None)

    def pause(self) -> dict:
        return self._turn("running", "paused")

    def resume(self) -> dict:
        return self._turn("paused", "running")

    def stop(self) -> dict:
        return self.write(**IDLE)

    def _turn(self, before: str, after: str) -> dict:
        return self.write(state=after) if self.read()["state"] == before else self.read()

    def percent(self) -> int:
        state = self.read()
        return min(100, int(100 * state["done"] / state["total"] + 0.5)) if state["total"] else 100

    def claim(self, holder: str, now: float) -> bool:
        """Takes the lock unless another holds it; a lock older than LOCK seconds is taken over."""
        system, at = self._at("LOCK")
        held = self._get("LOCK")
        if held:
            if held["holder"] != holder and held["until"] > now:
                return False
            system.delete(at, False)
        try:
            self._put("LOCK", {"holder": holder, "until": now + LOCK}, replace=False)
        except Py4JJavaError:  # another was faster
            return False
        return True

    def release(self, holder: str) -> None:
        if (self._get("LOCK") or {}).get("holder") == holder:
            system, at = self._at("LOCK")
            system.delete(at, False)


def tick(progress: Progress, rows: DataFrame, key: str, step: Callable[[DataFrame], None], holder: str, now: float, size: int = ROWS, batches: int = BATCHES) -> dict:
    """Takes a running job on by a few batches of rows after its cursor, in the order of key; step does a batch.

    A batch that fails is done in halves, down to the keys that fail by themselves: they go to `failed`,
    and the cursor passes them. The state after it is returned; a job that is paused or stopped meanwhile
    ends after the batch at hand. step must bear a batch being done again.
    """
    if progress.read()["state"] != "running" or not progress.claim(holder, now):
        return progress.read()
    try:
        for _ in range(batches):
            state = progress.read()
            if state["state"] != "running":
                break
            left = rows if state["cursor"] is None else rows.filter(F.col(key) > state["cursor"])
            keys = sorted({r[0] for r in left.filter(F.col(key).isNotNull()).select(key).orderBy(key).limit(size).collect()})  # size at most
            if not keys:
                progress.write(state="complete")
                break
            if failed := _apart(left, key, keys, step):
                progress.failed.upsert(progress.spark.createDataFrame([(str(k), e) for k, e in failed], "key string, error string"))
            if progress.read()["state"] != "idle":
                progress.write(cursor=keys[-1], done=state["done"] + len(keys))
    finally:
        progress.release(holder)
    return progress.read()


def _apart(left: DataFrame, key: str, keys: list, step: Callable[[DataFrame], None]) -> list[tuple]:
    """Key and error of the keys that step fails for."""
    try:
        step(left.filter(F.col(key).between(keys[0], keys[-1])))
        return []
    except Exception as problem:  # whatever a step raises is the fault of its rows
        if len(keys) == 1:
            return [(keys[0], str(problem)[:500])]
        half = len(keys) // 2
        return _apart(left, key, keys[:half], step) + _apart(left, key, keys[half:], step)


def start_scan(progress: Progress, proposals: KeyedTable, pages: DataFrame) -> dict:
    """Begins a scan anew: proposals that no one has decided on go, and all pages are to be done."""
    if (old := proposals.read()) is not None:
        proposals.overwrite(old.filter("status IS NULL OR status <> 'pending'"))
    return progress.start(pages.count())


def due(last: datetime | None, now: datetime, hours: int = 24, enabled: bool = True) -> bool:
    """Whether a refresh that runs every so many hours is to run now."""
    return enabled and (last is None or now - last >= timedelta(hours=hours))
