"""Jobs over ticks: states, lock, batches, rows that fail, scans and refreshes."""

from datetime import datetime

import pytest

from weftline.operators import schedule
from weftline.operators.store import KeyedTable


@pytest.fixture
def progress(spark, tmp_path):
    return schedule.Progress(spark, f"file://{tmp_path}/job")


def test_states(progress):
    assert progress.read()["state"] == "idle" and progress.percent() == 100 and progress.pause()["state"] == "idle"
    assert progress.start(3)["state"] == "running" and progress.percent() == 0 and progress.resume()["state"] == "running"
    assert progress.pause()["state"] == "paused" and progress.write(done=1)["state"] == "paused" and progress.percent() == 33
    assert progress.resume()["state"] == "running" and progress.stop() == schedule.IDLE


def test_lock(progress):
    assert progress.claim("a", 1000) and not progress.claim("b", 1100) and progress.claim("a", 1100)
    assert progress.claim("b", 1221)
    progress.release("a")
    assert not progress.claim("a", 1222)
    progress.release("b")
    assert progress.claim("a", 1222)


def test_ticks_pass_rows_that_fail(spark, progress):
    rows, done = spark.range(1, 12).withColumnRenamed("id", "post_id"), []

    def step(batch):
        keys = sorted(r["post_id"] for r in batch.collect())
        if 4 in keys:
            raise ValueError("page 4 can't be read")
        done.extend(keys)

    assert schedule.tick(progress, rows, "post_id", step, "a", 0, 3, 2)["state"] == "idle" and not done
    progress.start(11)
    assert schedule.tick(progress, rows, "post_id", step, "a", 0, 3, 2)["cursor"] == 6 and sorted(done) == [1, 2, 3, 5, 6]
    assert [tuple(r) for r in progress.failed.read().collect()] == [("4", "page 4 can't be read")]
    progress.pause()
    assert schedule.tick(progress, rows, "post_id", step, "a", 0, 3, 2)["cursor"] == 6
    progress.resume()
    progress.claim("b", 0)
    assert schedule.tick(progress, rows, "post_id", step, "a", 1, 3, 2)["cursor"] == 6
    state = schedule.tick(progress, rows, "post_id", step, "a", 500, 3, 5)
    assert (state["state"], state["done"]) == ("complete", 11) and sorted(done) == [k for k in range(1, 12) if k != 4] and progress.percent() == 100


def test_a_job_that_is_stopped_ends_after_the_batch(spark, progress):
    progress.start(9)
    state = schedule.tick(progress, spark.range(9), "id", lambda batch: progress.stop(), "a", 0, 3, 5)
    assert state == schedule.IDLE


def test_scans_begin_without_pending_proposals(spark, progress, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/p", ["id"])
    table.upsert(spark.createDataFrame([(1, "pending"), (2, "applied"), (3, None)], "id long, status string"))
    assert schedule.start_scan(progress, table, spark.range(5))["total"] == 5
    assert sorted(r["id"] for r in table.read().collect()) == [2, 3]


def test_refreshes_are_daily():
    noon = datetime(2024, 1, 2, 12)
    assert schedule.due(None, noon) and schedule.due(datetime(2024, 1, 1, 12), noon) and not schedule.due(datetime(2024, 1, 1, 13), noon) and not schedule.due(None, noon, enabled=False)
