"""Incremental modes: pages are indexed again only if their content changed, usage adds up as it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.store import KeyedTable


def guarded(rows: DataFrame, column: str, make: Callable[[str | None], str | None]) -> DataFrame:
    """rows with `made`, what make gives for the column, and `error`: what it raised for this row, else null."""

    def run(value: str | None) -> tuple[str | None, str | None]:
        try:
            return make(value), None
        except Exception as problem:  # whatever is wrong is wrong with this row
            return None, f"{type(problem).__name__}: {problem}"[:500]

    found = F.udf(run, "made string, error string", useArrow=True).asNondeterministic()  # run once a row
    return rows.withColumn("_found", found(column)).select("*", "_found.made", "_found.error").drop("_found")


def index_pages(changes: DataFrame, table: KeyedTable, checkpoint: str, make: Callable[[str | None], str | None] | None = None, failed: KeyedTable | None = None) -> StreamingQuery:
    """A stream of post_id, parsed_text, deleted into a keyed table; rows whose content hash is known are passed over.

    make turns the text of a page into what is kept. A page that it fails for stops no other and keeps
    the row it had; it goes to `failed` (post_id, content_hash, error) until it comes again and succeeds.
    """

    def apply(rows: DataFrame, _: int) -> None:
        rows = rows.withColumn("content_hash", F.md5(F.coalesce("parsed_text", F.lit("")))).persist()
        gone = rows.filter("deleted").select("post_id")
        kept = rows.filter("NOT deleted").drop("deleted")
        old = table.read()
        if old is not None:
            kept = kept.join(old.select("post_id", "content_hash"), ["post_id", "content_hash"], "left_anti")
        if make:
            tried = guarded(kept, "parsed_text", make).persist()
            kept = tried.filter("error IS NULL").withColumn("parsed_text", F.col("made")).drop("made", "error")
            if failed is not None:
                failed.delete(rows.select("post_id"))
                failed.upsert(tried.filter("error IS NOT NULL").select("post_id", "content_hash", "error"))
        if not kept.isEmpty():
            table.upsert(kept)
        if not gone.isEmpty():
            table.delete(gone)
        if make:
            tried.unpersist()
        rows.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage(log: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Requests and tokens by time window, provider and model; works for a table and, with late rows up to a bound, for a stream."""
    log = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = log.withWatermark("created_at", late) if log.isStreaming else log
    return rows.filter("operation <> 'error'").groupBy(F.window("created_at", window), "provider", "model").agg(
        F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )
