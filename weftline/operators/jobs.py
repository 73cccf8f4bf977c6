"""Jobs over keyed tables: summaries kept by content, the order of recomputing, states with their guards."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph, index
from weftline.operators.store import KeyedTable


def stale(pages: DataFrame, kept: DataFrame | None, words: int) -> DataFrame:
    """Pages without a summary of their content and of that length; pages: post_id, content_hash and more."""
    if kept is None:
        return pages
    return pages.join(kept.filter(F.col("words") == words), ["post_id", "content_hash"], "left_anti")


def refresh_summaries(table: KeyedTable, pages: DataFrame, make: Callable[[DataFrame], DataFrame], words: int = 40) -> None:
    """Makes the summaries that are missing or out of date, and no others; make: pages to (post_id, summary)."""
    todo = stale(pages, table.read(), words).persist()
    if not todo.isEmpty():
        table.upsert(make(todo).join(todo.select("post_id", "content_hash"), "post_id").withColumn("words", F.lit(words)))
    todo.unpersist()


def recompute(nodes: DataFrame, edges: DataFrame, published: DataFrame, seed: int) -> dict[str, DataFrame]:
    """Click depth, PageRank and broken edges, in that order, and then what was kept of them is forgotten."""
    out = {"depth": graph.click_depth(nodes, edges, seed), "rank": graph.scaled(graph.pagerank(nodes, edges)), "broken": edges.join(published.select(F.col("node").alias("target")), "target", "left_anti")}
    index.forget()
    return out


#: Changes of a proposal's state that are allowed: from which states, to which.
MOVES = {
    "approve": (("pending", "rejected", "approved"), "approved"), "reject": (("pending", "approved", "rejected"), "rejected"), "reset": (("pending", "approved", "rejected"), "pending"),
    "claim": (("pending", "approved"), "applying"), "apply": (("applying",), "applied"), "release": (("applying",), "approved"), "undo": (("applied",), "approved"),
}


def fold_states(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """id and status after all events (id, seq, move) in order; a move that the state doesn't allow is passed over."""
    moves = F.array(*[F.struct(F.lit(m).alias("move"), F.array(*map(F.lit, a)).alias("before"), F.lit(b).alias("after")) for m, (a, b) in MOVES.items()])
    queue = events.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "move"))), lambda x: x["move"]).alias("queue"))  # of one proposal

    def stepped(state, move):
        fits = F.filter(moves, lambda m: (m["move"] == move) & F.array_contains(m["before"], state))
        return F.when(F.size(fits) > 0, F.get(fits, 0)["after"]).otherwise(state)

    rows = proposals.join(queue, "id", "left").withColumn("queue", F.coalesce("queue", F.array().cast("array<string>")))
    return rows.select("id", F.aggregate("queue", F.col("status"), stepped).alias("status"))


def restore(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """post_id and content as before the first link that is still in place; ledger: post_id, seq, value_before, removed_at."""
    first = ledger.filter("removed_at IS NULL").groupBy("post_id").agg(F.min_by("value_before", "seq").alias("value_before"))
    return pages.join(first, "post_id", "left").select("post_id", F.coalesce("value_before", "content").alias("content"))


def undo(ledger: DataFrame, content: DataFrame, force: bool = False) -> DataFrame:
    """id and outcome of taking links back: a page that was changed since (another md5) is left alone, unless by force."""
    rows = ledger.join(content, "post_id", "left")
    same = F.md5("content") == F.col("value_after_hash")
    outcome = F.when(F.col("removed_at").isNotNull(), "already_removed").when(F.col("content").isNull(), "source_missing").when(same | F.lit(force), "removed").otherwise("modified_since")
    return rows.select("id", outcome.alias("outcome"))


def missing_columns(df: DataFrame, ddl: str) -> list[str]:
    """Columns that a table's definition names and df hasn't got; key lines of the definition are no columns."""
    return [c for c in columns_of(ddl) if c not in df.columns]


def columns_of(ddl: str) -> list[str]:
    body = re.search(r"\((.*)\)", ddl, re.S)
    lines = [x.strip() for x in (body[1] if body else "").splitlines()]
    return [m[1] for x in lines if (m := re.match(r"`?([a-z_][a-z0-9_]*)`?\s+\S", x)) and not re.match(r"(PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FULLTEXT)\b", x, re.I)]


def drop_retired(spark, names: Sequence[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
