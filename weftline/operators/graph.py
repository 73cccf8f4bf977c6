"""Link-graph metrics that need more than one pass: PageRank and click depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import scratch_dir, ship

#: Graphs up to this many edges are ranked by one task, which takes less time than a job for each iteration.
SMALL = 5_000_000


def _checkpoint(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85, small: int = SMALL) -> DataFrame:
    """(node, rank), ranks summing to 1. nodes: node; edges: source, target.

    Edges from or to other nodes are left out, parallel ones count each, what nodes without links hold is
    spread evenly. An empty graph has no ranks.
    """
    nodes = nodes.select(F.col("node").cast("long")).dropna().distinct()
    inner = edges.join(nodes.withColumnRenamed("node", "source"), "source").join(nodes.withColumnRenamed("node", "target"), "target").groupBy("source", "target").agg(F.count("*").alias("times"))
    if inner.limit(small + 1).count() <= small and nodes.limit(small + 1).count() <= small:
        return _small(nodes, inner, iterations, damping)
    return _large(nodes, inner, iterations, damping)


def _small(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"source": [], "target": [], "times": []})])
        own = np.sort(rows.loc[rows["times"] == 0, "source"].to_numpy(np.int64))
        links = rows[rows["times"] > 0]
        n = len(own)
        if not n:
            return
        source, target = (np.searchsorted(own, links[c].to_numpy(np.int64)) for c in ("source", "target"))
        times = links["times"].to_numpy(float)
        out = np.bincount(source, times, n)
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
            rank = (1 - damping) / n + damping * (np.bincount(target, share[source] * times, n) + rank[out == 0].sum() / n)
        yield pd.DataFrame({"node": own, "rank": rank})

    both = nodes.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0).cast("long").alias("times")).union(edges.select("source", "target", "times"))
    ship(nodes.sparkSession)
    return both.repartition(1).mapInPandas(run, "node long, rank double")


def _large(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float) -> DataFrame:
    n = nodes.count()
    out = edges.groupBy("source").agg(F.sum("times").alias("out"))
    links = _checkpoint(edges.join(out, "source").select("source", "target", (F.col("times") / F.col("out")).alias("share")))
    dangling = _checkpoint(nodes.join(out.withColumnRenamed("source", "node"), "node", "left_anti"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(iterations):
        lost = ranks.join(dangling, "node", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        got = links.join(ranks.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(got, "node", "left").select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        if k % 5 == 4:
            ranks = _checkpoint(ranks)
    return ranks


def scaled(ranks: DataFrame) -> DataFrame:
    """score: ranks by which the highest is 100, rounded to four places."""
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top)).select("node", F.round(F.col("rank") * 100 / F.col("top"), 4).alias("score"))  # top is one row


def _small_depth(links: DataFrame, seed: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"source": [], "target": []})])
        own, at = np.unique(np.append(rows.to_numpy(np.int64).ravel(), seed), return_inverse=True)
        source, target = at[:-1].reshape(-1, 2).T
        depth = np.full(len(own), -1, np.int32)
        front = np.array([at[-1]])
        depth[front], step = 0, 0
        while len(front):
            step += 1
            reached = target[np.isin(source, front)]
            front = np.unique(reached[depth[reached] < 0])
            depth[front] = step
        yield pd.DataFrame({"node": own[depth >= 0], "depth": depth[depth >= 0]})

    ship(links.sparkSession)
    return links.repartition(1).mapInPandas(run, "node long, depth int")


def click_depth(nodes: DataFrame, edges: DataFrame, seed: int, small: int = SMALL) -> DataFrame:
    """(node, depth): clicks from the seed, -1 where no path leads; edges are followed whatever nodes they name."""
    links = edges.select(F.col("source").cast("long"), F.col("target").cast("long")).distinct()
    if links.limit(small + 1).count() <= small and nodes.limit(small + 1).count() <= small:
        return nodes.select("node").join(_small_depth(links, seed), "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("depth"))
    links = _checkpoint(links)
    found = nodes.sparkSession.createDataFrame([(seed, 0)], "node long, depth int")
    front, depth = found, 0
    while True:
        depth += 1
        front = links.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct().join(found, "node", "left_anti")
        front = _checkpoint(front.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        found = _checkpoint(found.union(front)) if depth % 20 == 0 else found.union(front)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("depth"))


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from weftline.plans import site

    return tuple(site.view(spark, sf_dir, name) for name in ("graph_nodes", "graph_edges"))


def pagerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 pages that rank highest."""
    return scaled(pagerank(*_views(spark, sf_dir))).orderBy(F.desc("score"), "node").limit(25).select(F.col("node").alias("post_id"), "score")


def click_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_depth(*_views(spark, sf_dir), seed=1).select(F.col("node").alias("post_id"), "depth")


def depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = click_depth(*_views(spark, sf_dir), seed=1)
    return d.agg(F.max("depth").alias("deepest"), F.count_if(F.col("depth") < 0).alias("unreached"), F.count_if(F.col("depth") >= 4).alias("deep"))


def _sql(nodes: str, edges: str) -> dict[str, str]:
    """The same in DuckDB, given queries for nodes and edges."""
    head = f"WITH RECURSIVE nodes AS MATERIALIZED (SELECT DISTINCT node FROM ({nodes}) x), edges AS MATERIALIZED (SELECT source, target FROM ({edges}) y)"
    rank = head + ", inner_edges AS MATERIALIZED (SELECT e.* FROM edges e JOIN nodes a ON a.node = e.source JOIN nodes b ON b.node = e.target), outs AS MATERIALIZED (SELECT source, count(*) AS o FROM inner_edges GROUP BY source), size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT node, 1 / n AS r FROM nodes, size)"
    for k in range(30):
        rank += (
            f", r{k + 1} AS MATERIALIZED (SELECT nodes.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g.got, 0) + lost / n) AS r FROM nodes LEFT JOIN (SELECT target, sum(r / o) AS got FROM inner_edges JOIN outs USING (source)"
            f" JOIN r{k} ON r{k}.node = inner_edges.source GROUP BY target) g ON g.target = nodes.node, size, (SELECT coalesce(sum(r), 0) AS lost FROM r{k} WHERE node NOT IN (SELECT source FROM outs)) l)"
        )
    bfs = head + ", steps AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.target, depth + 1 FROM steps JOIN edges e ON e.source = steps.node WHERE depth < (SELECT count(*) FROM nodes) AND depth < 100), depths AS (SELECT nodes.node AS post_id, coalesce(d, -1) AS depth FROM nodes LEFT JOIN (SELECT node, min(depth) AS d FROM steps GROUP BY node) s ON s.node = nodes.node)"
    return {
        "pagerank_top": rank + " SELECT node AS post_id, round(r * 100 / (SELECT max(r) FROM r30), 4) AS score FROM r30 ORDER BY score DESC, post_id LIMIT 25",
        "click_depth": bfs + " SELECT post_id, depth FROM depths",
        "depth_stats": bfs + " SELECT max(depth) AS deepest, count(*) FILTER (WHERE depth < 0) AS unreached, count(*) FILTER (WHERE depth >= 4) AS deep FROM depths",
    }


def queries() -> dict:
    return {"pagerank_top": pagerank_top, "click_depth": click_depths, "depth_stats": depth_stats}


def oracle_sql() -> dict[str, str]:
    from weftline.plans import site
    from weftline.plans.dialect import Duck

    return _sql(*(site.render(name, Duck()) for name in ("graph_nodes", "graph_edges")))
