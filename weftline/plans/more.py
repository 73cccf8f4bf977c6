"""Queries whose operators need more than SQL: sentences, summaries, links set in pages, usage windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.plans import site
from weftline.plans.dialect import Duck
from weftline.streaming import incremental


_view = site.view


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sentence_rows(_view(spark, sf_dir, "v_index"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = frozenset(r["term"] for r in _view(spark, sf_dir, "site_wide").select("term").collect())  # each in over df_ceiling of the pages, which store stored_terms each: 750 at most
    lists = _view(spark, sf_dir, "page_terms").groupBy("post_id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("tfs")).alias("tfs"))  # a page has one row, but where rows that share an id differ
    return text.summaries(_view(spark, sf_dir, "v_index"), lists, site_wide=common)


def insert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.linked_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), "the", "https://site.test/the/")


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incremental.usage(_view(spark, sf_dir, "v_spend_log"))
    return found.selectExpr("date_format(window.start, 'yyyy-MM-dd') AS day", "provider", "model", "requests", "tokens_in", "tokens_out")


def oracle_sql() -> dict[str, str]:
    """Written for DuckDB apart from the query."""
    log = site.render("v_spend_log", Duck(), whole=True)
    return {
        "usage_windows": f"SELECT strftime(created_at, '%Y-%m-%d') AS day, provider, model, count(*) AS requests, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out FROM ({log}) l WHERE operation <> 'error' GROUP BY ALL"
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (sentences, summaries, insert_links, usage_windows)}
