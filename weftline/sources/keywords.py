"""Keyword tables from CSV files, whose columns are found by the names in the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names by role, the first that a file has counts.
ROLES = {"keyword": ("keyword", "query", "top queries", "search term"), "clicks": ("clicks",), "impressions": ("impressions",), "position": ("position", "average position", "avg. position"), "ctr": ("ctr",), "url": ("url", "page", "landing page")}


def _number(c):
    return F.coalesce(F.expr(f"try_cast(regexp_replace(`{c}`, '[%, ]', '') AS DOUBLE)"), F.lit(0.0))


def read_csv(spark: SparkSession, path: str, source: str = "csv") -> DataFrame:
    """keyword, keyword_norm, clicks, impressions, position, ctr (a fraction), url, source; without a keyword column, an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c.strip().lower(): c for c in rows.columns}
    found = {role: next((names[a] for a in aliases if a in names), None) for role, aliases in ROLES.items()}
    if not found["keyword"]:
        raise ValueError("no keyword column")
    keyword = F.trim(F.col(f"`{found['keyword']}`"))
    number = lambda role: _number(found[role]) if found[role] else F.lit(0.0)
    percent = F.col(f"`{found['ctr']}`").contains("%") if found["ctr"] else F.lit(False)
    return rows.select(
        keyword.alias("keyword"), F.substring(F.lower(keyword), 1, 191).alias("keyword_norm"), number("clicks").cast("long").alias("clicks"), number("impressions").cast("long").alias("impressions"),
        number("position").alias("position"), F.when(percent, number("ctr") / 100).otherwise(number("ctr")).alias("ctr"), (F.col(f"`{found['url']}`") if found["url"] else F.lit(None).cast("string")).alias("url"),
        F.lit(source if source in ("gsc", "csv") else "csv").alias("source"),
    ).filter("keyword <> ''")
