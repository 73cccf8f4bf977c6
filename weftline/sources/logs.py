"""Error logs as text files: month, kind, culprit and message of each line that has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MONTHS = {m: f"{k:02d}" for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """month (yyyy-MM), kind, culprit (plugin or theme), message, signature (its digits as N)."""
    line = F.col("value")
    stamp = [F.regexp_extract(line, r"^\[(\d{2})-([A-Z][a-z]{2})-(\d{4})", k) for k in (2, 3)]
    month = F.when(stamp[0] != "", F.concat_ws("-", stamp[1], F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])[stamp[0]]))
    message = F.regexp_extract(line, r"PHP (?:Fatal error|Warning|Notice|Parse error|Deprecated):\s+(.*)$", 1)
    rows = spark.read.text(path).select(
        month.alias("month"), F.regexp_extract(line, r"PHP (Fatal error|Warning|Notice|Parse error|Deprecated):", 1).alias("kind"), F.regexp_extract(line, r"/(?:plugins|themes)/([^/]+)/", 1).alias("culprit"), message.alias("message")
    )
    return rows.filter("kind != ''").withColumn("signature", F.regexp_replace("message", "[0-9]+", "N"))


def fatals(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'Fatal error'").groupBy("month").count()


def most(log: DataFrame, column: str, k: int = 15) -> DataFrame:
    return log.filter(F.col(column) != "").groupBy(column).count().orderBy(F.desc("count"), column).limit(k)
