"""Search analytics as a data source: rows by query and page, fetched in pages of bounded size.

The client is any callable that takes a request's parameters and returns the reply's JSON; there is none
for a network here. Sites whose owner is not verified are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Rows of a request and of a whole fetch.
PAGE, CEILING = 5_000, 25_000
SCHEMA = "query string, page string, clicks long, impressions long, ctr double, position double"


def sites(reply: str) -> list[str]:
    """Properties of an account that may be read."""
    return [s["siteUrl"] for s in json.loads(reply).get("siteEntry", []) if s.get("siteUrl") and s.get("permissionLevel") != "siteUnverifiedUser"]


def envelope(status: int, body: str) -> dict:
    """A reply as ok, body and error."""
    try:
        found = json.loads(body)
    except ValueError:
        found = None
    if status != 200 or not isinstance(found, dict):
        message = found.get("error", {}).get("message") if isinstance(found, dict) and isinstance(found.get("error"), dict) else None
        return {"ok": False, "body": None, "error": message or f"HTTP {status}"}
    return {"ok": True, "body": found, "error": None}


def window(today: date, days: int) -> tuple[date, date]:
    """First and last day of a fetch; a range that isn't positive is 90 days."""
    return today - timedelta(days=days if days > 0 else 90), today


class _Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


class _Reader(DataSourceReader):
    def __init__(self, client: Callable[..., str], options: dict):
        self.client, self.options = client, options

    def partitions(self) -> list[_Page]:
        return [_Page(k) for k in range(0, min(CEILING, int(self.options.get("rows", CEILING))), PAGE)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        reply = self.client(site=self.options["site"], start_date=self.options["start"], end_date=self.options["end"], start_row=partition.start, row_limit=PAGE)
        for row in json.loads(reply).get("rows", []):
            yield row["keys"][0], row["keys"][1], int(row.get("clicks", 0)), int(row.get("impressions", 0)), float(row.get("ctr", 0)), float(row.get("position", 0))


def register(spark: SparkSession, client: Callable[..., str], name: str = "search_analytics") -> None:
    """Makes spark.read.format(name) with options site, start, end (and rows) read through the client."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(client, dict(self.options))

    spark.dataSource.register(Source)
