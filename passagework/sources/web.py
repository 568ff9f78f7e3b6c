"""A data source for paged search services and a fetcher of details, one request at a time a task."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from passagework.operators import legal

FORMAT = "paged_search"


def fetch(url: str, timeout: float) -> str | None:
    """The body at ``url``, or None if it can't be had."""
    try:
        with urlopen(url, timeout=timeout) as reply:  # noqa: S310  the address is the caller's
            return reply.read().decode("utf-8", "replace")
    except (OSError, ValueError):
        return None


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.first, self.last = int(options.get("first", 1)), int(options.get("last", 1))
        self.step, self.delay, self.timeout = int(options.get("pages_per_task", 50)), float(options.get("delay", 1.0)), float(options.get("timeout", 30))

    def partitions(self) -> list[PageRange]:
        return [PageRange(i, min(i + self.step - 1, self.last)) for i in range(self.first, self.last + 1, self.step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            body = fetch(self.url.replace("{page}", str(page)), self.timeout)
            if body is not None:
                yield page, body
            if self.delay and page < partition.last:
                time.sleep(self.delay)


class PagedSearch(DataSource):
    """``spark.read.format("paged_search").option("url", "https://.../?page={page}")`` with ``first``,
    ``last``, ``pages_per_task``, ``delay`` and ``timeout``: page and body of each reply."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "page long, body string"

    def reader(self, schema: object) -> PageReader:
        return PageReader(self.options)


def details(ids: DataFrame, url: str, delay: float = 1.0, timeout: float = 30.0) -> DataFrame:
    """file (the id) and js of each ``case_id``; ids that can't be fetched or parsed are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for case_id in batch["case_id"]:
                bodies.append(fetch(url.replace("{id}", quote(case_id)), timeout))
                time.sleep(delay)
            yield pd.DataFrame({"file": batch["case_id"], "body": bodies})

    return ids.select("case_id").distinct().mapInPandas(run, "file string, body string").select("file", F.try_parse_json("body").alias("js")).where("js is not null")


def crawl(spark: SparkSession, search_url: str, detail_url: str, first: int, last: int, delay: float = 1.0) -> DataFrame:
    """Flat fields of the judged precedents of pages ``first`` to ``last``."""
    spark.dataSource.register(PagedSearch)
    pages = spark.read.format(FORMAT).options(url=search_url, first=first, last=last, delay=delay).load()
    found = legal.search_rows(pages.select(F.col("page").cast("string").alias("file"), F.try_parse_json("body").alias("js")).where("js is not null"))
    return legal.precedent_fields(details(found, detail_url, delay).select("file", F.lit(0).alias("rec_no"), "js"), judged_only=True)
