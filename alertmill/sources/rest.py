"""A paged REST listing as a Spark data source: one partition a page, pages that fail are left out."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    """The first page gives the count; then pages are read in parallel, each by a task."""

    def __init__(self, options: dict):
        self.url, self.size, self.timeout = options["url"], int(options.get("pagesize", 50)), float(options.get("timeout", 30))

    def fetch(self, page: int) -> str:
        with urllib.request.urlopen(self.url.format(page=page, size=self.size), timeout=self.timeout) as r:
            return r.read().decode()

    def partitions(self) -> list[InputPartition]:
        total = int(json.loads(self.fetch(1)).get("totalCount", 0))
        return [Page(i) for i in range(1, max(1, -(-total // self.size)) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            yield partition.number, self.fetch(partition.number)
        except (OSError, ValueError):
            return


class PagedListing(DataSource):
    """``spark.read.format("paged_listing").option("url", "http://host/bugs?page={page}&size={size}")`` gives (page, body)."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
