"""A Python data source for items that some service lists page by page.

    spark.dataSource.register(PagedItems)
    spark.read.format("paged_items").option("fetcher", "package.module:function").option("pages", "8").load()

The fetcher takes a page number and returns dictionaries of item fields. Pages are partitions, so the number
of pages is the number of calls at a time at most; a page that fails is retried with its task."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("title", "abstract", "url", "source", "arxiv_id", "semantic_paper_id", "published_date")


class PagedItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def schema(self) -> str:
        return "item_ord bigint, " + ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["fetcher"], int(self.options.get("pages", "1")))


class PageReader(DataSourceReader):
    def __init__(self, fetcher: str, pages: int):
        self.fetcher, self.pages = fetcher, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for k, item in enumerate(fetch(partition.value)):
            yield (partition.value * 100_000 + k, *(item.get(f) for f in FIELDS))


def example_pages(page: int) -> list[dict]:
    """Two made-up items a page, for tests and as a pattern."""
    return [{"title": f"Item {page}-{k}", "url": f"https://pages.example/{page}/{k}", "source": "manual"} for k in range(2)]
