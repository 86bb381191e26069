"""A slot for connectors: paged sources as a Spark data source. The fetcher is the caller's; nothing here opens a network."""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.fetcher, self.pages = options["fetcher"], int(options.get("pages", 1))

    def partitions(self) -> list[InputPartition]:
        return [Page(n) for n in range(1, self.pages + 1)]

    def read(self, partition: InputPartition):
        module, name = self.fetcher.split(":")
        for body in getattr(importlib.import_module(module), name)(partition.number):
            yield (partition.number, body)


class Paged(DataSource):
    """Options: fetcher (module:function, page number -> list of record texts; none after the last page) and pages. A page is a
    task, so a lost executor fetches its pages again."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def example_pages(page: int) -> list[str]:
    """A stand-in for a service with two pages of records."""
    return {1: ['{"id": 1}', '{"id": 2}'], 2: ['{"id": 3}']}.get(page, [])


def read_pages(spark, fetcher: str, pages: int):
    spark.dataSource.register(Paged)
    return spark.read.format("paged").option("fetcher", fetcher).option("pages", str(pages)).load()
