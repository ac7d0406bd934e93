"""The listing feed page by page, as a data source of its own: in batch one partition a page, as a stream one offset a page.

A feed is a function fetch(offset, limit) that gives a reply as the service does, a dictionary with itemSummaries and
total; it is shipped to the tasks with the source, so a client is any such function. Rows are (page, pos, total, item):
the item as JSON text, its place in the feed and the total that the reply named.

In batch the first page is asked for once more by its task: the driver needs its total to know the pages. A stream goes
over whole pages only, as a page that is not yet full still changes; it goes on where its checkpoint ends. Feeds for
streams have their oldest item first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feed import ITEM

PAGE_SIZE = 200
ROWS = "page int, pos long, total long, item string"
Fetch = Callable[[int, int], dict]


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def page_rows(fetch: Fetch, size: int, number: int) -> Iterator[tuple]:
    reply = fetch(number * size, size)
    total = int(reply.get("total") or 0)
    for k, item in enumerate(reply.get("itemSummaries") or []):
        yield number, number * size + k, total, json.dumps(item, ensure_ascii=False)


class PageReader(DataSourceReader):
    def __init__(self, fetch: Fetch, size: int, most: int):
        self.fetch, self.size, self.most = fetch, size, most

    def partitions(self) -> list[Page]:
        total = int(self.fetch(0, self.size).get("total") or 0)
        return [Page(k) for k in range(max(1, min(self.most, -(-total // self.size))))]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from page_rows(self.fetch, self.size, partition.number)


class PageStream(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, size: int):
        self.fetch, self.size = fetch, size

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": int(self.fetch(0, 1).get("total") or 0) // self.size}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(k) for k in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from page_rows(self.fetch, self.size, partition.number)


def paged_source(fetch: Fetch, name: str = "paged_feed") -> type[DataSource]:
    """A data source of the feed, to be registered with a session; options page_size and max_pages."""

    class PagedFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROWS

        def reader(self, schema) -> DataSourceReader:
            return PageReader(fetch, int(self.options.get("page_size", PAGE_SIZE)), int(self.options.get("max_pages", 1 << 30)))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PageStream(fetch, int(self.options.get("page_size", PAGE_SIZE)))

    return PagedFeed


def folder_feed(folder: str) -> Fetch:
    """A feed whose items are the lines of the JSON files of a folder, in order of the files' names; the folder is one that
    the driver and all tasks see."""

    def fetch(offset: int, limit: int) -> dict:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".json"))
        lines = [line for f in files for line in store.open_input_file(f).readall().splitlines() if line.strip()]
        return {"total": len(lines), "itemSummaries": [json.loads(x) for x in lines[offset : offset + limit]]}

    return fetch


def read_pages(spark: SparkSession, fetch: Fetch, page_size: int = PAGE_SIZE, max_pages: int | None = None, stream: bool = False) -> DataFrame:
    """page, pos, total and the parsed item of every row of the feed."""
    source = paged_source(fetch)
    spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(source.name()).option("page_size", page_size)
    rows = (reader if max_pages is None else reader.option("max_pages", max_pages)).load()
    return rows.select("page", "pos", "total", F.from_json("item", f"STRUCT<{ITEM}>").alias("item"))
