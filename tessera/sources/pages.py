"""Results that come by offset and limit, read in parallel as a Spark data source.

How many pages there are is not known.  Stripe k of n reads the pages k, k + n,
k + 2 n and so on until one is short, so each stripe asks for one page beyond the
end at most, and no page is asked for twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Where an answer that is no list has its rows, in this order.
WRAPPERS = ["result", "results", "items", "objects"]
#: Asks for up to ``limit`` rows from ``offset`` on and returns the answer as JSON.
Fetch = Callable[[int, int], str]


def rows_of(answer: str) -> list:
    """The rows of an answer: the list itself, or the first of WRAPPERS that holds a list; else none."""
    data = json.loads(answer)
    if isinstance(data, dict):
        data = next((data[k] for k in WRAPPERS if isinstance(data.get(k), list)), [])
    return data if isinstance(data, list) else []


class Stripe(InputPartition):
    def __init__(self, first: int):
        self.first = first


class PageReader(DataSourceReader):
    def __init__(self, fetch: Fetch, limit: int, stripes: int):
        self.fetch, self.limit, self.stripes = fetch, limit, stripes

    def partitions(self) -> list[Stripe]:
        return [Stripe(k) for k in range(self.stripes)]

    def read(self, partition: Stripe) -> Iterator[tuple[int, str]]:
        page = partition.first
        while True:
            rows = rows_of(self.fetch(page * self.limit, self.limit))
            for i, row in enumerate(rows):
                yield page * self.limit + i, json.dumps(row, ensure_ascii=False)
            if len(rows) < self.limit:
                return
            page += self.stripes


def read_pages(spark: SparkSession, name: str, fetch: Fetch, limit: int = 500, stripes: int = 8) -> DataFrame:
    """``place``, ``value``: each row of a paged result, as JSON, with its place in it.

    ``fetch`` runs in the executors and must give the same rows when asked again.
    A page that is short by accident ends its stripe only, so such a source needs
    one stripe to be read as far as a plain loop would.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "place long, value string"

        def reader(self, schema) -> DataSourceReader:
            return PageReader(fetch, limit, stripes)

    spark.dataSource.register(Pages)
    return spark.read.format(name).load()
