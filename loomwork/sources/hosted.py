"""Datasets of a host and files behind addresses, read by the executors.

A dataset's host gives its items in pages: the fetcher is asked for
``<location>?offset=<o>&limit=<n>`` and answers with an array of at most n
objects, an empty one beyond the end. The driver asks for single items only, to
find how many there are: twice as far each time, then by halves. The items
themselves are fetched by the tasks of a data source, one range of offsets each,
and land as lines in the shared folder, so that what follows reads them from
there, as often as it likes, and asks the host for nothing twice.

A file behind an address is fetched whole by one task, as an address has no
parts, and lands in the shared folder too, where tables are read in ranges.

Fetchers travel to the workers with the source, so they must be such as can be
sent there. Objects become rows by Spark's JSON reader; columns stand in the
order in which their names first come up.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomwork.runtime import kept, shared_dir

Fetch = Callable[[str], bytes]

#: Items asked for at once, and items to a task, at least.
PAGE, TASK_ITEMS = 1000, 10_000


def page_of(location: str, offset: int, limit: int) -> str:
    return f"{location}{'&' if '?' in location else '?'}offset={offset}&limit={limit}"


def items_of(fetch: Fetch, location: str, offset: int, limit: int) -> list:
    got = json.loads(fetch(page_of(location, offset, limit)))
    if not isinstance(got, list) or len(got) > limit:
        raise ValueError(f"{location} does not keep to pages of {limit}")
    return got


def count_items(fetch: Fetch, location: str) -> int:
    """How many items there are, from about two logarithms of it single ones."""
    there = lambda k: bool(items_of(fetch, location, k, 1))
    if not there(0):
        return 0
    low, high = 0, 1
    while there(high):
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if there(mid) else (low, mid)
    return low + 1


class Span(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


def items_source(fetch: Fetch, name: str):
    """A data source of the items of one host, as text; options: location, items, page, task."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.location, self.n = options["location"], int(options["items"])
            self.page, self.task = int(options["page"]), int(options["task"])

        def partitions(self) -> list[Span]:
            return [Span(a, min(a + self.task, self.n)) for a in range(0, self.n, self.task)]

        def read(self, span: Span) -> Iterator[tuple]:
            at = span.first
            while at < span.end:
                got = items_of(fetch, self.location, at, min(self.page, span.end - at))
                if not got:
                    raise ValueError(f"{self.location} has become shorter than {self.n} items")
                for k, item in enumerate(got):
                    yield at + k, json.dumps(item, default=str)
                at += len(got)  # a host may give less than it is asked for

    class Items(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "ord long, item string"

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Items


def read_items(spark: SparkSession, location: str, fetch: Fetch, page: int = PAGE, task: int | None = None) -> DataFrame | None:
    """The items as rows; None if there are none."""
    n = count_items(fetch, location)
    if not n:
        return None
    # a task for each core and more, once there are enough items
    task = task or max(TASK_ITEMS, -(-n // (4 * spark.sparkContext.defaultParallelism)))
    name = f"items_{uuid.uuid4().hex}"
    spark.dataSource.register(items_source(fetch, name))
    found = spark.read.format(name).options(location=location, items=n, page=page, task=task).load()
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    kept_items = kept(found, "items")
    kept_items.select("item").write.text(path)
    rows = spark.read.json(path)
    # names in the order of the first item that has them, one row a name
    names = kept_items.select("ord", F.posexplode(F.json_object_keys("item"))).groupBy("col").agg(F.min(F.struct("ord", "pos")).alias("at")).orderBy("at").collect()
    order = [r["col"] for r in names if r["col"] in rows.columns]
    return rows.select(*[F.col(f"`{c.replace('`', '``')}`") for c in order])


def address_source(fetch: Fetch, name: str):
    """A data source of one row: what an address gives."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.location = options["location"]

        def partitions(self) -> list[Span]:
            return [Span(0, 1)]

        def read(self, span: Span) -> Iterator[tuple]:
            yield (bytearray(fetch(self.location)),)

    class Content(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "content binary"

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Content


def content_of(spark: SparkSession, location: str, fetch: Fetch) -> DataFrame:
    """content: one row, fetched once by a task and kept in the shared folder."""
    name = f"address_{uuid.uuid4().hex}"
    spark.dataSource.register(address_source(fetch, name))
    return kept(spark.read.format(name).options(location=location).load(), "fetched")


def as_text_file(content: DataFrame, name: str) -> str:
    """A folder with the bytes as a file, ended by a line feed, for the readers of text."""
    path = f"{shared_dir(content.sparkSession)}/fetched-{uuid.uuid4().hex}/{name}"
    content.select(F.col("content").cast("string")).write.text(path)
    return path


def unpacked(content: DataFrame, choose: Callable[[bytes], tuple[str, bytes] | None]) -> DataFrame:
    """name, content: the member of an archive that ``choose`` picks, taken out by a task; no row if it is none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.column(0):
                if inner := choose(row.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([inner[0]]), pa.array([inner[1]], pa.binary())], names=["name", "content"])

    return kept(content.mapInArrow(run, "name string, content binary"), "member")


def parquet_rows(content: DataFrame) -> DataFrame:
    """The rows of a parquet file's bytes, row group by row group; only its schema comes to the driver."""

    def schema(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            for row in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([from_arrow_schema(pq.read_schema(io.BytesIO(row.as_py()))).json()])], names=["s"])

    def rows(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for row in batch.column(0):
                yield from pq.ParquetFile(io.BytesIO(row.as_py())).iter_batches(10_000)

    from pyspark.sql.types import StructType

    kind = StructType.fromJson(json.loads(content.mapInArrow(schema, "s string").first()["s"]))
    return kept(content.mapInArrow(rows, kind), "rows")

