"""A source that is read page by page, as services answer: an offset, a limit, and a total.

``register`` makes the format ``paged`` known. Its folder holds recorded answers,
one file a page in ``offset=N``, each a JSON object of total, items and maybe error.
The answer to the first offset tells the total; every page after it is a
partition of its own, so pages are fetched side by side and a page that is lost
with its executor is fetched again. Filters on page_offset decide which pages are
fetched at all.

A page that can't be used gives one row with its error and no item, and the other
pages still count: an answer with an error, a total other than the first one, or
fewer items than the total leaves for the page (those there are come too).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators import ordering

#: Items a page at most, unless the option pageSize says otherwise.
PAGE_SIZE = 500
SCHEMA = "page_offset long, place int, item string, error string"

_HOLDS = {
    EqualTo: lambda at, v: at == v,
    GreaterThan: lambda at, v: at > v,
    GreaterThanOrEqual: lambda at, v: at >= v,
    LessThan: lambda at, v: at < v,
    LessThanOrEqual: lambda at, v: at <= v,
    In: lambda at, v: at in v,
}


def recorded(path: str, offset: int) -> dict:
    """The answer that was recorded for an offset."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    files = [f for f in store.get_file_info(fs.FileSelector(f"{at}/offset={offset}", allow_not_found=True)) if f.base_name.startswith("part-")]
    if not files:
        return {"error": f"no answer for offset {offset}"}
    with store.open_input_stream(files[0].path) as stream:
        return json.loads(stream.read())


class Page(InputPartition):
    def __init__(self, offset: int | None, total: int | None):
        self.offset, self.total = offset, total


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size, self.only = options["path"], int(options.get("pageSize", PAGE_SIZE)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what is said of page_offset; Spark applies the rest."""
        for f in filters:
            if type(f) in _HOLDS and f.attribute == ("page_offset",):
                self.only.append((type(f), f.value))
            else:
                yield f

    def wanted(self, offset: int) -> bool:
        return all(_HOLDS[kind](offset, value) for kind, value in self.only)

    def partitions(self) -> list[Page]:
        first = recorded(self.path, 0)
        if first.get("error"):
            return [Page(0 if self.wanted(0) else None, None)]
        total = int(first.get("total", 0))
        return [Page(at, total) for at in range(0, total, self.size) if self.wanted(at)] or [Page(None, 0)]  # a scan has a partition at least

    def read(self, page: Page) -> Iterator[tuple]:
        if page.offset is None:
            return
        answer = recorded(self.path, page.offset)
        items = answer.get("items") or []
        if answer.get("error"):
            yield page.offset, None, None, str(answer["error"])
            return
        if int(answer.get("total", 0)) != page.total:
            yield page.offset, None, None, f"total {answer.get('total')} after {page.total}"
            return
        for place, item in enumerate(items):
            yield page.offset, place, json.dumps(item, sort_keys=True, ensure_ascii=False), None
        expected = min(self.size, page.total - page.offset)
        if len(items) < expected:
            yield page.offset, None, None, f"{len(items)} items of {expected}"


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def record(items: DataFrame, path: str, order: list[str], size: int = PAGE_SIZE) -> None:
    """Write the answers that a service with these items, in this order, would give."""
    numbered = ordering.numbered(items, order)
    total = numbered.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    item = F.struct(*items.columns)
    pages = numbered.select((F.floor((F.col("number") - 1) / size) * size).alias("offset"), "number", item.alias("item"))
    pages = pages.groupBy("offset").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "item"))), lambda x: x["item"]).alias("items"))  # ``size`` of them
    answers = pages.select("offset", F.to_json(F.struct(F.lit(total).alias("total"), "items")).alias("value"))
    if not total:
        answers = items.sparkSession.createDataFrame([(0, '{"total": 0, "items": []}')], "offset long, value string")
    answers.repartition("offset").write.partitionBy("offset").text(path)


def latest_items(spark: SparkSession, path: str, schema: str, keys: list[str], size: int = PAGE_SIZE) -> DataFrame:
    """The items of all pages without error rows; of equal keys the one that came last."""
    rows = spark.read.format("paged").option("pageSize", size).load(path).where("error IS NULL")
    items = rows.select("page_offset", "place", F.from_json("item", schema).alias("item"))
    last = items.groupBy(*[F.col(f"item.{k}").alias(k) for k in keys]).agg(F.max_by("item", F.struct("page_offset", "place")).alias("item"))
    return last.select("item.*")
