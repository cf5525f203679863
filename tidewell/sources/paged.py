"""A paged list-and-detail connector as a Spark data source.

``spark.read.format("tidewell_pages")`` reads one partition a range of pages from a
client that is named by its import path. Clients are plug-ins: ``pages()`` gives the
number of pages, ``page(i)`` its items, and ``detail(item)``, where there is one and ``details`` is set, what else
belongs to an item; a page that fails gives one row with the error, and does not stop the others.

A source that lists its newest items first (``order`` is ``newest``) stops reading where the rest
is not asked for: a filter ``date >= ...`` is pushed down to the reader, which ends at the first older item, so that
later pages aren't requested; so do the options ``since`` (which lets undated items pass) and
``max_items``. Such a scan is one task, as each page tells whether the next one is needed.
Filters on ids, equal or not among some, are pushed down too: details of such items aren't requested.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, Not


class JsonFolderClient:
    """Reads pages from page-<i>.json, a list of items, or from folders page=<i> of JSON lines in order of their place; the deterministic stand-in for a network client."""

    def __init__(self, options: dict[str, str]):
        path, self.n = options["path"], int(options.get("pages", "1"))
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)

    def pages(self) -> int:
        return self.n

    def _text(self, path: str) -> str:
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def page(self, i: int) -> list[dict]:
        folder = self.fs.get_file_info(f"{self.folder}/page={i}")
        if folder.type == pyarrow.fs.FileType.NotFound:
            return json.loads(self._text(f"{self.folder}/page-{i}.json"))
        files = self.fs.get_file_info(pyarrow.fs.FileSelector(folder.path))
        lines = [x for f in files if f.base_name.endswith(".json") and f.base_name[0] not in "._" for x in self._text(f.path).splitlines()]
        return sorted(map(json.loads, lines), key=lambda item: item["place"])


def client_of(options: dict[str, str]):
    module, name = options.get("client", f"{__name__}:JsonFolderClient").split(":")
    return getattr(importlib.import_module(module), name)(options)


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _gaps(first: int, last: int, done: set[int]) -> Iterator[tuple[int, int]]:
    """Ranges of the pages from first to last that aren't done."""
    start = None
    for i in range(first, last + 1):
        if i == last or i in done:
            if start is not None:
                yield start, i
            start = None
        elif start is None:
            start = i


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.newest_first = options.get("order") == "newest"
        self.from_date: tuple[str, bool] | None = None
        self.only: set[str] | None = None
        self.known: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if self.newest_first and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("date",):
                bound = f.value, isinstance(f, GreaterThan)
                self.from_date = max(self.from_date or bound, bound)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, Not) and isinstance(f.child, (EqualTo, In)) and f.child.attribute == ("id",):
                self.known |= {f.child.value} if isinstance(f.child, EqualTo) else set(f.child.value)
            else:
                yield f
                continue
            yield f  # Spark tests it again; rows without an id or date are its to judge

    def _one_task(self) -> bool:
        return "max_items" in self.options or self.newest_first and (self.from_date is not None or "since" in self.options)

    def partitions(self) -> list[PageRange]:
        n, step = client_of(self.options).pages(), int(self.options.get("pages_a_task", "4"))
        n, first = min(n, int(self.options.get("last", n))), int(self.options.get("first", "0"))
        step = max(1, n - first) if self._one_task() else step
        done = set(json.loads(self.options.get("done", "[]")))
        found = [PageRange(a, b) for i in range(first, n, step) for a, b in _gaps(i, min(n, i + step), done)]
        if self._one_task() and len(found) > 1:  # pages that are done lie between: one task still, which passes them over
            return [PageRange(found[0].first, found[-1].last)]
        return found

    def _past(self, date: str) -> bool:
        """Whether an item of this date, and so all that follow, aren't asked for."""
        if not self.newest_first or not date:
            return False
        bound, open_end = self.from_date or ("", False)
        return date < self.options.get("since", "") or date < bound or open_end and date == bound

    def read(self, partition: PageRange) -> Iterator[tuple]:
        client = client_of(self.options)
        left, done = int(self.options.get("max_items", str(1 << 62))), set(json.loads(self.options.get("done", "[]")))
        details = self.options.get("details") == "true" and hasattr(client, "detail")
        for i in range(partition.first, partition.last):
            if i in done:
                continue
            try:
                items = client.page(i)
            except Exception as error:  # noqa: BLE001  one page's failure is a row
                yield i, 0, None, None, None, f"{type(error).__name__}: {error}"
                continue
            for k, item in enumerate(items):
                if left <= 0:
                    return
                left -= 1
                key, date = str(item.get("id", "")), str(item.get("date", ""))
                if self._past(date):
                    return
                if key in self.known or self.only is not None and key not in self.only:
                    continue
                try:
                    item = item | client.detail(item) if details else item
                except Exception as error:  # noqa: BLE001
                    yield i, k, key, date, None, f"{type(error).__name__}: {error}"
                    continue
                yield i, k, key, date, json.dumps(item, ensure_ascii=False, sort_keys=True), None


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewell_pages"

    def schema(self) -> str:
        return "page int, place int, id string, date string, item string, error string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, filters being pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def take_while(df: DataFrame, order: list[Column], stop: Column, groups: list[str]) -> DataFrame:
    """Rows before the first one that meets stop, within each group."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_s", F.sum(F.when(stop, 1).otherwise(0)).over(w)).where("_s = 0").drop("_s")


def collected(spark: SparkSession, options: dict[str, str], root: str, known: DataFrame | None = None, probe: int = 2) -> DataFrame:
    """All items read so far of a paged source, kept below root as the run's checkpoint.

    Pages that are there are not read again, so a run that died goes on where it was; pages that failed are not kept
    and come again. With ``known`` (id), a run stops after the first ``probe`` pages unless each of them holds an id
    that is not known, and then after as many more.
    """
    register(spark)
    n = client_of(options).pages()
    batches = [(0, n)] if known is None else [(0, min(n, probe)), (min(n, probe), min(n, 2 * probe))]
    schema, table = f"{PagedSource(options).schema()}, batch int", f"{root}/items"
    have = lambda: spark.read.schema(schema).parquet(table)
    spark.createDataFrame([], schema).write.mode("append").parquet(table)
    for i, (first, last) in enumerate(batches):
        if i and have().where(F.col("page") < first).join(known.select("id").distinct(), "id", "left_anti").agg(F.count_distinct("page")).first()[0] < first:
            break
        done = [r.page for r in have().select("page").distinct().collect()]  # a number a page of one source
        rows = spark.read.format(PagedSource.name()).options(**options, first=str(first), last=str(last), done=json.dumps(done)).load()
        good = rows.where("error IS NULL")
        good.withColumn("batch", F.lit(i)).write.mode("append").parquet(table)
    return have().drop("batch", "error")
