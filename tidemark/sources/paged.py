"""A paged search API as a data source: one partition for each day and set of dimensions, pages until a short one."""

from __future__ import annotations

import datetime as dt
import importlib
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

ROWS_PER_PAGE = 25_000
PAGE, QUERY = "page", "page,query"


class Slice(InputPartition):
    def __init__(self, day: str, dimensions: str):
        super().__init__((day, dimensions))
        self.day, self.dimensions = day, dimensions


def days_of(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(k) for k in range((last - first).days + 1)]


def rows_of(options: dict, part: Slice):
    """All rows of a slice, page by page, until one is short."""
    module, _, name = options["client"].partition(":")
    fetch = getattr(importlib.import_module(module), name)
    size, at = int(options.get("rowsperpage", ROWS_PER_PAGE)), 0
    names = part.dimensions.split(",")
    while True:
        rows = fetch(json.loads(options.get("arguments", "{}")), part.day, names, size, at)
        for r in rows:
            keys = dict(zip(names, r["keys"], strict=True))
            yield dt.date.fromisoformat(part.day), keys.get("page"), keys.get("query", ""), int(r["clicks"]), int(r["impressions"]), float(r["position"])
        if len(rows) < size:
            return
        at += size


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.days = days_of(*(dt.date.fromisoformat(self.options[k]) for k in ("start", "end")))
        self.dimensions = [PAGE, QUERY]

    def partitions(self):
        return [Slice(d.isoformat(), x) for d in self.days for x in self.dimensions]

    def read(self, part):
        return rows_of(self.options, part)


class FilteredReader(PagedReader):
    """Filters on date choose days, and a query that isn't empty chooses dimensions."""

    def pushFilters(self, filters):
        for f in filters:
            if not self._pushed(f):
                yield f

    def _pushed(self, f) -> bool:
        """Whether f is answered by the choice of slices alone."""
        tests = {EqualTo: "__eq__", EqualNullSafe: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        if isinstance(f, IsNotNull) and f.attribute in (("date",), ("query",)):
            return True  # neither is ever null
        if isinstance(f, In) and f.attribute == ("date",):
            self.days = [d for d in self.days if d in f.value]
            return True
        if type(f) in tests and f.attribute == ("date",) and isinstance(f.value, dt.date):
            self.days = [d for d in self.days if getattr(d, tests[type(f)])(f.value)]
            return True
        inner = f.child if isinstance(f, Not) else f
        if isinstance(inner, EqualTo) and inner.attribute == ("query",) and inner.value == "":
            # an empty query could come with the query dimension too: Spark tests it again
            self.dimensions = [QUERY] if isinstance(f, Not) else self.dimensions
        return False


class PagedStream(DataSourceStreamReader):
    """Days as offsets: each batch reads the days that became final since the last, up to end, or to lag days before today."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self):
        return {"after": (dt.date.fromisoformat(self.options["start"]) - dt.timedelta(1)).isoformat()}

    def latestOffset(self):
        if "end" in self.options:
            return {"after": self.options["end"]}
        return {"after": (dt.datetime.now(dt.UTC).date() - dt.timedelta(int(self.options.get("lag", "3")))).isoformat()}

    def partitions(self, start, end):
        first = dt.date.fromisoformat(start["after"]) + dt.timedelta(1)
        return [Slice(d.isoformat(), x) for d in days_of(first, dt.date.fromisoformat(end["after"])) for x in (PAGE, QUERY)]

    def read(self, part):
        return rows_of(self.options, part)


class PagedSearch(DataSource):
    """spark.dataSource.register(PagedSearch); options client ("module:function"), start, end, rowsPerPage, arguments (JSON).

    The function gets arguments, day, dimensions, page size and start row, and returns rows of keys, clicks, impressions
    and position. Page totals have an empty query. With option filters "true", and in a session with
    spark.sql.python.filterPushdown.enabled, filters on date and query choose what is fetched. As a stream, end may be left out; lag then says how many days before today
    the last final one is."""

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return "date date, page string, query string, clicks long, impressions long, position double"

    def reader(self, schema):
        # Spark refuses a reader that takes filters where it isn't to give any
        return FilteredReader(self.options) if self.options.get("filters", "false") == "true" else PagedReader(self.options)

    def streamReader(self, schema):
        return PagedStream(self.options)


_held: dict[tuple, object] = {}


def sorted_slice(uri: str, day: str, dimensions: tuple[str, ...], first: bool):
    """The rows of a slice in order of their keys. The last slice is held from its first page to its end, so that further pages
    don't read and sort it again; another slice, or a first page, reads anew."""
    import pyarrow as pa
    import pyarrow.dataset as ds
    from pyarrow import fs

    key = (uri, day, dimensions)
    if first or key not in _held:
        _held.clear()
        files, path = fs.FileSystem.from_uri(uri)
        path = f"{path}/dimensions={len(dimensions)}/date={day}"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return pa.table({c: [] for c in (*dimensions, "clicks", "impressions", "position")})
        _held[key] = ds.dataset(path, filesystem=files, format="parquet").to_table().sort_by([(c, "ascending") for c in dimensions])
    return _held[key]


def folder_client(arguments: dict, day: str, dimensions: list[str], size: int, at: int) -> list[dict]:
    """A client that answers from a folder of rows by day and dimensions (arguments: path, which the executors share), in order of
    their keys, as an API would from its own tables."""
    table = sorted_slice(arguments["path"], day, tuple(dimensions), at == 0).slice(at, size)
    if table.num_rows < size:
        _held.clear()
    return [{"keys": [r[c] for c in dimensions], **{c: r[c] for c in ("clicks", "impressions", "position")}} for r in table.to_pylist()]
