"""A Parquet table read by slices of its rows: ``spark.read.format("split_table")``.

Options: ``path`` (a file or folder), ``split`` (``train``, ``train[:5%]``, ``train[100:200]``,
``train[-10%:]``, or several joined by ``+``) and ``columns`` (comma-separated; all if not
given). Rows count in file order, files by name. Percentages round to the nearest row, halves to
the even one. Only file footers are read to plan: each row group that a slice
touches is one partition, which reads just its part of it.

Where the session has ``spark.sql.python.filterPushdown.enabled``, comparisons with
constants reach the source: row groups whose statistics rule them out are not read, and of
others only matching rows go to Spark. A slice is taken before filters, as rows are
numbered before anything is dropped. :func:`read_split` sets the options and
registers the source.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from rewardlens.session import ship_package

_SLICE = re.compile(r"\s*([\w.-]+)\s*(?:\[\s*(-?\d+(?:\.\d+)?%?)?\s*:\s*(-?\d+(?:\.\d+)?%?)?\s*\])?\s*")

Range = tuple[int, int]


def parse_split(split: str) -> list[tuple[str, str | None, str | None]]:
    """``(name, from, to)`` of each part of a split expression; bounds as written."""
    parts = []
    for text in split.split("+"):
        m = _SLICE.fullmatch(text)
        if not m:
            raise ValueError(f"not a split: {text.strip()!r}")
        parts.append((m[1], m[2], m[3]))
    return parts


def _bound(text: str | None, n: int, default: int) -> int:
    if text is None:
        return default
    at = round(n * float(text[:-1]) / 100) if text.endswith("%") else int(float(text))
    return min(max(at + n if at < 0 else at, 0), n)


def row_range(start: str | None, stop: str | None, n: int) -> Range:
    """First and past-the-last row of a slice of ``n`` rows."""
    a, b = _bound(start, n, 0), _bound(stop, n, n)
    return a, max(a, b)


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The file system and the Parquet files of a path, by name."""
    if "://" in path or path.startswith("file:"):
        fs, inner = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        fs, inner = pafs.LocalFileSystem(), path
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [inner]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    names = [f.path for f in found if f.is_file and f.path.endswith(".parquet")]
    hidden = [n for n in names if any(part.startswith(("_", ".")) for part in posixpath.relpath(n, inner).split("/"))]
    return fs, sorted(set(names) - set(hidden))


def _of_split(files: list[str], name: str, path: str) -> list[str]:
    """Files of one named split: those called ``name``, ``name-..`` or in a folder ``name``; a table without any is all ``train``."""
    def belongs(f: str) -> bool:
        base = posixpath.basename(f).removesuffix(".parquet")
        return base == name or base.startswith(name + "-") or name in posixpath.dirname(f).split("/")[-1:]

    own = [f for f in files if belongs(f)]
    if not own and name != "train":
        raise ValueError(f"no split {name!r} in {path}")
    return own or files


@dataclass
class RowsOf(D.InputPartition):
    """Rows ``start`` to ``stop`` of one row group."""

    file: str
    group: int
    start: int
    stop: int


#: How each pushed comparison reads as an Arrow expression.
_COMPARE = {
    D.EqualTo: lambda c, v: c == v, D.GreaterThan: lambda c, v: c > v, D.GreaterThanOrEqual: lambda c, v: c >= v,
    D.LessThan: lambda c, v: c < v, D.LessThanOrEqual: lambda c, v: c <= v, D.In: lambda c, v: c.isin(list(v)),
}
#: Whether a row group whose column runs from ``lo`` to ``hi`` may hold a match.
_MAY = {
    D.EqualTo: lambda lo, hi, v: lo <= v <= hi, D.GreaterThan: lambda lo, hi, v: hi > v, D.GreaterThanOrEqual: lambda lo, hi, v: hi >= v,
    D.LessThan: lambda lo, hi, v: lo < v, D.LessThanOrEqual: lambda lo, hi, v: lo <= v, D.In: lambda lo, hi, v: any(lo <= x <= hi for x in v),
}


class SplitReader(D.DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.split = options["path"], options.get("split", "train")
        self.columns = schema.fieldNames()
        self.filters: list[D.Filter] = []

    def _expression(self) -> pc.Expression | None:
        out = None
        for f in self.filters:
            column = pc.field(*f.attribute)
            one = column.is_valid() if isinstance(f, D.IsNotNull) else column.is_null() if isinstance(f, D.IsNull) else _COMPARE[type(f)](column, f.value)
            out = one if out is None else out & one
        return out

    def _ruled_out(self, group: pq.RowGroupMetaData) -> bool:
        stats = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for f in self.filters:
            s = stats.get(".".join(f.attribute))
            if s is None or type(f) not in _MAY or not s.has_min_max:
                continue
            try:
                if not _MAY[type(f)](s.min, s.max, f.value):
                    return True
            except TypeError:  # statistics of another type than the constant
                continue
        return False

    def partitions(self) -> list[RowsOf]:
        fs, files = _files(self.path)
        out: list[RowsOf] = []
        for name, start, stop in parse_split(self.split):
            groups, n = [], 0
            for file in _of_split(files, name, self.path):
                with fs.open_input_file(file) as f:
                    footer = pq.read_metadata(f)
                for g in range(footer.num_row_groups):
                    rows = footer.row_group(g).num_rows
                    groups.append((file, g, n, rows, self._ruled_out(footer.row_group(g))))
                    n += rows
            low, high = row_range(start, stop, n)
            out += [RowsOf(file, g, max(low - first, 0), min(high - first, rows))
                    for file, g, first, rows, skip in groups if not skip and first < high and first + rows > low]
        return out or [RowsOf("", 0, 0, 0)]

    def read(self, partition: RowsOf) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _files(self.path)
        names = dict.fromkeys([*self.columns, *[f.attribute[0] for f in self.filters]])
        with fs.open_input_file(partition.file) as f:
            rows = pq.ParquetFile(f).read_row_group(partition.group, columns=list(names)).slice(partition.start, partition.stop - partition.start)
        keep = self._expression()
        yield from (rows if keep is None else rows.filter(keep)).select(self.columns).to_batches()


class PushingSplitReader(SplitReader):
    """Takes comparisons of top-level columns with constants, and tests for null."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if isinstance(f, (*_COMPARE, D.IsNull, D.IsNotNull)) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f


class SplitTable(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "split_table"

    def schema(self) -> T.StructType:
        fs, files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Parquet file in {self.options['path']}")
        with fs.open_input_file(files[0]) as f:
            whole = from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=False)
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return T.StructType([whole[c] for c in names]) if names else whole

    def reader(self, schema: T.StructType) -> SplitReader:
        return (PushingSplitReader if self.options.get("pushdown") == "true" else SplitReader)(self.options, schema)


def read_split(spark: SparkSession, path: str, split: str = "train", columns: list[str] | None = None) -> DataFrame:
    """The rows of ``split`` of the Parquet table at ``path``."""
    parse_split(split)
    ship_package(spark)
    spark.dataSource.register(SplitTable)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("split_table").option("split", split).option("pushdown", push)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
