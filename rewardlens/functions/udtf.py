"""Row functions as table functions for SQL, with the output schema derived from the input.

``unpair_rows(TABLE(t))`` turns each preference row of any table into two rows;
``format_row(template, name => column, ..)`` fills a template, laterally for each row.
Neither needs a schema: Spark asks ``analyze`` for it when the query is planned. They run
row by row in Python; where a Column expression will do (``unpair_preference``,
``format_text``), that is the faster way.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rewardlens.session import ship_package


@dataclass
class _Unpaired(AnalyzeResult):
    kept: list[str] = field(default_factory=list)


class UnpairRows:
    """``(kept columns.., completion, label)``: the chosen text as true, then the rejected one as false."""

    def __init__(self, plan: _Unpaired):
        self.kept = plan.kept

    @staticmethod
    def analyze(row: AnalyzeArgument) -> _Unpaired:
        if not row.isTable:
            raise ValueError("unpair_rows takes a table: unpair_rows(TABLE(t))")
        fields = {f.name: f for f in row.dataType.fields}
        if "chosen" not in fields or "rejected" not in fields:
            raise ValueError("unpair_rows needs the columns chosen and rejected")
        if fields["chosen"].dataType != fields["rejected"].dataType:
            raise ValueError("chosen and rejected have different types")
        kept = [f for name, f in fields.items() if name not in ("chosen", "rejected")]
        if {"completion", "label"} & {f.name for f in kept}:
            raise ValueError("the table has a column completion or label already")
        schema = T.StructType([*kept, T.StructField("completion", fields["chosen"].dataType), T.StructField("label", T.BooleanType())])
        return _Unpaired(schema=schema, kept=[f.name for f in kept])

    def eval(self, row: Row) -> Iterator[tuple]:
        own = tuple(row[c] for c in self.kept)
        yield (*own, row["chosen"], True)
        yield (*own, row["rejected"], False)


@dataclass
class _Formatted(AnalyzeResult):
    names: list[str] = field(default_factory=list)


class FormatRow:
    """``(text)``: the template with ``{name}`` replaced by the arguments of those names; a null fills nothing in."""

    def __init__(self, plan: _Formatted):
        self.names = plan.names

    @staticmethod
    def analyze(template: AnalyzeArgument, **fields: AnalyzeArgument) -> _Formatted:
        if not isinstance(template.value, str):
            raise ValueError("the template must be a constant text")
        names = [name for _, name, _, _ in string.Formatter().parse(template.value) if name is not None]
        if unknown := [n for n in names if n not in fields]:
            raise ValueError(f"the template names {unknown[0]!r}, which is no argument")
        return _Formatted(schema=T.StructType([T.StructField("text", T.StringType())]), names=names)

    def eval(self, template: str, **fields) -> Iterator[tuple]:
        yield (template.format(**{n: "" if fields[n] is None else fields[n] for n in self.names}),)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``unpair_rows`` and ``format_row`` known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("unpair_rows", udtf(UnpairRows))
    spark.udtf.register("format_row", udtf(FormatRow))
