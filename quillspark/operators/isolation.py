"""Work on rows one by one in Python, where a row that fails is a row of the result.

The error of one document must not end a batch of millions.  A function over a row gives any number of result
rows; what it raises becomes one row with the error's text and null columns.  Rows that fail are counted as
status ``internal``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Result rows that are handed to Spark at once, so that one document's rows needn't fit a single frame.
ROWS_AT_ONCE = 10_000


def _given(value):
    return None if value != value else value


def map_isolated(rows: DataFrame, key: str, arguments: list[str], function: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """*key*, the columns of *schema* and ``error`` for what *function* gives for each row's *arguments*.

    A row whose function raises has exactly one row, with the error; what it gave before it raised is dropped.
    A value that doesn't fit its column is such an error too.  Null arguments are passed as None.
    """
    types = T._parse_datatype_string(schema)
    names = [f.name for f in types]
    bounds = [(i, -(2**63), 2**63) if f.dataType == T.LongType() else (i, -(2**31), 2**31) for i, f in enumerate(types) if f.dataType in (T.LongType(), T.IntegerType())]
    whole = T.StructType([T.StructField(key, rows.schema[key].dataType), *types, T.StructField("error", T.StringType())])
    none = [None] * len(names)

    def fitting(found: list[tuple]) -> list[tuple]:
        for i, low, high in bounds:
            for row in found:
                if row[i] is not None and not low <= row[i] < high:
                    raise OverflowError(f"{names[i]} is out of range")
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(whole)

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*found), fields)], schema=fields)

        for batch in batches:
            out: list[tuple] = []
            for k, *values in zip(*[batch.column(name).to_pylist() for name in (key, *arguments)]):
                try:
                    out += [(k, *x, None) for x in fitting(list(function(*map(_given, values))))]
                except Exception as error:  # whatever one row raises is that row's result
                    out.append((k, *none, f"{type(error).__name__}: {error}"))
                while len(out) >= ROWS_AT_ONCE:
                    yield made(out[:ROWS_AT_ONCE])
                    del out[:ROWS_AT_ONCE]
            if out:
                yield made(out)

    # the key may be one of the arguments, too
    return rows.select(*dict.fromkeys([key, *arguments])).mapInArrow(run, whole)


def good_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("error IS NULL").drop("error")


def failed_rows(outcomes: DataFrame, key: str) -> DataFrame:
    """*key*, ``error`` and ``status`` (``internal``) of the rows that failed, for ``rules.batch_summary``."""
    return outcomes.filter("error IS NOT NULL").select(key, "error", F.lit("internal").alias("status"))
