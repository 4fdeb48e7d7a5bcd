"""Shared helpers of the text operators: table access, Arrow mapping, intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from roadlens.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rows of an Arrow batch that are Python objects at the same time.
SLICE = 256

#: Writer options for rows of some MB: the size is looked at after every row (not first after 100), so that a row group, which
#: Spark's reader holds as one batch, is closed after a row or a few. Without statistics, of which the writer would hold
#: the whole least and greatest value of each row group until its file ends.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.column.statistics.enabled": "false"}


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage, with its SQL twin if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there."""
    return materialize(df, f"llm-{name}", **options)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """Run ``make()`` once per task, then its result on slices of a few rows.

    The inner function gets a record batch and returns a dict of columns (lists or arrays).
    A lost executor only repeats its tasks; memory is bounded by one slice of whole texts.
    """
    target = _struct(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        work = make()
        for part in slices(batches):
            columns = work(part)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def _struct(schema: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def texts_of(part: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [t or "" for t in part.column(part.schema.get_field_index(name)).to_pylist()]


def ids_of(part: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) from the MD5 of the columns' text: the same in any engine and plan."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
