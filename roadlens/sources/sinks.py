"""Writers for results and failures."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens import schema as C
from roadlens.session import materialize


def canonical(df: DataFrame) -> DataFrame:
    """Exactly the 40 output columns, in order and typed; others are dropped, missing ones null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in C.FRAMES.fields]
    )


def append_frames(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append in the fixed layout, one folder per map."""
    writer = canonical(df).write.mode("append").partitionBy("Map")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def finished(spark: SparkSession, output: str) -> DataFrame | None:
    """Trips that the output holds, or None where there is none yet."""
    table = existing(spark, output)
    return None if table is None else table.select(*[F.col(c).cast("string").alias(c) for c in ("Id", "Condition", "Map")])


def append_failures(df: DataFrame, path: str) -> None:
    """Append failures that the table does not hold yet, so a repeated batch adds nothing."""
    have = set(df.columns)
    cols = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in have else F.lit("").alias(c) for c in C.FAILURES.names]
    rows, before = df.select(*cols), existing(df.sparkSession, path)
    if before is not None:
        rows = rows.join(before.select(*C.FAILURES.names).distinct(), C.FAILURES.names, "left_anti").select(*C.FAILURES.names)
    materialize(rows, "failures").write.mode("append").parquet(path)


def combine_sizes(tables: Mapping[float, DataFrame]) -> DataFrame:
    """Window tables of several sizes as one, with their size."""
    sized = [df.withColumn("window_size_sec", F.lit(float(w))) for w, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sized)


def write_windows(tables: Mapping[float, DataFrame], path: str) -> None:
    """All sizes in one table, one folder per size."""
    combine_sizes(tables).write.mode("overwrite").partitionBy("window_size_sec").parquet(path)
