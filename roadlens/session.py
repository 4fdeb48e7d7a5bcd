"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the cluster names it.

    A local session without a configured folder (tests, notebooks) gets a
    temporary one. On a cluster a machine-local folder would not be readable
    from other executors, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can read")
    folder = tempfile.mkdtemp(prefix="spark-roadlens-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str = "stage", **options: object) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of replaying the
    plan), freezes non-deterministic columns, and gives later stages a columnar
    scan with real size statistics. ``options`` are those of the Parquet writer.
    """
    path = f"{work_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
