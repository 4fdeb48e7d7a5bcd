"""Incremental runs: each trigger enriches the trips whose manifest rows arrived since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from roadlens.plans import enrich
from roadlens.session import materialize
from roadlens.sources import logs, sinks

MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Id", "Condition", "Map", "Scenario", "triggered_by", "KinematicFile", "GPSFile")]
)


def run_available(spark: SparkSession, manifest_dir: str, output: str, failed: str, checkpoint: str, **paths: str) -> None:
    """Process all manifest files not seen before, then stop.

    The stream's checkpoint remembers the files; trips already in the output are
    skipped, so a batch repeated after a crash writes nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        good, rejected = logs.split_manifest(rows)
        done = sinks.finished(spark, output)
        todo = materialize(good if done is None else logs.pending(good, done), "manifest")
        result = materialize(enrich.enrich(enrich.read_inputs(spark, manifest=todo, **paths)), "result")
        sinks.append_frames(result, output)
        sinks.append_failures(enrich.failures(todo, result, rejected), failed)

    stream = spark.readStream.schema(MANIFEST).option("header", True).csv(manifest_dir)
    query = (
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
