"""Raw log files: shipped tables are written as JSON arrays and comma-separated text, read back in byte ranges, and compared."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.catalog import query
from roadlens.operators import quality as Q
from roadlens.session import work_dir
from roadlens.sources import shipped as D
from roadlens.sources.json_ranges import read_log_records

#: Bytes of a range in these queries: small, so that records cross range borders at every scale.
SIZE = 64 << 10

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
NAMES = ["doc_id", "text", "lang", "source"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the written files; their contents are not read."""
    return spark.read.format("binaryFile").load(f"{folder}/*.txt").select(F.substring_index("path", "/", -1).alias("file"))


def write_log_files(records: DataFrame, folder: str) -> None:
    """One file a partition, each an object with the records under ``Logs``."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": ['{"Logs": [']})
        comma = ""
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("," if i else comma) + x for i, x in enumerate(lines)], pa.string())], names=["value"])
            comma = "," if lines or comma else ""
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    records.select(F.to_json(F.struct(*records.columns)).alias("value")).mapInArrow(run, "value string").write.text(folder)


@query("json_log_records", "SELECT event_id, user_id, event_type, value, props FROM events")
def json_log_records(spark, sf):
    """Events as log files (their properties are JSON inside strings), read back record by record."""
    folder = _folder(spark, "json-logs")
    write_log_files(D.table(spark, sf, "events").select(*EVENT.names), folder)
    return read_log_records(_files(spark, folder), folder, EVENT, size=SIZE).select(*EVENT.names)


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def _ragged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as quoted records: every tenth has a field too many before its language, every tenth lacks its source."""
    d = D.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    kind = F.pmod("doc_id", F.lit(10))
    head = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted("text"))
    line = F.when(kind == 3, F.concat_ws(",", head, F.lit("extra"), "lang", "source")).when(kind == 7, F.concat_ws(",", head, "lang")).otherwise(F.concat_ws(",", head, "lang", "source"))
    folder = _folder(spark, "csv-records")
    d.select(line.alias("value")).write.text(folder)
    return Q.read_ragged(_files(spark, folder), folder, size=SIZE)


@query(
    "quoted_records",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5, CASE WHEN doc_id % 10 = 3 THEN 'extra' ELSE lang END AS lang,
  CASE doc_id % 10 WHEN 3 THEN lang WHEN 7 THEN NULL ELSE source END AS source, CASE doc_id % 10 WHEN 3 THEN 5 WHEN 7 THEN 3 ELSE 4 END AS n_fields
FROM documents""",
)
def quoted_records(spark, sf):
    """Texts with line breaks, quotes and commas inside quotes come back whole."""
    rows = Q.pad_fields(_ragged_documents(spark, sf), NAMES)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_fields")


@query(
    "check_structural",
    """WITH c(column_name, check_id, bad, n_rows_checked, n_rows_failed) AS (
  SELECT '*', 'fields.count', 'FAIL', count(*), count(*) FILTER (doc_id % 10 IN (3, 7)) FROM documents
  UNION ALL SELECT 'lang', 'fields.shifted', 'FAIL', count(*), count(*) FILTER (doc_id % 10 = 3) FROM documents
  UNION ALL SELECT 'surplus', 'fields.surplus', 'WARN', count(*) FILTER (doc_id % 10 = 3), count(*) FILTER (doc_id % 10 = 3) FROM documents)
SELECT column_name, check_id, 'structural' AS check_type, CASE WHEN n_rows_failed = 0 THEN 'PASS' ELSE bad END AS status,
  n_rows_checked, n_rows_failed, CASE WHEN n_rows_checked > 0 THEN round(100.0 * n_rows_failed / n_rows_checked, 4) ELSE 0.0 END AS pct_failed FROM c""",
)
def check_structural(spark, sf):
    """Counts of wrong lengths, shifted records and surplus fields over all documents written as records."""
    out = Q.check_structural(_ragged_documents(spark, sf), NAMES, "lang", "^extra$")
    return out.drop("example_failing_rows", "notes")
