"""Byte ranges of files as rows of a table: tasks open a file at their range, so no text is shuffled and no name goes to the driver."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.session import materialize

#: Bytes of a range, bytes read beyond it at first, bytes of a task, and the fewest and most tasks of a pass.
RANGE, BEYOND, PER_TASK, FEWEST, TASKS = 8 << 20, 64 << 10, 8 << 20, 32, 20_000


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``root`` and the path of ``root`` in it."""
    plain = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", root))
    return fs.FileSystem.from_uri(plain)


def file_ranges(files: DataFrame, root: str, size: int) -> DataFrame:
    """``file, size, start, stop`` of the named files (column ``file``: path below ``root``) that exist, written once."""

    def run(batches):
        system, base = file_system(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = system.get_file_info([f"{base.rstrip('/')}/{n}" for n in names])
            there = [(n, i.size) for n, i in zip(names, found) if i.type == fs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in there], pa.string()), pa.array([s for _, s in there], pa.int64())], names=["file", "size"])

    named = files.select("file").where("file is not null").distinct()
    known = named.mapInArrow(run, "file string, size long").where("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long")))
    cut = known.select("file", "size", starts.alias("start"))
    return materialize(cut.withColumn("stop", F.least(F.col("start") + size, "size")), "file-ranges")


def tasks(ranges: int, size: int) -> int:
    """The tasks for so many ranges with so many bytes: small ranges share a task, so that tasks grow with the bytes."""
    return max(1, min(ranges, max(FEWEST, -(-size // PER_TASK)), TASKS))


def spread(ranges: DataFrame, parts: int) -> DataFrame:
    """Ranges dealt over tasks; partitions of few small rows are not merged again."""
    return ranges.repartition(parts, "file", "start")
