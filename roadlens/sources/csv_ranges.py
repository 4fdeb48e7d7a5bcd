"""Comma-separated files of any size and shape, cut into byte ranges that are read by different tasks.

A line break inside quotes belongs to its record. Whether a range starts inside quotes follows from the number of quotes before it: one
narrow pass counts them in each range, a running total over the ranges of a file gives the parity, and a record belongs to the
range in which it begins. A doubled quote counts twice, so it changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.session import materialize
from roadlens.sources.ranges import BEYOND, RANGE, file_ranges, file_system, spread, tasks

_QUOTE, _BREAK = 34, 10


def _parities(ranges: DataFrame, root: str, parts: int) -> DataFrame:
    """The ranges with ``quoted``: is the first byte inside quotes?"""

    def run(batches):
        system, base = file_system(root)
        for batch in batches:
            odd = []
            for r in batch.to_pylist():
                with system.open_input_file(f"{base.rstrip('/')}/{r['file']}") as f:
                    f.seek(r["start"])
                    odd.append(f.read(r["stop"] - r["start"]).count(b'"') % 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd, pa.int64())], names=["file", "start", "odd"])

    some = spread(ranges.select("file", "start", "stop"), parts).mapInArrow(run, "file string, start long, odd long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.join(some.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("quoted")), ["file", "start"])


def record_ends(data: np.ndarray, quoted: bool) -> np.ndarray:
    """Places of the line breaks outside quotes."""
    breaks = np.flatnonzero(data == _BREAK)
    return breaks[(np.searchsorted(np.flatnonzero(data == _QUOTE), breaks) + quoted) % 2 == 0]


def _read_range(f, r: dict) -> list[str]:
    own, more = r["stop"] - r["start"], BEYOND
    f.seek(max(0, r["start"] - 1))
    fresh = r["start"] == 0 or (f.read(1) == b"\n" and not r["quoted"])
    while True:
        upto = min(r["size"], r["stop"] + more)
        f.seek(r["start"])
        raw = f.read(upto - r["start"])
        ends = record_ends(np.frombuffer(raw, np.uint8), r["quoted"])
        starts = np.r_[np.zeros(int(fresh), np.int64), ends + 1]
        starts = starts[starts < own]
        where = np.searchsorted(ends, starts)
        if (where < len(ends)).all() or upto == r["size"]:
            break
        more *= 4
    stops = np.r_[ends, len(raw)][where]
    return [raw[b:e].removesuffix(b"\r").decode("utf-8", "replace") for b, e in zip(starts.tolist(), stops.tolist())]


def read_lines(files: DataFrame, root: str, *, size: int = RANGE) -> DataFrame:
    """``file, ord, value``: the records of the named files (column ``file``: path below ``root``) as text, quotes left in.

    ``ord`` numbers the records of a file in order, without gaps; a byte order mark is dropped. Quotes that are never closed hold the
    rest of the file as one record. Files that do not exist or are empty have no records.
    """
    ranges = file_ranges(files, root, size)
    seen = ranges.agg(F.count("*").alias("n"), F.max("start").alias("last"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    parts = tasks(seen["n"], seen["bytes"] or 0)
    known = _parities(ranges, root, parts) if seen["last"] else ranges.withColumn("quoted", F.lit(False))

    def run(batches):
        system, base = file_system(root)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{base.rstrip('/')}/{r['file']}") as f:
                    lines = _read_range(f, r)
                if r["start"] == 0 and lines:
                    lines[0] = lines[0].removeprefix("\ufeff")
                n = len(lines)
                columns = [pa.array([r["file"]] * n, pa.string()), pa.array([r["start"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "place", "value"])

    rows = materialize(spread(known, parts).mapInArrow(run, "file string, start long, place long, value string"), "csv-records")
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, ["file", "start"]).select("file", (F.col("_base") + F.col("place")).alias("ord"), "value")
