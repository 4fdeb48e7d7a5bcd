"""JSON log files of any size, cut into byte ranges that are read by different tasks.

A file holds an array of objects, or an object with that array under ``Logs``. Its ranges are rows of a table: a task opens the
file at its range, so no text is shuffled. Whether a range starts inside a string, and how deep, follows from the
ranges before it: one pass counts quotes and brackets of each range for both cases, and running totals over the ranges
of a file choose. A record belongs to the range in which it begins and is read to its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.session import materialize
from roadlens.sources.ranges import BEYOND, RANGE, file_ranges, file_system, spread, tasks

_QUOTE, _BACKSLASH = 34, 92
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


class Structure:
    """Strings and brackets of a piece of JSON text, given the state before it."""

    def __init__(self, data: np.ndarray, quoted: bool, depth: int, lead: int = 0):
        quotes = np.flatnonzero(data == _QUOTE)
        plain = np.flatnonzero(data != _BACKSLASH)
        # backslashes right before each quote; those before the piece count too
        near = np.searchsorted(plain, quotes) - 1
        before = np.where(near >= 0, plain[near] if len(plain) else -1, -1 - lead)
        self.quotes = quotes[(quotes - 1 - before) % 2 == 0]
        self.quoted = quoted
        at = np.flatnonzero(_STEP[data])
        outside = (np.searchsorted(self.quotes, at) + quoted) % 2 == 0
        self.at = at[outside]
        self.step = _STEP[data[self.at]].astype(np.int64)
        self.after = depth + np.cumsum(self.step)
        self.depth = depth

    def ends_quoted(self) -> bool:
        return bool((len(self.quotes) + self.quoted) % 2)

    def ends_at(self) -> int:
        return int(self.after[-1]) if len(self.at) else self.depth

    def objects(self, data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the objects that begin at a depth, and the place after each one's end (-1: not in the piece)."""
        starts = self.at[(data[self.at] == ord("{")) & (self.after - self.step == level)]
        ends = self.at[(data[self.at] == ord("}")) & (self.after == level)] + 1
        where = np.searchsorted(ends, starts, side="right")
        return starts, np.where(where < len(ends), ends[np.minimum(where, len(ends) - 1)] if len(ends) else -1, -1)

    def strings(self, level: int) -> list[tuple[int, int]]:
        """Opening and closing quotes of the strings that start at a depth (closing -1: not in the piece)."""
        opening = self.quotes[int(self.quoted) :: 2]
        closing = self.quotes[int(self.quoted) + 1 :: 2]
        place = np.searchsorted(self.at, opening) - 1
        depth = np.where(place >= 0, self.after[place] if len(self.at) else 0, self.depth)
        mine = np.flatnonzero(depth == level)
        return [(int(opening[i]), int(closing[i]) if i < len(closing) else -1) for i in mine]


def _lead(f, start: int) -> int:
    """Backslashes directly before a place."""
    count = 0
    while start > count:
        size = min(4096, start - count)
        f.seek(start - count - size)
        block = f.read(size)
        run = len(block) - len(block.rstrip(b"\\"))
        count += run
        if run < size:
            break
    return count


def _root_kind(f) -> bytes:
    f.seek(0)
    return f.read(4096).lstrip(b"\xef\xbb\xbf \t\r\n")[:1]


def _states(ranges: DataFrame, root: str, parts: int) -> DataFrame:
    """The ranges with ``quoted`` and ``depth`` at their start."""

    def run(batches):
        system, base = file_system(root)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with system.open_input_file(f"{base.rstrip('/')}/{r['file']}") as f:
                    lead = _lead(f, r["start"])
                    f.seek(r["start"])
                    data = np.frombuffer(f.read(r["stop"] - r["start"]), np.uint8)
                plain, quoted = Structure(data, False, 0, lead), Structure(data, True, 0, lead)
                out.append((r["file"], r["start"], len(plain.quotes) % 2, plain.ends_at(), quoted.ends_at()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), *[pa.int64()] * 4])] if out else [pa.array([], t) for t in [pa.string(), *[pa.int64()] * 4]],
                names=["file", "start", "odd", "plain", "inside"],
            )

    some = spread(ranges.select("file", "start", "stop"), parts).mapInArrow(run, "file string, start long, odd long, plain long, inside long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = some.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    moved = quoted.withColumn("_move", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("plain")))
    states = moved.select("file", "start", "quoted", F.coalesce(F.sum("_move").over(before), F.lit(0)).alias("depth"))
    return ranges.join(states, ["file", "start"])


_ROWS = "file string, start long, place long, text string, section string, root string, whole boolean"


def _read_range(f, r: dict) -> tuple[list[tuple[int, str, str | None]], int, str | None, str, bool | None]:
    """Records that begin in a range (place, text, section), their number, the last section, the root's kind, and at the file's end its state."""
    kind = _root_kind(f)
    level = 1 if kind == b"[" else 2
    lead = _lead(f, r["start"])
    own, more = r["stop"] - r["start"], BEYOND
    while True:
        upto = min(r["size"], r["stop"] + more)
        f.seek(r["start"])
        raw = f.read(upto - r["start"])
        data = np.frombuffer(raw, np.uint8)
        s = Structure(data, r["quoted"], r["depth"], lead)
        starts, ends = s.objects(data, level)
        mine = starts < own
        starts, ends = starts[mine], ends[mine]
        strings = [x for x in s.strings(1) if x[0] < own] if level == 2 else []
        cut = (ends < 0).any() or any(e < 0 or not raw[e + 1 :].lstrip() for _, e in strings)
        if not cut or upto == r["size"]:
            break
        more *= 4
    # a string of the root object is a key if a colon follows
    keys = [(b, raw[b + 1 : e].decode("utf-8", "replace")) for b, e in strings if e >= 0 and raw[e + 1 :].lstrip()[:1] == b":"]
    where = np.searchsorted([b for b, _ in keys], starts) - 1
    rows = []
    for i, (b, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if e >= 0:
            section = "Logs" if level == 1 else keys[where[i]][1] if where[i] >= 0 else None
            rows.append((i, raw[b:e].decode("utf-8", "replace"), section))
    whole = None
    if r["stop"] == r["size"]:
        whole = kind in (b"[", b"{") and s.ends_at() == 0 and not s.ends_quoted()
    return rows, len(starts), keys[-1][1] if keys else None, kind.decode("latin-1"), whole


def read_log_records(files: DataFrame, root: str, record: T.StructType, *, size: int = RANGE) -> DataFrame:
    """``file, ord`` and the fields of each record of the named files (column ``file``: path below ``root``).

    ``ord`` numbers the records of a file in order, without gaps. A file that does not exist, is not closed, has another
    root than an array or an object with ``Logs``, or holds a record that is not JSON gives no records; array elements that are no
    objects are passed over. Names stay in the table: the driver sees only how many ranges there are.
    """
    ranges = file_ranges(files, root, size)
    seen = ranges.agg(F.count("*").alias("n"), F.max("start").alias("last"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    parts = tasks(seen["n"], seen["bytes"] or 0)
    if seen["last"]:
        states = _states(ranges, root, parts)
    else:  # every file is one range
        states = ranges.select("*", F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("depth"))

    def run(batches):
        system, base = file_system(root)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{base.rstrip('/')}/{r['file']}") as f:
                    rows, n, last, kind, whole = _read_range(f, r)
                # the last row tells of the range itself
                columns = [[r["file"]] * (len(rows) + 1), [r["start"]] * (len(rows) + 1), [x[0] for x in rows] + [n], [x[1] for x in rows] + [None]]
                columns += [[x[2] for x in rows] + [last], [None] * len(rows) + [kind], [None] * len(rows) + [whole]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "start", "place", "text", "section", "root", "whole"])

    read = spread(states, parts).mapInArrow(run, _ROWS)
    schema = T.StructType([*record.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("text", schema, {"columnNameOfCorruptRecord": "_broken"})
    rows = materialize(read.withColumn("_rec", parsed).withColumn("_broken", F.col("_rec._broken").isNotNull()).drop("text"), "json-records")

    of_range = rows.groupBy("file", "start").agg(
        F.max(F.when(F.col("root").isNotNull(), F.col("place"))).alias("n"),
        F.max(F.when(F.col("root").isNotNull(), F.col("section"))).alias("last"),
        F.bool_or("whole").alias("whole"),
        F.bool_or("_broken").alias("broken"),
    )
    order = Window.partitionBy("file").orderBy("start")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    placed = of_range.select(
        "file",
        "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"),
        F.last("last", ignorenulls=True).over(before).alias("_section"),
        (F.bool_or("whole").over(all_) & ~F.coalesce(F.bool_or("broken").over(all_), F.lit(False))).alias("_good"),
    )
    records = rows.where("root is null").join(placed.where("_good"), ["file", "start"])
    kept = records.where(F.coalesce("section", "_section") == "Logs")
    return kept.select("file", (F.col("_base") + F.col("place")).alias("ord"), *[F.col("_rec")[f.name].alias(f.name) for f in record.fields])
