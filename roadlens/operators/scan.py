"""Ordered scans over trips of any size.

A plain ``Window.partitionBy(trip)`` puts a whole trip into one task, which
fails once a single trip holds a large part of the data. Here rows are first
put into one global order (a range-partitioned sort, which splits a hot trip
over many tasks) and numbered; a *chunk* is a fixed-size run of that order.
Window functions then run per (trip, chunk), one summary row per chunk is
carried across chunks, and both are combined:

    value(row) = merge(value inside the chunk, carry of the other chunks)

The carry tables have one row per chunk, so they stay small: a trip of 10^9
rows has about 4,000 of them at the default chunk size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.session import materialize

SEQ = "_seq"
CHUNK = "_chunk"
CHUNK_BITS = 18

_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sequence(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """Number the rows in (keys, order) and cut the order into chunks.

    ``_seq`` grows with the order (gaps are possible), ``_chunk`` is a run of at
    most ``2**chunk_bits`` consecutive rows. The result is a written table:
    partition ids are part of ``_seq``, so they have to be frozen.
    """
    base = df.drop(SEQ, CHUNK)
    # the sort is range-partitioned by keys and order, so a hot trip is split by time
    ordered = base.sort(*[F.col(k) for k in keys], *[as_col(o) for o in order])
    numbered = ordered.select("*", F.monotonically_increasing_id().alias(SEQ))
    return materialize(numbered.withColumn(CHUNK, F.shiftright(SEQ, chunk_bits)), "sequence")


@dataclass(frozen=True)
class Scan:
    """One scanned column: its value inside a chunk, a summary row per chunk,
    the carry computed from the other summaries, and the merge of the two."""

    local: Callable[["_Windows"], Column]
    summary: Callable[[], Column]
    carry: Callable[[Column, "_Windows"], Column]
    merge: Callable[[Column, Column, "_Windows"], Column]


@dataclass(frozen=True)
class _Windows:
    rows: object  # rows of one (keys, chunk), in order
    chunks: object  # summaries of one key, in order
    rows_back: object  # the same from the end: a frame that grows is linear, one that shrinks is not
    chunks_back: object
    head: str = "_head"
    tail: str = "_tail"


def lag(c: str | Column) -> Scan:
    """Value of the row before, null values included."""
    c = as_col(c)
    return Scan(
        lambda w: F.lag(c).over(w.rows),
        lambda: F.max_by(c, F.col(SEQ)),
        lambda s, w: F.lag(s).over(w.chunks),
        lambda local, carry, w: F.when(F.col(w.head), carry).otherwise(local),
    )


def lead(c: str | Column) -> Scan:
    """Value of the row after, null values included."""
    c = as_col(c)
    return Scan(
        lambda w: F.lead(c).over(w.rows),
        lambda: F.min_by(c, F.col(SEQ)),
        lambda s, w: F.lead(s).over(w.chunks),
        lambda local, carry, w: F.when(F.col(w.tail), carry).otherwise(local),
    )


def last_known(c: str | Column, inclusive: bool = True) -> Scan:
    """Latest non-null value up to (or strictly before) the row."""
    c = as_col(c)
    upto = 0 if inclusive else -1
    return Scan(
        lambda w: F.last(c, ignorenulls=True).over(w.rows.rowsBetween(_START, upto)),
        lambda: F.max_by(c, F.when(c.isNotNull(), F.col(SEQ))),
        lambda s, w: F.last(s, ignorenulls=True).over(w.chunks.rowsBetween(_START, -1)),
        lambda local, carry, w: F.coalesce(local, carry),
    )


def next_known(c: str | Column, inclusive: bool = True) -> Scan:
    """Earliest non-null value from (or strictly after) the row on."""
    c = as_col(c)
    upto = 0 if inclusive else -1
    return Scan(
        lambda w: F.last(c, ignorenulls=True).over(w.rows_back.rowsBetween(_START, upto)),
        lambda: F.min_by(c, F.when(c.isNotNull(), F.col(SEQ))),
        lambda s, w: F.last(s, ignorenulls=True).over(w.chunks_back.rowsBetween(_START, -1)),
        lambda local, carry, w: F.coalesce(local, carry),
    )


def running_sum(c: str | Column, inclusive: bool = True) -> Scan:
    """Sum of the non-null values up to (or strictly before) the row, null if there are none."""
    c = as_col(c)
    upto = 0 if inclusive else -1
    return Scan(
        lambda w: F.sum(c).over(w.rows.rowsBetween(_START, upto)),
        lambda: F.sum(c),
        lambda s, w: F.sum(s).over(w.chunks.rowsBetween(_START, -1)),
        lambda local, carry, w: F.coalesce(local + carry, local, carry),
    )


def running_count(c: str | Column, inclusive: bool = True) -> Scan:
    """Number of non-null values up to (or strictly before) the row."""
    c = as_col(c)
    upto = 0 if inclusive else -1
    return Scan(
        lambda w: F.count(c).over(w.rows.rowsBetween(_START, upto)),
        lambda: F.count(c),
        lambda s, w: F.sum(s).over(w.chunks.rowsBetween(_START, -1)),
        lambda local, carry, w: local + F.coalesce(carry, F.lit(0)),
    )


def running_max(c: str | Column, inclusive: bool = True) -> Scan:
    """Largest value up to (or strictly before) the row."""
    c = as_col(c)
    upto = 0 if inclusive else -1
    return Scan(
        lambda w: F.max(c).over(w.rows.rowsBetween(_START, upto)),
        lambda: F.max(c),
        lambda s, w: F.max(s).over(w.chunks.rowsBetween(_START, -1)),
        lambda local, carry, w: F.greatest(local, carry),  # greatest skips nulls
    )


def _whole(summary: Callable[[], Column], fold: Callable[[Column], Column]) -> Scan:
    return Scan(
        lambda w: F.lit(None).cast("boolean"),
        summary,
        lambda s, w: fold(s).over(w.chunks.rowsBetween(_START, _END)),
        lambda local, carry, w: carry,
    )


def total_sum(c: str | Column) -> Scan:
    """Sum over the whole key."""
    return _whole(lambda: F.sum(as_col(c)), F.sum)


def total_count(c: str | Column) -> Scan:
    """Number of non-null values of the whole key."""
    return _whole(lambda: F.count(as_col(c)), F.sum)


def total_min(c: str | Column) -> Scan:
    return _whole(lambda: F.min(as_col(c)), F.min)


def total_max(c: str | Column) -> Scan:
    return _whole(lambda: F.max(as_col(c)), F.max)


def first_of_all(c: str | Column) -> Scan:
    """First non-null value of the whole key."""
    c = as_col(c)
    return _whole(
        lambda: F.min_by(c, F.when(c.isNotNull(), F.col(SEQ))), lambda s: F.first(s, ignorenulls=True)
    )


def scan(df: DataFrame, keys: Sequence[str], **specs: Scan) -> DataFrame:
    """Add one column per spec to a table made by :func:`sequence`."""
    # one struct key: it is equal to itself even where parts are null, and the plain
    # equality lets the join reuse the partitioning of the window, without a second shuffle
    keyed = df.withColumn("_key", F.struct(*keys))
    w = _Windows(
        Window.partitionBy("_key", CHUNK).orderBy(SEQ),
        Window.partitionBy("_key").orderBy(CHUNK),
        Window.partitionBy("_key", CHUNK).orderBy(F.col(SEQ).desc()),
        Window.partitionBy("_key").orderBy(F.col(CHUNK).desc()),
    )
    rows = keyed.select(
        "*",
        F.lag(F.lit(1)).over(w.rows).isNull().alias(w.head),
        F.lead(F.lit(1)).over(w.rows).isNull().alias(w.tail),
        *[s.local(w).alias(f"_l_{n}") for n, s in specs.items()],
    )
    summaries = keyed.groupBy("_key", CHUNK).agg(*[s.summary().alias(f"_s_{n}") for n, s in specs.items()])
    carries = summaries.select(
        F.col("_key").alias("_k_key"),
        F.col(CHUNK).alias("_k_chunk"),
        *[s.carry(F.col(f"_s_{n}"), w).alias(f"_c_{n}") for n, s in specs.items()],
    )
    same = (F.col("_key") == F.col("_k_key")) & (F.col(CHUNK) == F.col("_k_chunk"))
    merged = {n: s.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}"), w) for n, s in specs.items()}
    kept = [c for c in df.columns if c not in specs]
    return rows.join(carries, same, "left").select(*kept, *[c.alias(n) for n, c in merged.items()])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    build: Callable[[object], dict[str, Column]],
    block_rows: int = 1 << CHUNK_BITS,
) -> DataFrame:
    """Fixed-width row frames (rolling sums, n-row leads).

    Rows get their position in the key; blocks of ``block_rows`` positions are
    processed independently, with the ``before``/``after`` rows next to a block
    copied into it, so a frame never needs a row of another block.
    """
    block_rows = max(block_rows, before, after, 1)
    pos = scan(df, keys, _pos=running_count(F.lit(1), inclusive=False))
    own = F.floor(F.col("_pos") / block_rows).cast("long")
    offset = F.col("_pos") % block_rows
    homes = F.array(
        F.struct(own.alias("b"), F.lit(False).alias("copy")),
        F.when(offset >= block_rows - before, F.struct((own + 1).alias("b"), F.lit(True).alias("copy"))),
        F.when(
            (offset < after) & (own > 0), F.struct((own - 1).alias("b"), F.lit(True).alias("copy"))
        ),
    )
    spread = pos.select("*", F.explode(F.array_compact(homes)).alias("_home")).select(
        "*", F.col("_home.b").alias("_block"), F.col("_home.copy").alias("_copy")
    )
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    out = spread.select("*", *[c.alias(n) for n, c in build(w).items()])
    return out.where(~F.col("_copy")).drop("_home", "_block", "_copy", "_pos")
