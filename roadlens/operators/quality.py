"""Data-quality checks: each check is a few aggregates, turned into report rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.functions import text as X
from roadlens.operators import scan as S
from roadlens.operators import stats as ST
from roadlens.operators.quantiles import exact_quantiles
from roadlens.sources.csv_ranges import read_lines
from roadlens.sources.ranges import RANGE

REPORT = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("check_id", T.StringType()),
    T.StructField("check_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("n_rows_checked", T.LongType()),
    T.StructField("n_rows_failed", T.LongType()),
    T.StructField("pct_failed", T.DoubleType()),
    T.StructField("example_failing_rows", T.StringType()),
    T.StructField("notes", T.StringType()),
])


@dataclass(frozen=True)
class Check:
    """A row predicate: rows in ``scope`` must satisfy ``ok`` (null counts as failure unless out of scope)."""

    column: str
    check_id: str
    ok: Column
    scope: Column | None = None
    kind: str = "semantic"
    bad: str = "FAIL"
    notes: str = ""


# --- predicates -------------------------------------------------------------------------------------


def _present(c: str) -> Column:
    return F.col(c).isNotNull()


def check_format(column: str, pattern: str, **kw) -> Check:
    return Check(column, f"{column}.format", F.col(column).rlike(pattern), _present(column), **kw)


def check_enum(column: str, allowed: Sequence[str], **kw) -> Check:
    return Check(column, f"{column}.enum", F.col(column).isin(*allowed), _present(column), **kw)


def check_binary(column: str, **kw) -> Check:
    return Check(column, f"{column}.binary", F.col(column).isin(0, 1), **kw)


def check_range(column: str, low: float | None = None, high: float | None = None, **kw) -> Check:
    """Value within the given bounds."""
    v = F.col(column)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return Check(column, f"{column}.range", ok, _present(column), **kw)


def check_near_zero(column: str, eps: float, **kw) -> Check:
    """No value closer to zero than ``eps``."""
    return Check(column, f"{column}.near_zero", F.abs(F.col(column)) >= eps, _present(column), **kw)


def check_iff(left: str, right: str, **kw) -> Check:
    """Both columns are present or both are absent."""
    return Check(left, f"{left}.iff.{right}", _present(left) == _present(right), kind="cross-column", **kw)


def check_implies(left: str, right: str, **kw) -> Check:
    """Where the left column is present, so is the right one."""
    return Check(left, f"{left}.implies.{right}", _present(right), _present(left), kind="cross-column", **kw)


def check_only_where(column: str, where: Column, name: str, **kw) -> Check:
    """The column is present only on rows of a kind."""
    return Check(column, f"{column}.only.{name}", F.coalesce(where, F.lit(False)), _present(column), kind="cross-column", **kw)


def check_base_event(event: str = "SpacialEvent", base: str = "BaseEvent", **kw) -> Check:
    """The stored base event equals the recomputed one."""
    return Check(base, f"{base}.recomputed", F.col(base).eqNullSafe(X.clean_event(F.col(event))), kind="cross-column", **kw)


def check_comment_flag(text: str = "text", flag: str = "comment_flag", **kw) -> Check:
    return Check(flag, f"{flag}.recomputed", F.col(flag).eqNullSafe(X.comment_flag(F.col(text))), kind="cross-column", **kw)


def check_literal_null(column: str, **kw) -> Check:
    """No literal nan/none and no replacement character."""
    ok = ~F.lower(F.trim(column)).isin("nan", "none") & ~F.col(column).contains("�")
    return Check(column, f"{column}.hygiene", ok, _present(column), **kw)


def check_markers(column: str, pattern: str, **kw) -> Check:
    """Marker text follows its grammar."""
    return Check(column, f"{column}.markers", F.col(column).rlike(pattern), _present(column), **kw)


# --- running checks ---------------------------------------------------------------------------------


def run_checks(df: DataFrame, checks: Sequence[Check], row_id: str, examples: int = 5) -> DataFrame:
    """Report rows of all predicate checks from one pass over the table.

    Counts, and the smallest ``examples`` failing row ids. The ids come from a
    second, filtered pass that ranks per check inside partitions first, so no
    check ever gathers all its failures.
    """
    bad, seen = [], []
    for c in checks:
        scope = F.lit(True) if c.scope is None else F.coalesce(c.scope, F.lit(False))
        bad.append(scope & ~F.coalesce(c.ok, F.lit(False)))
        seen.append(scope)
    counts = df.agg(*[F.count_if(s).alias(f"n{i}") for i, s in enumerate(seen)], *[F.count_if(b).alias(f"b{i}") for i, b in enumerate(bad)])
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("checked"), F.col(f"b{i}").alias("failed")) for i in range(len(checks))
    ])
    flat = counts.select(F.inline(cells))
    failing = df.select(
        F.col(row_id).cast("string").alias("id"), F.col(row_id).alias("o"),
        F.explode(F.array_compact(F.array(*[F.when(b, F.lit(i)) for i, b in enumerate(bad)]))).alias("i"),
    )
    local = Window.partitionBy("i", "_p").orderBy("o")
    whole = Window.partitionBy("i").orderBy("o")
    # the five smallest per slice, then of those
    sliced = failing.withColumn("_p", F.pmod(F.xxhash64("o"), F.lit(256))).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= examples)
    few = sliced.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= examples)
    shown = few.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda s: s["id"]), ", ").alias("shown"))
    meta = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in (("column_name", c.column), ("check_id", c.check_id), ("check_type", c.kind), ("bad", c.bad), ("notes", c.notes))])
        for c in checks
    ])
    m = F.get(meta, F.col("i"))
    return flat.join(shown, "i", "left").select(
        m["column_name"].alias("column_name"), m["check_id"].alias("check_id"), m["check_type"].alias("check_type"),
        F.when(F.col("failed") == 0, "PASS").otherwise(m["bad"]).alias("status"),
        F.col("checked").alias("n_rows_checked"), F.col("failed").alias("n_rows_failed"),
        F.when(F.col("checked") > 0, F.round(100.0 * F.col("failed") / F.col("checked"), 4)).otherwise(0.0).alias("pct_failed"),
        F.coalesce("shown", F.lit("")).alias("example_failing_rows"), m["notes"].alias("notes"),
    )


def _row(column: str, check_id: str, kind: str, checked: Column, failed: Column, bad: str, notes: Column) -> list[Column]:
    return [
        F.lit(column).alias("column_name"), F.lit(check_id).alias("check_id"), F.lit(kind).alias("check_type"),
        F.when(failed == 0, "PASS").otherwise(bad).alias("status"), checked.alias("n_rows_checked"), failed.alias("n_rows_failed"),
        F.when(checked > 0, F.round(100.0 * failed / checked, 4)).otherwise(0.0).alias("pct_failed"),
        F.lit("").alias("example_failing_rows"), notes.alias("notes"),
    ]


def check_rows_per_group(df: DataFrame, group: str) -> DataFrame:
    """Informational row: spread of the row counts per participant."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    one = per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.avg("n").alias("avg"), F.max("n").alias("hi"), F.stddev_samp("n").alias("sd")
    )
    note = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.round(F.col(c), 2).cast("string")) for n, c in (("groups", "k"), ("min", "lo"), ("mean", "avg"), ("max", "hi"), ("sd", "sd"))])
    return one.select(*_row(group, f"{group}.rows_per_group", "structural", F.col("rows"), F.lit(0).cast("long"), "WARN", note))


def check_bounding_box(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, factor: float = 2.0) -> DataFrame:
    """Values far outside the exact low/high quantiles, widened by a multiple of their size."""
    q = exact_quantiles(df, [], column, {"lo": low, "hi": high}).first()
    if q is None:
        return df.sparkSession.createDataFrame([], REPORT)
    a, b = q["lo"] - factor * abs(q["lo"]), q["hi"] + factor * abs(q["hi"])
    v = F.col(column)
    one = df.agg(F.count(v).alias("n"), F.count_if((v < a) | (v > b)).alias("bad"))
    return one.select(*_row(column, f"{column}.box", "semantic", F.col("n"), F.col("bad"), "WARN", F.lit(f"{a:.6g} .. {b:.6g}")))


def check_monotone(df: DataFrame, keys: Sequence[str], column: str, tolerance: float = 0.0, bad: str = "FAIL") -> DataFrame:
    """Steps below ``tolerance`` within a trip; ``df`` is sequenced by the keys."""
    steps = S.scan(df, keys, _prev=S.lag(column))
    step = F.col(column) - F.col("_prev")
    one = steps.agg(F.count(step).alias("n"), F.count_if(step < tolerance).alias("bad"))
    return one.select(*_row(column, f"{column}.monotone", "semantic", F.col("n"), F.col("bad"), bad, F.lit("")))


def check_phase_order(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """Phases of one run never step back; ``keys`` include the run."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(column))
    ranked = df.withColumn("_rank", F.when(F.col(column).isNotNull(), rank))
    steps = S.scan(ranked.where("_rank is not null"), keys, _prev=S.lag("_rank"))
    one = steps.agg(F.count("_prev").alias("n"), F.count_if(F.col("_rank") < F.col("_prev")).alias("bad"))
    return one.select(*_row(column, f"{column}.order", "semantic", F.col("n"), F.col("bad"), "WARN", F.lit("")))


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of equal key columns."""
    per = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad"))
    name = "+".join(columns)
    return one.select(*_row(columns[0], f"{name}.unique", "structural", F.col("n"), F.col("bad"), "FAIL", F.lit("")))


def check_single_value(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups that hold more than one value."""
    per = df.where(_present(column)).select(*keys, column).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    one = per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("bad"))
    return one.select(*_row(column, f"{column}.single", "cross-column", F.col("n"), F.col("bad"), "FAIL", F.lit("")))


def check_presence(df: DataFrame, group: str, column: str, pattern: str) -> DataFrame:
    """Groups in which no value matches."""
    per = df.groupBy(group).agg(F.coalesce(F.bool_or(F.col(column).rlike(pattern)), F.lit(False)).alias("has"))
    one = per.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has")).alias("bad"))
    return one.select(*_row(column, f"{column}.present_per.{group}", "semantic", F.col("n"), F.col("bad"), "WARN", F.lit("")))


def check_variants(df: DataFrame, column: str) -> DataFrame:
    """Values that differ from another one only in case or blanks."""
    values = df.where(_present(column)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    folded = values.groupBy(F.lower(F.regexp_replace(F.trim(column), r"\s+", " ")).alias("f")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("rows").alias("rows"))
    one = folded.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("spellings") > 1, F.col("rows"))), F.lit(0)).alias("bad"))
    return one.select(*_row(column, f"{column}.variants", "semantic", F.col("n"), F.col("bad"), "WARN", F.lit("")))


def check_correlation(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], least: float = 0.8) -> DataFrame:
    """Trips whose weakest step correlation is too small."""
    per = ST.corr_by_group(df, keys, pairs)
    one = per.agg(F.count("weakest").alias("n"), F.count_if(F.col("weakest") < least).alias("bad"))
    a, b = pairs[0]
    return one.select(*_row(a, f"{a}.follows.{b}", "cross-column", F.col("n"), F.col("bad"), "WARN", F.lit("")))


def report(*parts: DataFrame) -> DataFrame:
    """All report rows, ordered by column and check."""
    return reduce(DataFrame.unionByName, parts).orderBy("column_name", "check_id")


# --- ragged files -----------------------------------------------------------------------------------

# a field of plain and quoted parts and the comma after it; every record gets one comma at its end
_FIELD = r'((?:[^,"]++|"[^"]*+")*+),'


def split_ragged(records: DataFrame, column: str = "value") -> DataFrame:
    """Records with any number of comma-separated fields: adds ``fields`` and ``n_fields``.

    Quotes protect commas and line breaks; doubled quotes inside quotes are one quote; a quote left open ends with the record. Null
    records have null fields.
    """
    text = F.col(column)
    closed = F.when((F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1, '",').otherwise(",")
    raw = F.regexp_extract_all(F.concat(text, closed), F.lit(_FIELD), 1)
    inside = lambda f: F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(raw, lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1), inside(f)).otherwise(f))
    return records.withColumn("fields", plain).withColumn("n_fields", F.size("fields"))


def read_ragged(files: DataFrame, root: str, *, size: int = RANGE) -> DataFrame:
    """Records of the named files, ``file, ord, value, fields, n_fields``; a line break inside quotes keeps its record whole."""
    return split_ragged(read_lines(files, root, size=size))


def pad_fields(ragged: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the named columns: short records get nulls, surplus fields are cut."""
    return ragged.select(*keep, "n_fields", *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def field_counts(ragged: DataFrame, expected: int) -> DataFrame:
    """Lines per number of fields, classed as ok, short or long."""
    kind = F.when(F.col("n_fields") == expected, "ok").when(F.col("n_fields") < expected, "short").otherwise("long")
    return ragged.groupBy("n_fields").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("kind", kind)


def check_structural(ragged: DataFrame, names: Sequence[str], shift_at: str, shift_pattern: str, surplus_pattern: str = r"^\s*[01](\.0)?\s*$") -> DataFrame:
    """Records of the wrong length, records whose values moved one column to the right, and what their surplus field holds.

    A shifted record has one field too many and shows in ``shift_at`` a value of the column before it; if its last field fits
    ``surplus_pattern``, the lost value can be taken from there. Examples are the record numbers ``ord``.
    """
    n = len(names)
    cols = pad_fields(ragged, [*names, "_surplus"], keep=["ord"])
    over = F.col("n_fields") == n + 1
    return run_checks(
        cols,
        [
            Check("*", "fields.count", F.col("n_fields") == n, kind="structural", notes=f"expected {n}"),
            Check(shift_at, "fields.shifted", ~(over & F.coalesce(F.col(shift_at).rlike(shift_pattern), F.lit(False))), kind="structural", notes="one field too many before this column"),
            Check("surplus", "fields.surplus", F.col("_surplus").rlike(surplus_pattern), over, kind="structural", bad="WARN", notes="last field of records with one too many"),
        ],
        "ord",
    )
