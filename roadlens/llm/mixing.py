"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.llm.common import query, stored, table

#: Margins and the power that tempers their present shares to targets: 1 keeps a share, 0 makes all values equal.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: The fit ends when every margin is within TOLERANCE of its target, or when the weights stand still: when in a job no
#: weight grows by a share of STILL and none shrinks by that share of its margins.
TOLERANCE, STILL = 1e-10, 1e-8
#: Sweeps in one job, and cells in one task.
SWEEPS, CELLS = 5, 100_000

#: Share of all tokens that the mix draws.
BUDGET = 0.5

MISSING = "(none)"


def token_count(text: Column) -> Column:
    """Words of a text: its spaces and line breaks, and one more; 0 for a null or empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))) + 1)


def form_topic(text: Column) -> Column:
    """Topic by the form of a text: legal lines, contact data, tables, notes, long texts, or articles."""
    has = lambda *words: [text.contains(w) for w in words]
    legal, contact = has("License", "rights reserved", "Copyright"), has("@", "password", "token =")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(legal[0] | legal[1] | legal[2], "legal")
        .when(contact[0] | contact[1] | contact[2], "contact")
        .when(text.contains(" | "), "table")
        .when(F.length(text) < 500, "note")
        .when(F.length(text) > 8000, "long")
        .otherwise("article")
    )


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) for a document: from its id, or from its text where the id is null."""
    key = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def _shares(cells: DataFrame, temper: dict[str, float]) -> DataFrame | None:
    """Cells with their token share as ``weight`` and the targets of their margins as ``_source`` and so on; None without tokens."""
    have = cells.withColumns({f"_{d}": F.sum("tokens").over(Window.partitionBy(d)) for d in temper})
    total = have.agg(F.sum("tokens").cast("double").alias("all"), *[F.sum(F.pow(F.col(f"_{d}"), a) * F.col("tokens") / F.col(f"_{d}")).alias(d) for d, a in temper.items()]).first()
    if total["all"] is None:
        return None
    return have.select(*temper, "tokens", (F.col("tokens") / total["all"]).alias("weight"), *[(F.pow(F.col(f"_{d}"), a) / total[d]).alias(f"_{d}") for d, a in temper.items()])


def _fit(w: DataFrame, temper: dict[str, float], tolerance: float, parts: int) -> DataFrame:
    """``w`` with weights raked to the targets ``_source`` and so on, and what is left of each margin's gap as ``gap_source`` and so on."""
    margin = {d: Window.partitionBy(d) for d in temper}
    gaps = {f"gap_{d}": F.abs(F.sum("weight").over(margin[d]) / F.col(f"_{d}") - 1) for d in temper}
    target = F.least(*[F.col(f"_{d}") for d in temper], F.lit(float("inf")))
    moved = F.when(F.col("weight") > F.col("_before"), 1 - F.col("_before") / F.col("weight")).otherwise((F.col("_before") - F.col("weight")) / target)
    while True:
        w = w.withColumn("_before", F.col("weight"))
        for _ in range(SWEEPS):
            for d in temper:
                w = w.withColumn("weight", F.col("weight") * F.col(f"_{d}") / F.sum("weight").over(margin[d]))
        w = stored(w.withColumns({**gaps, "_moved": moved}), "raked").coalesce(parts)
        gap, most = w.agg(F.max(F.greatest(*gaps, F.lit(0.0))), F.max("_moved")).first()
        w = w.drop("_before", "_moved")
        if gap <= tolerance or most <= STILL:
            return w
        w = w.drop(*gaps)


def rake(cells: DataFrame, temper: dict[str, float] = TEMPER, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (one column per margin, ``tokens``) with raked ``weight``, sums of which meet every margin's target, ``p``, and the
    gaps that are left, ``gap_source`` and so on for each margin.

    A target is the margin's present token share to a power, scaled to sum 1. Each sweep scales the weights to one margin
    after the other. ``p`` is weight over token share, divided by its maximum over all cells: documents drawn with it
    meet the targets in expectation, and the cell most in demand is taken whole. Cells without tokens are left out. Where empty
    cells make the targets contradict each other, the last margin is met and the others as nearly as the sweeps bring them.
    Slow fits go on until they are met: targets that are only met with a cell at zero are approached as one over the sweeps.
    """
    w, parts = _raked(cells, temper, tolerance)
    gaps = [f"gap_{d}" for d in temper]
    if w is None:
        return cells.where("tokens > 0").select(*temper, "tokens", *[F.lit(0.0).alias(c) for c in ("weight", "p", *gaps)])
    ratio = F.col("weight") / F.col("tokens")
    top = w.agg(F.max(ratio)).first()[0]
    return w.select(*temper, "tokens", "weight", (ratio / top).alias("p"), *gaps)


def _raked(cells: DataFrame, temper: dict[str, float], tolerance: float) -> tuple[DataFrame | None, int]:
    cells = cells.where("tokens > 0")
    parts = max(1, -(-cells.count() // CELLS))
    w = _shares(cells.coalesce(parts), temper)  # a few hundred cells need no exchange between the sweeps
    return (w if w is None else _fit(w, temper, tolerance, parts)), parts


def budgeted(cells: DataFrame, temper: dict[str, float] = TEMPER, share: float = BUDGET, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with ``p`` that draw ``share`` of all tokens in expectation, however small the scarcest cell is.

    The raked weights are scaled to the budget. Cells of which more is wanted than there is are taken whole (``p`` 1), and the others
    are raked anew to what the margins then still lack, until no cell is short. A margin of which all cells are taken whole stays
    below its target, and the others share what it lacks, so the size is kept. Cells without tokens are left out.
    """
    w, parts = _raked(cells, temper, tolerance)
    if w is None:
        return cells.where("tokens > 0").select(*temper, "tokens", F.lit(0.0).alias("p"))
    everything = w.agg(F.sum("tokens")).first()[0]
    whole, rest = [], 1.0  # tables of the cells taken whole, and the share of the drawn tokens that the others have
    while True:
        # a cell at the very limit is whole too: rounding must not leave it to a rake of nothing
        short = F.col("weight") * rest * share * everything > F.col("tokens") * (1 - 1e-12)
        w = stored(w.withColumn("_short", short), "budget").coalesce(parts)
        taken, free, missing = w.agg(F.sum(F.when(F.col("_short"), F.col("tokens"))), F.count_if(~F.col("_short")), F.count_if("_short")).first()
        if not missing or not free:
            break
        whole.append(w.where("_short").select(*temper, "tokens", F.lit(1.0).alias("p")))
        # what each margin has in free cells and what its whole cells lack; without free cells it drops out and the sum is shared anew
        lack = F.when(F.col("_short"), F.greatest(F.lit(0.0), F.col("weight") * rest - F.col("tokens") / (share * everything))).otherwise(F.col("weight") * rest)
        w = w.withColumns({f"_{d}": F.sum(lack).over(Window.partitionBy(d)) for d in temper})
        w, rest = w.where("NOT _short"), rest - taken / (share * everything)
        sums = {d: w.select(d, f"_{d}").distinct().agg(F.sum(f"_{d}")).first()[0] for d in temper}
        start = w.agg(F.sum("weight")).first()[0]
        w = w.select(*temper, "tokens", (F.col("weight") / start).alias("weight"), *[(F.col(f"_{d}") / sums[d]).alias(f"_{d}") for d in temper])
        w = _fit(w, temper, tolerance, parts)
    out = w.select(*temper, "tokens", F.least(F.lit(1.0), F.col("weight") * rest * share * everything / F.col("tokens")).alias("p"))
    for cells in whole:
        out = out.unionByName(cells)
    return out


def mix(docs: DataFrame, *, temper: dict[str, float] = TEMPER, topic: Column | None = None, share: float | None = BUDGET, into: str = "mix") -> DataFrame:
    """``docs`` with a struct ``into``: ``n_tokens, topic, p, keep`` (whether the document is drawn).

    ``share`` of all tokens is drawn in expectation (``budgeted``); with None the scarcest cell sets the size (``rake``).
    A null source, language or topic is a value of its own. Documents without text have p 0 and are not drawn. Rows
    with the same id get the same draw; null ids are drawn by their text. All rows and columns stay; an empty table gives an
    empty result. Only sums per cell are shuffled, pre-aggregated; the cells are few, and Spark picks their join by size.
    """
    topic = form_topic(F.col("text")) if topic is None else topic
    keys = {f"_k_{d}": F.coalesce((topic if d == "topic" else F.col(d)).cast("string"), F.lit(MISSING)) for d in temper}
    marked = docs.withColumns({**keys, "_tokens": token_count(F.col("text")).cast("long")})
    sums = marked.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"))
    cells = stored(sums.withColumnsRenamed({k: k[3:] for k in keys}), "cells")
    cells = rake(cells, temper) if share is None else budgeted(cells, temper, share)
    cells = stored(cells.select(*[F.col(d).alias(f"_c_{d}") for d in temper], F.col("p").alias("_p")), "probabilities")
    same = [F.col(f"_k_{d}") == F.col(f"_c_{d}") for d in temper]
    p = F.coalesce(F.when(F.col("_tokens") > 0, F.col("_p")), F.lit(0.0))
    result = F.struct(F.col("_tokens").alias("n_tokens"), (F.col("_k_topic") if "topic" in temper else F.lit(None).cast("string")).alias("topic"), p.alias("p"), (draw(F.col("doc_id"), F.col("text")) < p).alias("keep"))
    return marked.join(cells, same, "left").select(*[docs[c] for c in docs.columns], result.alias(into))


def _sql(temper: dict[str, float] = TEMPER, sweeps: int = 60) -> str:
    """The same in plain SQL: the sweeps written out, more than the fit needs."""
    parts = [
        """docs AS (SELECT doc_id, text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
          CASE WHEN coalesce(text, '') = '' THEN 'empty'
               WHEN contains(text, 'License') OR contains(text, 'rights reserved') OR contains(text, 'Copyright') THEN 'legal'
               WHEN contains(text, '@') OR contains(text, 'password') OR contains(text, 'token =') THEN 'contact'
               WHEN contains(text, ' | ') THEN 'table' WHEN length(text) < 500 THEN 'note' WHEN length(text) > 8000 THEN 'long' ELSE 'article' END AS topic,
          CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 END AS n_tokens
        FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d, a in temper.items():
        parts.append(f"m_{d} AS (SELECT {d}, pow(sum(tokens), {a}) / sum(pow(sum(tokens), {a})) OVER () AS t FROM cells GROUP BY {d})")
    parts.append(f"w0 AS MATERIALIZED (SELECT c.*, tokens / sum(tokens) OVER () AS weight, {', '.join(f'm_{d}.t AS t_{d}' for d in temper)} FROM cells c {' '.join(f'JOIN m_{d} USING ({d})' for d in temper)})")
    at = 0
    for _ in range(sweeps):
        for d in temper:
            at += 1
            parts.append(f"w{at} AS MATERIALIZED (SELECT * REPLACE (weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM w{at - 1})")
    parts.append(f"probs AS (SELECT source, lang, topic, (weight / tokens) / max(weight / tokens) OVER () AS p FROM w{at})")
    return (
        "WITH "
        + ",\n".join(parts)
        + """, drawn AS (SELECT doc_id, n_tokens, topic, CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END AS p,
          ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 12))::UBIGINT / 281474976710656.0 AS u
        FROM docs LEFT JOIN probs USING (source, lang, topic))
        SELECT doc_id, n_tokens::BIGINT AS n_tokens, topic, round(p, 6) AS p, u < p AS keep FROM drawn"""
    )


@query("op10_mixing", _sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mix(table(spark, sf_dir, "documents"), share=None)  # the SQL twin divides by the largest ratio
    return docs.select("doc_id", "mix.n_tokens", "mix.topic", F.round("mix.p", 6).alias("p"), "mix.keep")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn."""
    return mix(docs, into="_mix").where("_mix.keep").drop("_mix")
