"""Centroid clustering on bit planes: exact dot products by weighted AND-popcounts.

A vector of 64 integers in two's complement is held as one 64-bit word for each of its bits: word ``p`` has bit ``j`` set where bit ``p``
of component ``j`` is set. The dot product of two vectors is then the sum over all pairs of planes of a signed power of two times
the number of bits that both planes have, so squared distances are exact integers of any size.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import query, slices, stored, table

#: Components of a vector (the bits of one word), and vectors of a numpy step.
DIMENSIONS, STEP = 64, 4096
#: Bits of a digit in which partial sums travel: long sums of four million tasks stay exact.
DIGIT = 40


def integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` of each component: int64, or Python integers where those do not fit."""
    x = np.asarray(vectors, np.float64)
    if not len(x) or np.abs(x).max() < 2.0**50:
        return np.floor(x * 256).astype(np.int64)
    exact = [[int(Fraction(v) * 256 // 1) for v in row] for row in x.tolist()]
    return np.array(exact, dtype=object)


def pack(values: np.ndarray) -> np.ndarray:
    """Bit planes (rows, bits) of integer vectors (rows, 64); the last plane is the sign."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    bits = max((~low if low < 0 else low).bit_length(), (~high if high < 0 else high).bit_length()) + 1
    planes = np.empty((len(values), bits), np.uint64)
    for p in range(bits):
        bit = ((values >> p) & 1).astype(np.uint8)
        planes[:, p] = np.packbits(bit, axis=1, bitorder="little").view("<u8").ravel()
    return planes


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integer vectors of bit planes."""
    rows, bits = planes.shape
    flags = np.unpackbits(np.ascontiguousarray(planes.astype("<u8")).view(np.uint8).reshape(rows, bits, 8), axis=2, bitorder="little")
    kind = np.int64 if bits <= 62 else object
    out = np.zeros((rows, DIMENSIONS), kind)
    for p in range(bits):
        out += flags[:, p].astype(kind) * _weight(p, bits)
    return out


def _weight(p: int, bits: int) -> int:
    return -(1 << p) if p == bits - 1 else 1 << p


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products (rows of a, rows of b) from bit planes."""
    wide, other = a.shape[1], b.shape[1]
    kind = np.int64 if wide + other + 7 <= 62 else object
    out = np.zeros((len(a), len(b)), kind)
    for p in range(wide):
        for q in range(other):
            shared = np.bitwise_count(a[:, p, None] & b[None, :, q]).astype(kind)
            out += shared * (_weight(p, wide) * _weight(q, other))
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Exact squared lengths from bit planes."""
    bits = a.shape[1]
    kind = np.int64 if 2 * bits + 7 <= 62 else object
    out = np.zeros(len(a), kind)
    for p in range(bits):
        for q in range(bits):
            out += np.bitwise_count(a[:, p] & a[:, q]).astype(kind) * (_weight(p, bits) * _weight(q, bits))
    return out


def nearest(planes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (ties: the smaller number) and the squared distance of each vector."""
    cross = dots(planes, centres)
    kind = np.int64 if planes.shape[1] <= 26 and centres.shape[1] <= 26 else object
    distance = squares(planes).astype(kind)[:, None] - 2 * cross.astype(kind) + squares(centres).astype(kind)[None, :]
    best = distance.argmin(1)
    return best, distance[np.arange(len(best)), best]


def _kept(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: the vectors that take part."""
    v = vectors[vector_col]
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size(v) == DIMENSIONS) & good).select(vectors[id_col].cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def packed(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, planes``: each vector that takes part as one word for each bit of its scaled components."""

    def run(batches):
        for part in slices(batches, STEP):
            rows = np.asarray(part.column(1).flatten()).reshape(-1, DIMENSIONS)
            planes = pack(integers(rows)).view(np.int64)
            ends = np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(planes.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["vec_id", "planes"])

    return _kept(vectors, id_col, vector_col).mapInArrow(run, "vec_id long, planes array<long>")


def _blocks(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of a batch, rows with the same number of planes together."""
    lengths = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten()).view(np.uint64), np.r_[0, np.cumsum(lengths)]
    out = []
    for bits in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == bits)
        out.append((rows, flat[ends[rows][:, None] + np.arange(bits)]))
    return out


def _round(index: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The centres after one round; the driver sees a few sums for each cluster."""
    planes = pack(_array(centres))
    k = len(centres)

    def run(batches):
        sums, counts = np.zeros((k, DIMENSIONS), object), np.zeros(k, np.int64)
        for part in slices(batches, STEP):
            for _, block in _blocks(part.column(0)):
                label, _ = nearest(block, planes)
                values = unpack(block)
                some = np.zeros((k, DIMENSIONS), values.dtype if block.shape[1] <= 40 else object)
                np.add.at(some, label, values)
                sums += some.astype(object)
                counts += np.bincount(label, minlength=k)
        rows = []
        for c in np.flatnonzero(counts).tolist():
            rest, digit = sums[c], 0
            while digit == 0 or any(rest):
                # two's complement digits: the last one of a component may be -1
                low = [int(v) & ((1 << DIGIT) - 1) if not -(1 << DIGIT) < v < (1 << DIGIT) else int(v) for v in rest]
                rows.append((c, int(counts[c]) if digit == 0 else 0, digit, low))
                rest = np.array([(int(v) - w) >> DIGIT for v, w in zip(rest, low)], object)
                digit += 1
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds)], names=["cluster", "n", "digit", "sums"])

    parts = index.select("planes").mapInArrow(run, "cluster int, n long, digit int, sums array<long>")
    total = F.array(*[F.sum(F.col("sums")[j]) for j in range(DIMENSIONS)]).alias("sums")
    rows = parts.groupBy("cluster", "digit").agg(F.sum("n").alias("n"), total).collect()  # k clusters, few digits
    out = [list(c) for c in centres]
    for c in {r["cluster"] for r in rows}:
        mine = [r for r in rows if r["cluster"] == c]
        n = sum(r["n"] for r in mine)
        out[c] = [sum(r["sums"][j] << (DIGIT * r["digit"]) for r in mine) // n for j in range(DIMENSIONS)]
    return out


def _array(centres: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < 1 << 60 for c in centres for v in c)
    return np.array(centres, np.int64 if small else object)


def cluster(vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that takes part, and the centres.

    Vectors of exactly 64 finite components take part; others (null, other lengths, null, NaN or infinite components) are left out.
    Repeated rows count each time. The first centres are the vectors whose ``seed`` and id hash lowest; rows without an id come
    last there, equal ids are ordered by their vectors. With fewer vectors than ``clusters`` each starts a cluster, and an
    empty table gives an empty result. Only the id and the vector are read. Numbers are exact whatever the size of the components; a
    distance or sum that does not fit a long is null.

    One narrow pass over stored planes a round: tasks send one row of sums for each cluster, so no key gathers
    vectors, and the driver holds ``clusters`` centres. A lost executor repeats tasks of one pass.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(order.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], schema), []
    index = stored(packed(vectors, id_col=id_col, vector_col=vector_col), "planes")
    centres = [[int(v) for v in row] for row in integers(np.array([r["v"] for r in starts]))]
    for _ in range(rounds):
        centres = _round(index, centres)
    planes = pack(_array(centres))

    def run(batches):
        for part in slices(batches, STEP):
            label, distance = np.empty(part.num_rows, np.int32), np.empty(part.num_rows, object)
            for rows, block in _blocks(part.column(1)):
                label[rows], distance[rows] = nearest(block, planes)
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    dealt = stored(index.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    # null where one distance does not fit
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")
    inertia = {r["cluster"]: None if r["total"] is None else int(r["total"]) for r in dealt.groupBy("cluster").agg(total).collect()}
    everything = None if None in inertia.values() else sum(inertia.values())
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    rows = [(c, _long(i), _long(everything), hashed[c]) for c, i in inertia.items()]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return dealt.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centres


def _long(n: int | None) -> int | None:
    return n if n is not None and n < 1 << 63 else None


def _twin(clusters: int = 40, rounds: int = 5) -> str:
    steps = [
        """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS MATERIALIZED (
  SELECT r, unnest(range(64)) AS d, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x FROM v),""",
        f"""s AS MATERIALIZED (
  SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, embedding) - 1 AS k FROM v QUALIFY k < {clusters}),
c0 AS MATERIALIZED (SELECT k, d, x AS y FROM s JOIN p USING (r)),""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, k, e FROM (SELECT r, k, sum((x - y) * (x - y)) AS e FROM p JOIN c{i} USING (d) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY e, k) = 1),"""
        )
        if i < rounds:
            steps.append(
                f"""n{i} AS MATERIALIZED (SELECT k, d, sum(x) AS t, count(*) AS n FROM a{i} JOIN p USING (r) GROUP BY k, d),
c{i + 1} AS MATERIALIZED (
  SELECT k, d, coalesce((t - ((t % n) + n) % n) // n, y) AS y FROM c{i} LEFT JOIN n{i} USING (k, d)),"""
            )
    steps.append(
        f"""h AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(e AS BIGINT) AS distance,
  CAST(sum(e) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(e) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (k)"""
    )
    return "\n".join(steps)


@query("op11_bitplane_kmeans", sql=_twin())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))[0]
