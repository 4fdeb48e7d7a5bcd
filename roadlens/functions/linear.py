"""Small symmetric systems as columns: one system a row, no matter how many rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def symmetric(upper: list[list[Column]]) -> Column:
    """The full matrix of an upper triangle, as an array of rows: ``upper[i]`` holds columns ``i`` and on."""
    k = len(upper)
    return F.array(*[F.array(*[upper[min(i, j)][abs(i - j)] for j in range(k)]) for i in range(k)])


def solve(matrix: Column, right: Column, size: int) -> Column:
    """Struct of ``x`` with ``matrix x = right`` and ``inverse``, for a positive semi-definite matrix.

    Elimination without exchange of rows, which such matrices do not need. A pivot that vanishes against the largest entry of the
    matrix belongs to a direction without information: its unknown is 0, as is its row of the inverse.
    """
    largest = F.array_max(F.transform(matrix, lambda row: F.array_max(F.transform(row, F.abs))))
    unit = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))
    rows = F.transform(matrix, lambda row, i: F.concat(row, F.array(F.get(right, i)), F.get(unit, i)))

    def eliminate(m: Column, p: Column) -> Column:
        pivot = F.get(F.get(m, p), p)
        void = F.abs(pivot) <= largest * 1e-13
        lead = F.transform(F.get(m, p), lambda v: F.when(void, 0.0).otherwise(v / F.when(void, 1.0).otherwise(pivot)))
        # the pivot row is made once, inside an array of one element that the lambda binds
        return F.get(
            F.transform(
                F.array(lead),
                lambda line: F.transform(m, lambda row, i: F.when(i == p, line).otherwise(F.zip_with(row, line, lambda v, w: v - F.get(row, p) * w))),
            ),
            F.lit(0),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), rows, eliminate)
    return F.get(
        F.transform(
            F.array(done),
            lambda m: F.struct(
                F.transform(m, lambda row: F.get(row, F.lit(size))).alias("x"),
                F.transform(m, lambda row: F.slice(row, size + 2, size)).alias("inverse"),
            ),
        ),
        F.lit(0),
    )
