"""Exact nearest neighbours in any number of dimensions: a tree of pivots with triangle bounds, its leaves joined to blocks that are dealt over tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.session import materialize

#: Points of a leaf on average while there are at most PIVOTS leaves; beyond that leaves grow. Points compared at once: QUERIES with CHUNK.
LEAF, PIVOTS, QUERIES, CHUNK = 1024, 4096, 256, 4096
#: Blocks of leaves, and the points of one: there are BLOCKS of them until they would hold more than BLOCK_ROWS points.
BLOCKS, BLOCK_ROWS = 24, 131_072
_SLACK = 1e-9  # bounds are widened by this share, so rounding loses no neighbour

_FOUND = "id long, other long, distance double"


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values))


def _vectors(x: np.ndarray) -> pa.ListArray:
    return _lists(x.ravel(), np.full(len(x), x.shape[1]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, summed coordinate by coordinate."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        step = a[:, i, None] - b[None, :, i]
        out += step * step
    return np.sqrt(out)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of rows that belong together, summed as in :func:`distances`."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        step = a[:, i] - b[:, i]
        out += step * step
    return np.sqrt(out)


def blocks_of(pivots: np.ndarray, count: np.ndarray, most: float) -> np.ndarray:
    """The block of each leaf: leaves are halved along their widest coordinate until at most ``most`` points, or one leaf, are left."""
    out, todo, n = np.zeros(len(pivots), np.int32), [np.arange(len(pivots))], 0
    while todo:
        some = todo.pop()
        if len(some) == 1 or count[some].sum() <= most:
            out[some], n = n, n + 1
            continue
        axis = np.ptp(pivots[some], axis=0).argmax()
        some = some[np.argsort(pivots[some, axis], kind="stable")]
        held = np.cumsum(count[some])
        cut = min(max(int(np.searchsorted(held, held[-1] / 2)), 1), len(some) - 1)
        todo += [some[cut:], some[:cut]]
    return out


class Tree:
    """Pivots and radius of the leaves, numbered block by block."""

    def __init__(self, pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, block: np.ndarray):
        self.pivots, self.count, self.radius, self.block = pivots, count, radius, block

    def low(self, x: np.ndarray, own: int, leaves: np.ndarray) -> np.ndarray:
        """The least distance that a point of each of the leaves can have from each of the points, which belong to the leaf ``own``."""
        d, mine = distances(x, self.pivots[leaves]), distances(x, self.pivots[own : own + 1])
        between = distances(self.pivots[own : own + 1], self.pivots[leaves])
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - mine * mine) / (2 * between)
        bound = np.maximum(d - self.radius[leaves], np.where(np.isfinite(plane), plane, 0.0))
        return bound - _SLACK * (1 + d + np.abs(bound))

    def asked(self, x: np.ndarray, own: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point and block for all other blocks that may hold a point within its reach."""
        far = (self.block != self.block[own]) & (self.count > 0)
        away = distances(x, self.pivots[own : own + 1])[:, 0]
        between = distances(self.pivots[own : own + 1], self.pivots)[0]
        leaves = np.flatnonzero(far & (between - self.radius <= (away + reach).max() * (1 + _SLACK) + _SLACK * (1 + between)))
        if not len(leaves):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        go = self.low(x, own, leaves) <= reach[:, None]
        first = np.flatnonzero(np.r_[True, np.diff(self.block[leaves]) != 0])
        i, j = np.nonzero(np.logical_or.reduceat(go, first, axis=1))
        return i, self.block[leaves][first][j]


class Block:
    """The points of one block, leaf by leaf."""

    def __init__(self, tree: Tree, leaf: np.ndarray, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(leaf, kind="stable")
        self.tree, self.ids, self.points = tree, ids[order], points[order]
        self.leaves, first = np.unique(leaf[order], return_index=True)
        self.first = np.r_[first, len(order)]
        self.middle = self.points.mean(0)
        self.moved = self.points - self.middle
        self.square = (self.moved * self.moved).sum(1)

    def nearest(self, own: int, ids: np.ndarray, x: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``place in ids, place in the block, distance`` of the at most ``k`` nearest points within reach of each point, itself left out;
        ties to the smaller vector. The points belong to the leaf ``own``.

        Leaves are met nearest first. Matrix products sort out what is surely too far; what is left is measured exactly.
        """
        reach = reach.copy()
        low = self.tree.low(x, own, self.leaves)
        order = np.argsort(low.min(0), kind="stable")
        moved = x - self.middle
        square = (moved * moved).sum(1)
        rough = 1e-13 * (x.shape[1] + 8)  # error of a square from the matrix product, as a share of the squared lengths
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at = 0
        while at < len(order):
            part, held = [], 0
            while at < len(order) and held < CHUNK:
                leaf = order[at]
                at += 1
                if (low[:, leaf] <= reach).any():
                    part.append(leaf)
                    held += self.first[leaf + 1] - self.first[leaf]
            if not part:
                break
            places = np.concatenate([np.arange(self.first[p], self.first[p + 1]) for p in part])
            for cut in range(0, len(places), 4 * CHUNK):
                some = places[cut : cut + 4 * CHUNK]
                error = rough * (square.max() + self.square[some].max())
                d2 = square[:, None] + self.square[some] - 2 * (moved @ self.moved[some].T)
                limit = reach * reach * (1 + _SLACK) + error
                if not np.isfinite(limit).all() and len(some) > k + 1:
                    # the point itself may be among them
                    limit = np.minimum(limit, np.partition(d2, k, axis=1)[:, k] * (1 + _SLACK) + 2 * error)
                i, j = np.nonzero(d2 <= limit[:, None])
                other = self.ids[some[j]] != ids[i]
                i, j = i[other], some[j[other]]
                i, j, d = (np.concatenate(c) for c in zip(found, (i, j, _pairs(x[i], self.points[j]))))
                near = d <= reach[i]
                i, j, d = i[near], j[near], d[near]
                by = np.lexsort((*self.points[j].T[::-1], d, i))
                i, j, d = i[by], j[by], d[by]
                start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
                rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
                last = rank == k - 1
                reach[i[last]] = d[last]
                found = i[rank < k], j[rank < k], d[rank < k]
        return found


def _runs(leaf: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of one leaf, of at most QUERIES rows."""
    cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(leaf)]):
        for at in range(int(a), int(b), QUERIES):
            yield int(leaf[a]), slice(at, min(at + QUERIES, int(b)))


def nearest_points(points: DataFrame, dims: int, k: int, *, vec: str = "x", leaf_rows: int = LEAF, blocks: int = BLOCKS) -> DataFrame:
    """Exact k nearest other points of every (distinct) point: ``vec, neighbour, distance, place``, ties to the smaller vector.

    Pivots are points with the smallest hashes (at most PIVOTS, a bounded sample that all tasks get); every point belongs to the leaf of
    its nearest pivot, and leaves next to each other make up a block. The k-th nearest of a point's own block bounds its search: another
    block is asked only if one of its leaves is ruled out neither by its radius nor by the plane between the two pivots. A point goes to a
    block once, whatever the number of leaves, so at most ``blocks`` copies of it are shuffled while blocks hold up to BLOCK_ROWS points;
    in many dimensions, where bounds rule out little, the comparisons grow with the square of the points. Fewer than k other points are all
    returned. Null vectors and those with null, NaN or infinite components or another number of them take no part.
    """
    spark = points.sparkSession
    known = points.where((F.size(vec) == dims) & F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))).select(F.col(vec).cast("array<double>").alias("x"))
    one = materialize(known.distinct().withColumn("id", F.monotonically_increasing_id()), "points")
    n = one.count()
    want = max(1, min(PIVOTS, math.ceil(n / leaf_rows)))
    picked = one.orderBy(F.xxhash64("x"), "x").limit(want).select("x").collect()
    pivots = np.array([r["x"] for r in picked], np.float64).reshape(-1, dims)
    if not n:
        return spark.createDataFrame([], f"{vec} array<double>, neighbour array<double>, distance double, place int")

    def assign(batches):
        for batch in batches:
            x = _rows(batch.column(1), dims)
            leaf, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            for at in range(0, len(x), QUERIES):
                d = distances(x[at : at + QUERIES], pivots)
                leaf[at : at + QUERIES] = d.argmin(1)
                away[at : at + QUERIES] = d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf), pa.array(away)], names=["id", "x", "leaf", "away"])

    placed = materialize(one.select("id", "x").mapInArrow(assign, "id long, x array<double>, leaf int, away double"), "leaves")
    stats = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # at most PIVOTS rows
    count, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in stats:
        count[r["leaf"]], radius[r["leaf"]] = r["n"], r["radius"]
    block = blocks_of(pivots, count, min(max(n / blocks, leaf_rows, 4 * (k + 1)), BLOCK_ROWS))
    order = np.argsort(block, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    tree = Tree(pivots[order], count[order], radius[order], block[order])
    parts = int(block.max()) + 1

    # leaves are numbered by block from here on
    def renumber(batches):
        for batch in batches:
            leaf = number[np.asarray(batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(tree.block[leaf]), pa.array(leaf), batch.column(0), batch.column(1)], names=["block", "leaf", "id", "x"])

    held = placed.mapInArrow(renumber, "block int, leaf int, id long, x array<double>")

    def own(batches):
        now, rows = None, []

        def search():
            leaf, ids, x = (np.concatenate(c) for c in zip(*rows))
            place = Block(tree, leaf, ids, x)
            for mine, part in _runs(leaf):
                i, j, d = place.nearest(mine, ids[part], x[part], np.full(len(ids[part]), np.inf), k)
                size = np.bincount(i, minlength=len(ids[part]))
                reach = np.zeros(len(size))
                np.maximum.at(reach, i, d)
                reach[size < k] = np.inf
                columns = [pa.array(leaf[part]), pa.array(ids[part]), _vectors(x[part]), pa.array(reach), _lists(place.ids[j], size), _lists(d, size)]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "id", "x", "reach", "others", "away"])

        for batch in batches:
            number_ = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.r_[True, number_[1:] != number_[:-1]]) if len(number_) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(number_)]):
                if number_[a] != now:
                    if rows:
                        yield from search()
                    now, rows = number_[a], []
                rows.append((np.asarray(batch.column(1))[a:b], np.asarray(batch.column(2))[a:b], _rows(batch.column(3), dims)[a:b]))
        if rows:
            yield from search()

    dealt = held.repartition(4 * parts, "block").sortWithinPartitions("block", "leaf")
    near = materialize(dealt.mapInArrow(own, "leaf int, id long, x array<double>, reach double, others array<long>, away array<double>"), "near-own")

    def asks(batches):
        for batch in batches:
            leaf, ids, reach = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            x = _rows(batch.column(2), dims)
            for mine, part in _runs(leaf):
                i, target = tree.asked(x[part], mine, reach[part])
                columns = [pa.array(target), pa.array(leaf[part][i]), pa.array(ids[part][i]), _vectors(x[part][i]), pa.array(reach[part][i])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "leaf", "id", "x", "reach"])

    def other(batches):
        now, rows, place = None, [], None
        for batch in batches:
            number_, leaf, ids, reach = (np.asarray(batch.column(i)) for i in (0, 1, 2, 4))
            x, asking = _rows(batch.column(3), dims), np.asarray(batch.column(5))
            cuts = np.flatnonzero(np.r_[True, (number_[1:] != number_[:-1]) | (asking[1:] != asking[:-1])]) if len(number_) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(number_)]):
                if number_[a] != now:
                    now, rows, place = number_[a], [], None
                if not asking[a]:
                    rows.append((leaf[a:b], ids[a:b], x[a:b]))
                    continue
                place = place or Block(tree, *(np.concatenate(c) for c in zip(*rows)))
                for mine, part in _runs(leaf[a:b]):
                    mine_ids = ids[a:b][part]
                    i, j, d = place.nearest(mine, mine_ids, x[a:b][part], reach[a:b][part], k)
                    yield pa.RecordBatch.from_arrays([pa.array(mine_ids[i]), pa.array(place.ids[j]), pa.array(d)], names=["id", "other", "distance"])

    asked = near.select("leaf", "id", "x", "reach").mapInArrow(asks, "block int, leaf int, id long, x array<double>, reach double").withColumn("asking", F.lit(1))
    # a block's points come first in its sorted group and are all that a task holds; the points that ask stream by
    met = held.withColumns({"reach": F.lit(0.0), "asking": F.lit(0)}).unionByName(asked)
    far = met.repartition(4 * parts, "block").sortWithinPartitions("block", "asking", "leaf").mapInArrow(other, _FOUND)
    both = near.select("id", F.explode(F.arrays_zip("others", "away")).alias("_f")).select("id", F.col("_f.others").alias("other"), F.col("_f.away").alias("distance")).unionByName(far)
    # vectors are fetched for the k nearest only, and for what ties with the last of them
    closest = both.withColumn("_r", F.rank().over(Window.partitionBy("id").orderBy("distance"))).where(F.col("_r") <= k).drop("_r")
    vectors = placed.select(F.col("id").alias("other"), F.col("x").alias("neighbour"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    ranked = closest.join(vectors, "other").withColumn("place", place).where(F.col("place") <= k)
    return ranked.join(placed.select("id", F.col("x").alias(vec)), "id").select(vec, "neighbour", "distance", "place")
