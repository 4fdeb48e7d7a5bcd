"""Approximate nearest neighbours by inner product: one robust-pruned directed graph per shard.

Vectors of different length become points on one sphere by one more coordinate, so that the largest inner
product is the smallest distance. A shard holds a bounded number of distinct vectors; its graph is built in batches:
greedy searches from the entry points propose neighbours, pruning keeps those that no kept neighbour covers, and
each edge is offered back. Queries go to every shard in blocks and run a beam search there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.llm.common import query, stored, table

#: Distinct vectors of a shard (about), edges of a node, beam while building, slack of the pruning rule.
SHARD, DEGREE, BUILD_BEAM, SLACK = 8192, 32, 48, 1.2
#: Beam of a query, nodes expanded at once, entry points, queries in a block, queries searched together.
BEAM, WIDTH, ENTRIES, BLOCK, TOGETHER = 96, 4, 8, 4096, 256


class Graph:
    """Points (distinct vectors, one coordinate more) and their edges; ``len(points)`` stands for no edge."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        x = vectors.astype(np.float32)
        norm = (x * x).sum(1)
        top = norm.max() if len(norm) else np.float32(0)
        self.points = np.c_[x, np.sqrt(np.maximum(0, top - norm))]
        self.radius = float(top)
        n = len(x)
        self.edges = np.full((n, DEGREE), n, np.int32) if edges is None else edges
        if entries is None:
            middle = np.argsort(-(self.points @ self.points.mean(0)), kind="stable")[:1] if n else np.zeros(0, int)
            entries = np.unique(np.r_[middle, np.random.default_rng(3).permutation(n)[: ENTRIES - 1]]).astype(np.int32)
        self.entries = entries

    def search(self, q: np.ndarray, beam: int, trail: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Nearest nodes found for each query (sorted), and with ``trail`` all nodes expanded on the way."""
        n, rows = len(self.points), len(q)
        ids = np.full((rows, beam), n, np.int64)
        dist = np.full((rows, beam), np.inf, np.float32)
        start = self.entries[:beam]
        ids[:, : len(start)] = start
        dist[:, : len(start)] = -q @ self.points[start].T
        seen = np.zeros((rows, n + 1), bool)
        seen[:, start] = True
        seen[:, n] = True
        done = np.zeros((rows, beam), bool)
        done[:, len(start) :] = True
        active, path = np.arange(rows), []
        order = np.argsort(dist, 1)
        ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
        while len(active):
            first = np.argsort(done[active], 1, kind="stable")[:, :WIDTH]  # the nearest ones not yet expanded
            open_ = ~np.take_along_axis(done[active], first, 1)
            go = open_.any(1)
            active, first, open_ = active[go], first[go], open_[go]
            if not len(active):
                break
            nodes = np.where(open_, ids[active[:, None], first], n)
            done[active[:, None], first] = True
            if trail:
                step = np.full((rows, WIDTH), n, np.int64)
                step[active] = nodes
                path.append(step)
            near = np.concatenate([self.edges, np.full((1, DEGREE), n, np.int32)])[nodes].reshape(len(active), -1) if n else nodes
            near = np.sort(near, 1)
            fresh = ~seen[active[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[active[:, None], near] = True
            r, c = np.nonzero(fresh)
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = -np.einsum("ij,ij->i", self.points[near[r, c]], q[active[r]])
            all_d = np.concatenate([dist[active], d], 1)
            best = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), 1), 1)
            dist[active] = np.take_along_axis(all_d, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], 1), best, 1)
        ids[np.isinf(dist)] = n
        return ids, (np.concatenate(path, 1) if path else np.full((rows, 1), n)) if trail else None

    def _prune(self, of: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most DEGREE neighbours for each node: the nearest candidate stays and covers those much nearer to it than to the node."""
        n = len(self.points)
        candidates = np.sort(candidates, 1)
        gone = (candidates == n) | (candidates == of[:, None])
        gone[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        x = np.concatenate([self.points, np.zeros((1, self.points.shape[1]), np.float32)])
        own = np.maximum(0, 2 * (self.radius - np.einsum("bd,bcd->bc", x[of], x[candidates])))
        own[gone] = np.inf
        order = np.argsort(own, 1, kind="stable")[:, : 4 * DEGREE]
        candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
        points = x[candidates]
        between = np.maximum(0, 2 * (self.radius - points @ points.transpose(0, 2, 1)))
        alive = np.isfinite(own)
        out = np.full((len(of), DEGREE), n, np.int32)
        row = np.arange(len(of))
        for k in range(DEGREE):
            pick = alive.argmax(1)
            some = alive[row, pick]
            if not some.any():
                break
            out[some, k] = candidates[row, pick][some]
            alive[row, pick] = False
            alive &= ~(SLACK**2 * between[row, pick] <= own) | ~some[:, None]
        return out

    def build(self) -> Graph:
        n = len(self.points)
        order = np.random.default_rng(5).permutation(n)
        at, size = 0, 1
        while at < n:
            batch = np.sort(order[at : at + size])
            at, size = at + size, min(2 * size, TOGETHER, max(16, n // 20))
            ids, path = self.search(self.points[batch], BUILD_BEAM, trail=True)
            self.edges[batch] = self._prune(batch, np.concatenate([ids, path], 1))
            self._offer(batch)
        return self

    def _offer(self, batch: np.ndarray) -> None:
        """Edges back to the nodes of a batch; a node that has too many is pruned again, some offers at a time."""
        n = len(self.points)
        source, target = np.repeat(batch, DEGREE), self.edges[batch].reshape(-1)
        source, target = source[target < n], target[target < n]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            start = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            place = np.arange(len(target)) - np.repeat(start, np.diff(np.r_[start, len(target)]))
            now = place < DEGREE
            nodes = target[start]
            offers = np.full((len(nodes), DEGREE), n, np.int64)
            offers[np.searchsorted(nodes, target[now]), place[now]] = source[now]
            for i in range(0, len(nodes), TOGETHER):
                part = nodes[i : i + TOGETHER]
                both = np.sort(np.concatenate([self.edges[part], offers[i : i + TOGETHER]], 1), 1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = n
                both = np.sort(both, 1)
                full = (both < n).sum(1) > DEGREE
                self.edges[part[~full]] = both[~full, :DEGREE]
                if full.any():
                    self.edges[part[full]] = self._prune(part[full], both[full])
            source, target = source[~now], target[~now]


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v array<double>`` of the vectors that take part: of the table's most frequent length, finite and not zero."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """``h, v, ids``: distinct vectors of each task with the ``keep`` smallest ids of each; no copy goes further."""

    def run(batches):
        found: dict[bytes, list[int]] = {}

        def out():
            vectors, ids = list(found), [sorted(set(x))[:keep] for x in found.values()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["v", "ids"])

        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = found.setdefault((np.array(v) + 0.0).tobytes(), [])
                ids.append(key)
                if len(ids) > 8 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(found) > 4 * SHARD:
                yield out()
        yield out()

    return rows.mapInArrow(run, "v binary, ids array<long>").withColumn("h", F.xxhash64("v"))


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 21, shard_rows: int = SHARD) -> DataFrame:
    """One row per shard: ``shard, vectors, edges, entries, ids, ends``, written to the shared folder.

    Every vector is in the index. Equal vectors are one node with the ``keep`` smallest of their ids, which is all that a
    search for fewer neighbours can return. Shards are dealt by a hash of the vector; a common vector is one row
    per task, so no shard grows with its copies.
    """
    rows = _distinct(_valid(vectors, id_col, vector_col), keep)
    rows = stored(rows, "vectors")
    shards = max(1, -(-rows.count() // shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[bytes, list[int]] = {}
        for v, ids in zip(pdf["v"], pdf["ids"]):
            nodes.setdefault(bytes(v), []).extend(ids)
        keys = sorted(nodes)
        x = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
        graph = Graph(x).build()
        ids = [sorted(set(nodes[k]))[:keep] for k in keys]
        row = {"shard": pdf["shard"].iloc[0], "dim": x.shape[1], "vectors": x.tobytes(), "edges": graph.edges.tobytes(), "entries": graph.entries.tobytes()}
        return pd.DataFrame([row | {"ids": np.array([i for x in ids for i in x], np.int64).tobytes(), "ends": np.cumsum([0, *map(len, ids)]).astype(np.int64).tobytes()}])

    dealt = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).select("shard", "v", "ids")
    index = dealt.groupBy("shard").applyInPandas(build, "shard int, dim int, vectors binary, edges binary, entries binary, ids binary, ends binary")
    return stored(index, "graphs")


class _Shard:
    def __init__(self, row: dict):
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.graph = Graph(self.x, np.frombuffer(row["edges"], np.int32).reshape(len(self.x), DEGREE), np.frombuffer(row["entries"], np.int32))
        self.ids, self.ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)

    def nearest(self, keys: list[int], vectors: np.ndarray, k: int, beam: int) -> list[tuple[list[int], list[float]]]:
        q = np.c_[vectors, np.zeros(len(vectors))].astype(np.float32)
        nodes, _ = self.graph.search(q, beam)
        out = []
        for key, v, found in zip(keys, vectors, nodes):
            found = found[found < len(self.x)]
            score = (self.x[found] * v).sum(1)
            order = np.lexsort((self.ids[self.ends[found]], -score))
            pairs = []
            for i in order.tolist():  # a node's own ids ascend; nodes of equal score may interleave
                if len(pairs) >= k and score[i] < -pairs[k - 1][0]:
                    break
                pairs += [(-float(score[i]), int(x)) for x in self.ids[self.ends[found[i]] : self.ends[found[i] + 1]] if x != key]
                pairs.sort()
            out.append(([x for _, x in pairs[:k]], [-s for s, _ in pairs[:k]]))
        return out


def search(index: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found (all candidates, if fewer), ties to smaller ids.

    A query is never its own neighbour. Vectors that are null, zero, of another length, or hold null or non-finite
    components take no part, nor do rows without an id. Repeated rows of one id and vector count once. Every block of
    queries meets every shard: a shard's graph comes first in its sorted group and is the only thing held.
    """
    spark = queries.sparkSession
    asked = _valid(queries, id_col, vector_col).distinct()
    shards = [r["shard"] for r in index.select("shard").distinct().collect()]  # a number for some thousand vectors
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, -(-asked.count() // BLOCK))
    of_shard = F.explode(F.array(*[F.lit(s) for s in shards])).alias("shard")
    asked = asked.select(of_shard, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("role"), "id", "v")
    names = ("dim", "vectors", "edges", "entries", "ids", "ends")
    empty = {c: F.lit(None) for c in names}
    parts = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), *empty)
    kinds = dict(index.dtypes)
    rows = parts.unionByName(asked.withColumns({c: v.cast(kinds[c]) for c, v in empty.items()}))

    def run(batches):
        shard = None
        pending: list[tuple[int, list[float]]] = []

        def flush():
            keys = [p[0] for p in pending]
            found = shard.nearest(keys, np.array([p[1] for p in pending]), k, beam)
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(2)[i].as_py() == 0:
                    if pending:
                        yield flush()
                    shard = _Shard({c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in names})
                    continue
                pending.append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
                if len(pending) >= TOGETHER:
                    yield flush()
        if pending:
            yield flush()

    dealt = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "role")
    found = dealt.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")
    flat = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    flat = flat.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op5_vector_graph")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0"))
