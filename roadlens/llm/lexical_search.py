"""Ranked lexical search on compressed quadtrees over the grid of terms and documents.

Documents are dealt into shards. In a shard's grid the rows are terms (frequent ones first) and the columns documents (by id);
a cell holds the impact of a term in a document. The grid is cut into quadrants again and again; each cell of this tree keeps the
largest impact below it, a cell with one entry ends its branch, and empty cells are not stored. The children of all cells lie in one
breadth-first order, so that a byte of flags a cell is enough to find them.

A search follows the row of each of an item's terms at once: an entry of the queue is a range of documents with one cell a
term, its bound is the weighted sum of the cells' impacts, and the best entries are split into their halves first. A range of one document has
its exact score as bound. Ranges below the item's last place so far are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.llm.common import LARGE_ROWS, query, slices, stored, table

#: A shard is closed at this many documents or bytes of text; a longer text has a shard of its own.
SHARD_DOCS, SHARD_BYTES = 2048, 8 << 20
#: Pairs of item and term in a block of items; entries split at once for an item; terms of items searched together.
BLOCK_TERMS, WIDTH, TOGETHER = 100_000, 48, 2048
#: Salted groups in which tasks' places are merged first.
SALTS = 64

# bytes of terms stay, with capital letters made small; all others end a term
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "ids binary, terms binary, found binary, flags binary, tops binary, values binary, rows binary, cols binary, height int"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text with repeats: runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``(10^9 tf) div (1000 tf + 8 m)``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def damping(n: int, documents: int, total: int) -> int:
    """A document's ``m`` from its length, in integers of any size."""
    return 10 + (90 * n * documents) // total


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_tree(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> dict:
    """Breadth-first arrays of the quadtree over distinct points ``rows, cols`` with ``values``.

    ``flags``: for each cell with several points its children (low four bits) and which of them hold one point (high four bits);
    ``tops``: its largest value; ``values, rows, cols``: each single point's value and what is left of its place below its cell.
    """
    height = max(int(rows.max(initial=0)).bit_length(), int(cols.max(initial=0)).bit_length(), 1)
    values = values.astype(np.uint32)
    z = (_spread(rows) << np.uint64(1)) | _spread(cols)
    order = np.argsort(z, kind="stable")
    z, v, r, c = z[order], values[order], rows[order], cols[order]
    tops, flags, single_v, single_r, single_c = [np.array([v.max(initial=0)], np.uint32)], [], [], [], []
    owner = np.zeros(len(z), np.int32)  # number of the point's cell among the cells of the level above
    cells = 1
    for shift in range(height - 1, -1, -1):
        key = z >> np.uint64(2 * shift)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        count = np.diff(np.r_[start, len(key)])
        one = count == 1
        slot = (key[start] & np.uint64(3)).astype(np.uint8)
        here = np.zeros(cells, np.uint8)
        np.bitwise_or.at(here, owner[start], (np.uint8(1) << slot) | (one.astype(np.uint8) << (slot + 4)))
        flags.append(here)
        low = (1 << shift) - 1
        at = start[one]
        single_v.append(v[at])
        single_r.append(r[at] & low)
        single_c.append(c[at] & low)
        cells = int((~one).sum())
        if not cells:
            break
        tops.append(np.maximum.reduceat(v, start)[~one])
        inner = np.repeat(~one, count)
        owner = np.repeat(np.arange(cells, dtype=np.int32), count[~one])
        z, v, r, c = z[inner], v[inner], r[inner], c[inner]
    small = np.uint16 if height <= 16 else np.uint32
    return {
        "flags": np.concatenate(flags).tobytes(),
        "tops": np.concatenate(tops).tobytes(),
        "values": np.concatenate(single_v).tobytes(),
        "rows": np.concatenate(single_r).astype(small).tobytes(),
        "cols": np.concatenate(single_c).astype(small).tobytes(),
        "height": height,
    }


class Shard:
    """Documents being gathered for one grid: numbers of their terms, and how often each occurs."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.bytes = 0

    def add(self, key: int | None, text: str) -> None:
        words = terms_of(text)
        self.bytes += len(text)
        if words:
            self.ids.append(key)
            count, number = Counter(words), self.number
            self.terms.append(np.array([number.setdefault(w, len(number)) for w in count], np.int32))
            self.counts.append(np.fromiter(count.values(), np.int32, len(count)))
            self.lengths.append(len(words))

    def row(self, documents: int, total: int) -> dict:
        """The shard as a row of the index; rows without an id count for its terms but have no column."""
        number = self.number
        sizes = np.array([len(c) for c in self.counts], np.int64)
        term = np.concatenate(self.terms)
        tf = np.concatenate(self.counts).astype(np.int64)
        found = np.bincount(term, minlength=len(number))
        order = np.argsort(-found, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        words = list(number)
        named = [i for i, key in enumerate(self.ids) if key is not None]
        named.sort(key=self.ids.__getitem__)
        column = np.full(len(self.ids), -1, np.int32)
        column[named] = np.arange(len(named))
        m = np.array([damping(n, documents, total) for n in self.lengths], np.int64)
        cols = np.repeat(column, sizes)
        value = impacts(tf, np.repeat(m, sizes)).astype(np.uint32)  # below 10^6
        keep = cols >= 0
        return {
            "ids": np.array([self.ids[i] for i in named], np.int64).tobytes(),
            "terms": b"\n".join(words[i] for i in order),
            "found": found[order].astype(np.uint32).tobytes(),
            **build_tree(place[term[keep]], cols[keep], value[keep]),
        }


class Grid:
    """A shard of the index, ready for searches."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.height = row["height"]
        self.place = {w: i for i, w in enumerate(row["terms"].split(b"\n"))}
        flags = np.frombuffer(row["flags"], np.uint8)
        small = np.uint16 if self.height <= 16 else np.uint32
        bits = np.unpackbits(flags[:, None], axis=1, bitorder="little")
        there, one = bits[:, :4].ravel().astype(bool), bits[:, 4:].ravel().astype(bool)
        inner = there & ~one
        cells = len(flags)
        # pointers: 0 .. cells - 1 cells, then single points, then nothing
        single = np.frombuffer(row["values"], np.uint32)
        self.cells, self.none = cells, cells + len(single)
        child = np.full(4 * cells, self.none, np.int32)
        child[inner] = np.arange(1, cells)
        child[one] = np.arange(cells, self.none)
        self.child = child
        self.value = np.r_[np.frombuffer(row["tops"], np.uint32), single, np.uint32(0)].view(np.int32)
        self.row = np.r_[np.frombuffer(row["rows"], small), small(0)]
        self.col = np.r_[np.frombuffer(row["cols"], small), small(0)]

    def search(self, items: list[tuple[list[bytes], list[int]]], best: "Best") -> None:
        """Best-first search of several items at once; what is found goes into ``best``."""
        if not len(self.ids):
            return
        rows_here = 1 << self.height  # terms beyond have no column at all
        known = [[(self.place[w], x) for w, x in zip(*item) if self.place.get(w, rows_here) < rows_here] for item in items]
        width = max(map(len, known), default=0)
        if not width:
            return
        rows, weights = np.zeros((len(items), width), np.int64), np.zeros((len(items), width), np.int64)
        node = np.full((len(items), width), self.none, np.int32)
        for i, terms in enumerate(known):
            rows[i, : len(terms)] = [t for t, _ in terms]
            weights[i, : len(terms)] = [x for _, x in terms]
            node[i, : len(terms)] = 0
        item = np.arange(len(items))
        low, shift = np.zeros(len(items), np.int64), np.full(len(items), self.height, np.int64)
        bound = (weights * self.value[node]).sum(1)
        while True:
            keep = bound >= best.last[item]
            item, low, shift, node, bound = item[keep], low[keep], shift[keep], node[keep], bound[keep]
            if not len(item):
                return
            order = np.lexsort((low, -bound, item))
            first = np.r_[True, item[order][1:] != item[order][:-1]]
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            go = np.zeros(len(item), bool)
            go[order[rank < WIDTH]] = True
            new = self._halves(item[go], low[go], shift[go], node[go], rows, weights)
            stay = ~go
            done = new[2] == 0
            best.add(new[0][done], new[4][done], self.ids[np.minimum(new[1][done], len(self.ids) - 1)])
            item, low, shift, bound = (np.concatenate([a[stay], b[~done]]) for a, b in ((item, new[0]), (low, new[1]), (shift, new[2]), (bound, new[4])))
            node = np.concatenate([node[stay], new[3][~done]])

    def _halves(self, item, low, shift, node, rows, weights):
        """Both halves of each range that any of its item's terms reaches."""
        below = (shift - 1)[:, None]
        wanted = rows[item]
        row_bit = (wanted >> below) & 1
        mask = (np.int64(1) << below) - 1
        is_cell, is_single = node < self.cells, (node >= self.cells) & (node < self.none)
        point = np.where(is_single, node - self.cells, len(self.col) - 1)
        side = (self.col[point] >> below) & 1
        # a single point met further up keeps the column bits of the cell where it was met
        out = []
        for half in (0, 1):
            step = self.child[np.where(is_cell, node.astype(np.int64) * 4 + row_bit * 2 + half, 0)]
            met = is_cell & (step >= self.cells) & (step < self.none)
            at = np.where(met, step - self.cells, len(self.row) - 1)
            step = np.where(met & (self.row[at] != (wanted & mask)), self.none, step)
            next_ = np.where(is_cell, step, np.where(is_single & (side == half), node, self.none)).astype(np.int32)
            bound = (weights[item] * self.value[next_]).sum(1)
            some = bound > 0
            out.append((item[some], (low + half * (1 << (shift - 1)))[some], (shift - 1)[some], next_[some], bound[some]))
        return tuple(np.concatenate(parts) for parts in zip(*out))


class Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(item):
            return
        item, score, key = np.r_[self.item, item], np.r_[self.score, score], np.r_[self.key, key]
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        first = np.r_[True, item[1:] != item[:-1]]
        rank = np.arange(len(item)) - np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
        keep = rank < self.k
        self.item, self.score, self.key = item[keep], score[keep], key[keep]
        full = rank == self.k - 1
        self.last[item[full]] = np.maximum(1, score[full])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, int, int]:
    """Stored shards over all documents, the number of documents with a term, and the number of all their terms.

    Two narrow passes: lengths first, since impacts need both totals, then one grid for each some thousand documents of a
    partition. Texts of any length are read whole. Null and empty texts have no terms. Documents without an id count in the totals
    and for their terms, and are not found. Only the two columns are read. A row group of the written table holds a shard or a few,
    so writing and reading take the memory of some shards, however many a task has.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def lengths(batches):
        some = total = 0
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                n = len(terms_of(text))
                some, total = some + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"some": [some], "total": [total]})

    totals = rows.select("text").mapInArrow(lengths, "some long, total long").agg(F.sum("some"), F.sum("total")).first()
    documents, total = totals[0] or 0, totals[1] or 0

    def grids(batches):
        shard = Shard()
        for part in slices(batches):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                shard.add(key, text or "")
                if len(shard.ids) >= shard_docs or shard.bytes >= SHARD_BYTES:
                    yield as_batch(shard.row(documents, total))
                    shard = Shard()
        if shard.ids:
            yield as_batch(shard.row(documents, total))

    def as_batch(row):
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k == "height" else pa.binary()) for k, v in row.items()})

    return stored(rows.mapInArrow(grids, INDEX), "lexical-index", **LARGE_ROWS), documents, total


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``item_id, term`` (UTF-8 bytes)."""

    def run(batches):
        for part in slices(batches):
            keys, terms = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                mine = set(terms_of(text))
                keys += [key] * len(mine)
                terms += mine
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    rows = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].alias("text")).where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def _found(index: DataFrame, terms: Iterable[bytes]) -> dict[bytes, int]:
    """In how many documents each of a block's terms is."""
    wanted = sorted(terms)

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for part in slices(batches, 1):
            place = {w: i for i, w in enumerate(part.column(0)[0].as_py().split(b"\n"))}
            found = np.frombuffer(part.column(1)[0].as_py(), np.uint32)
            total += np.array([found[place[w]] if w in place else 0 for w in wanted], np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = index.select("terms", "found").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {wanted[r["term"]]: r["df"] for r in rows.collect()}  # at most a block's terms


def search(index: DataFrame, documents: int, items: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents of the highest score above 0, ties to smaller ids.

    Items are taken in blocks of a bounded number of terms, each against all shards. A task keeps ``k`` places an item over all its
    shards, and these are merged in salted groups first, so no task meets more than a share of the places. An item's terms count
    once; rows of one item are taken together, items without an id, text or known term have no result. Rows that repeat a document
    are ranked each. Empty tables give an empty result.
    """
    spark = items.sparkSession
    pairs = stored(_item_terms(items, id_col, text_col), "lexical-items")
    blocks = -(-pairs.count() // BLOCK_TERMS)
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        mine: dict[int, list[bytes]] = {}
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():  # about BLOCK_TERMS pairs
            mine.setdefault(r["item_id"], []).append(bytes(r["term"]))
        df = _found(index, {w for terms in mine.values() for w in terms})
        asked = []
        for key, terms in sorted(mine.items()):
            weights = {w: weight(documents, df[w]) for w in terms if w in df}
            weights = {w: x for w, x in weights.items() if x > 0}  # a weight of 0 adds nothing
            if weights:
                asked.append((key, list(weights), list(weights.values())))
        if asked:
            found = _ranked(index.mapInArrow(_searcher(asked, k), "item_id long, doc_id long, score long"), k)
            result = found if b == 0 else result.unionByName(found)
    return result


def _searcher(asked: list[tuple[int, list[bytes], list[int]]], k: int):
    groups, size = [[]], 0
    for item in sorted(asked, key=lambda x: len(x[1])):  # items of like length together
        if groups[-1] and (len(groups[-1]) + 1) * len(item[1]) > TOGETHER:
            groups.append([])
        groups[-1].append(item)

    def run(batches):
        best = [Best(len(g), k) for g in groups]
        for part in slices(batches, 1):
            grid = Grid({name: part.column(i)[0].as_py() for i, name in enumerate(part.schema.names)})
            for group, places in zip(groups, best):
                grid.search([item[1:] for item in group], places)
        for group, places in zip(groups, best):
            keys = np.array([item[0] for item in group], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[places.item]), pa.array(places.key), pa.array(places.score)], names=["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), "doc_id"]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.drop("salt").withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL_TWIN = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT count(*) AS N, sum(len(words)) AS L FROM d WHERE len(words) > 0),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
f AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p CROSS JOIN s WHERE term IN (SELECT term FROM q) GROUP BY term, N),
m AS (SELECT r, doc_id, 10 + (90 * len(words) * N) // L AS m FROM d CROSS JOIN s WHERE len(words) > 0),
e AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM e WHERE score > 0 QUALIFY rank <= 10
"""


@query("op13_lexical_search", sql=SQL_TWIN)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, documents, _ = build_index(table(spark, sf_dir, "documents"))
    return search(index, documents, table(spark, sf_dir, "benchmark"))
