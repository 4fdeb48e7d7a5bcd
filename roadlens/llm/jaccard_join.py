"""Exact Jaccard join of word n-gram sets by partitions of the shingle universe.

Two sets with a Jaccard similarity of at least t differ in few elements: D <= (a + b)(1 - t) / (1 + t). If the universe
is cut into segments, a pair that differs in D elements agrees in all but D of them. Sets are put into bands
by size; each band has its own segments, and a plan of how many are indexed by their exact content (budget 1) or also by
all contents with one element less (budget 2). A set emits segments up to a budget of D + 1, and some more, so that its
most frequent ones may be left out. Sets that share a signature are candidates; a parity sketch, whose Hamming distance
never exceeds D, rejects most of the rest, and the whole sets decide.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.llm.common import ids_of, map_slices, query, slices, stored, table, texts_of
from roadlens.llm.components import components

#: Words of a shingle and the least similarity in percent.
WORDS, PERCENT = 4, 85
#: The same for the pipeline's stage; the values above are those of the query.
STAGE_WORDS, STAGE_PERCENT = 5, 80
#: Cost model: a candidate costs as much as so many signatures; chance that an element of a set is common property.
CANDIDATE, COMMON = 8, 0.75
#: Growth of band limits; words and set keys a task remembers; partners of one centre in a verification block.
GROWTH, KEPT, BLOCK = 1.5, 1 << 18, 128

_U = np.uint64

#: Sketches compared as one block.
_TOGETHER = 128


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        cut = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space cuts
        if not cut:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for w in set(cut).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, cut), np.uint64, len(cut))
        if len(h) < self.words:
            return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64))
        n = len(h) - self.words + 1
        total = np.full(n, self.words, np.uint64)
        for k in range(self.words):
            total = mix(total + h[k : k + n])
        return np.unique(total)


@lru_cache(None)
def limits() -> tuple[int, ...]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return tuple(out)


def band_of(n: int) -> int:
    return bisect_right(limits(), n) - 1


def differing(a: int, b: int, percent: int) -> int:
    """Most elements in which similar sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def spare(n: int) -> int:
    """Segments beyond the budget, of which the most frequent may be left out."""
    return 2 + n // 64


@lru_cache(None)
def plan(band: int, percent: int) -> tuple[int, int, int]:
    """Segments of a band: (all, with deletions, spare). As many deletions as fit, or none and some spare: what costs less."""
    top = limits()[band + 1] - 1
    need = differing(top, top, percent) + 1
    size = 0.5 * (limits()[band] + top)

    def cost(deletions: int) -> float:
        exact = need - 2 * deletions + (0 if deletions else spare(top))
        s = size / (exact + deletions)
        return exact * (1 + CANDIDATE * COMMON**s) + deletions * (1 + s + CANDIDATE * COMMON ** max(0.0, s - 1))

    deletions = min((0, need // 2), key=cost)
    extra = 0 if deletions else spare(top)
    return need - deletions + extra, deletions, extra


@lru_cache(None)
def first_exact(percent: int) -> int:
    """The smallest size from which on no band uses deletions."""
    return limits()[1 + max([b for b in range(40) if plan(b, percent)[1]], default=-1)]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set in its own band's plan and, for larger partners, in the next one's. The lowest bit tells the plan."""
    n = len(s)
    own, most = band_of(n), n * 100 // percent
    sums = np.r_[_U(0), np.cumsum(mix(s ^ _U(0x9E3779B97F4A7C15)))]
    out = []
    for band in range(own, band_of(most) + 1):
        allowed = differing(n, min(most, limits()[band + 1] - 1), percent)
        if not allowed:
            continue  # similar means equal
        m, deletions, extra = plan(band, percent)
        if deletions:
            count = min(m, -(-(allowed + 1) // 2)) if allowed + 1 <= 2 * deletions else allowed + 1 - deletions
        else:
            count = min(m, allowed + 1 + spare(n))
        segment = ((s >> _U(32)) * _U(m)) >> _U(32)  # ascending, as the set is
        ends = np.searchsorted(segment, np.arange(count + 1, dtype=np.uint64))
        tag = mix((np.arange(count, dtype=np.uint64) + _U(1)) * _U(0xD1342543DE82EF95) + _U(band))
        content = sums[ends[1:]] - sums[ends[:-1]]
        found = [mix(content + tag)]
        for k in range(min(deletions, count)):
            element = sums[ends[k] + 1 : ends[k + 1] + 1] - sums[ends[k] : ends[k + 1]]
            found.append(mix(content[k] - element + tag[k]))
        found = np.concatenate(found)
        out.append(np.unique(found & ~_U(1) | _U(band & 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of about as many bits as the set has elements."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    sizes = [0 if a is None else len(a) for a in arrays]
    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    values = np.concatenate([a.view(np.int64) for a in arrays if a is not None] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(ends, pa.array(values), mask=pa.array([a is None for a in arrays]))


def shingle_table(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, n, k, sketch, sigs`` of each row; ``k`` is a 64-bit key of the whole set, ``row`` a hash of the text.

    A task gives sketch and signatures once for each set it meets, so copies cost nothing further on. Rows
    without an id or without words have a null key.
    """

    def make():
        cut = Shingler(words)
        seen: set[int] = set()

        def work(part):
            if len(seen) > KEPT:
                seen.clear()
            n, keys, sketches, sigs = [], [], [], []
            ids = ids_of(part)
            for known, text in zip(ids.is_valid().to_pylist(), texts_of(part)):
                s = cut(text)
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) and known else None
                new = key is not None and key not in seen
                if new:
                    seen.add(key)
                n.append(len(s))
                keys.append(key)
                sketches.append(sketch(s) if new else None)
                sigs.append(signatures(s, percent) if new else None)
            return {"doc_id": ids, "row": ids_of(part, "row"), "n": n, "k": keys, "sketch": _lists(sketches), "sigs": _lists(sigs)}

        return work

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("row"))
    return map_slices(rows, make, "doc_id long, row long, n long, k long, sketch array<long>, sigs array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows ``sig, k, n`` those whose signature several sets have, with a ``centre`` for each bucket.

    One shuffle by signature; the sorted rows of a partition pass by once, and no bucket is ever held. The centre is the
    set with most shared signatures: an original is nearer to its copies than they are to each other.
    """

    def run(batches):
        last = None  # the first set of the bucket that the last batch ended in, while it is the only one
        for batch in batches:
            sig, k, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(sig):
                continue
            begun = last is not None and last[0] == sig[0]
            if begun:  # the set that came last stands before this batch once more
                sig, k, n = (np.r_[x, y] for x, y in zip(last[:3], (sig, k, n)))
            new = np.r_[True, (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])]
            sig, k, n = sig[new], k[new], n[new]
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[start, len(sig)])
            several = np.repeat(size > 1, size)
            told = begun and last[3]
            if told:
                several[0] = False  # it was passed on before
                several[1 : size[0]] = True
            last = (sig[-1], k[-1], n[-1], bool(several[-1]) or told and len(start) == 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (sig, k, n)], names=["sig", "k", "n"])

    dealt = rows.repartition("sig").sortWithinPartitions("sig", "k")
    found = stored(dealt.mapInArrow(run, "sig long, k long, n long"), "shared")
    counted = found.join(found.groupBy("k").agg(F.count("*").alias("shares")), "k")
    centres = counted.groupBy("sig").agg(F.max(F.struct("shares", "k", "n")).alias("top")).select("sig", F.col("top.k").alias("centre"), F.col("top.n").alias("centre_n"))
    return found.join(centres, "sig")


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _distance(x: Column, y: Column) -> Column:
    """Hamming distance of two sketches; the longer one is folded to the shorter one's length."""

    def fold(long: Column, short: Column) -> Column:
        return F.transform(short, lambda v, i: F.aggregate(F.sequence(i, F.size(long) - 1, F.size(short)), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(long, j))))

    a = F.when(F.size(x) > F.size(y), fold(x, y)).otherwise(x)
    b = F.when(F.size(y) > F.size(x), fold(y, x)).otherwise(y)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _sifted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` of sets, ``a`` the smaller key, whose sketches are near enough."""
    left = classes.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("doc_id").alias("doc_a"))
    right = classes.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("doc_id").alias("doc_b"))
    bound = F.floor((F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent))
    return pairs.join(left, "a").join(right, "b").where(_distance(F.col("sa"), F.col("sb")) <= bound).select("a", "b", "doc_a", "doc_b")


def _met(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` of rows ``sig, k, n, c`` that share a signature, lie in different components and have near sketches.

    A bucket passes by sorted by size, and only the sets that are not too small for the present one are held. Blocks of sketches are
    compared as arrays: pairs that are not near enough are never rows.
    """

    def run(batches):
        held: list[tuple] = []  # (k, n, c, sketch) of the bucket's sets that may still meet a partner
        bucket = None
        for batch in batches:
            sig, k, n, c = (batch.column(i).to_numpy() for i in range(4))
            ends, words = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(np.uint64)
            cut = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            found = []
            for start, stop in zip(cut, np.r_[cut[1:], len(sig)]):
                if sig[start] != bucket:
                    bucket, held = sig[start], []
                for at in range(start, stop, _TOGETHER):
                    part = slice(at, min(at + _TOGETHER, stop))
                    least = n[at] * percent
                    held = [h for h in held if 100 * h[1][-1] >= least]
                    short = int((ends[at + 1 : part.stop + 1] - ends[part]).min())
                    fold = np.stack([np.bitwise_xor.reduce(words[ends[i] : ends[i + 1]].reshape(-1, short), axis=0) for i in range(part.start, part.stop)])
                    held.append((k[part], n[part], c[part], fold))
                    for other in held:
                        found += _near(held[-1], other, percent)
            if found:
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    dealt = rows.join(classes.select("k", "sketch"), "k").select("sig", "k", "n", "c", "sketch")
    return dealt.repartition("sig").sortWithinPartitions("sig", "n", "k").mapInArrow(run, "a long, b long").distinct()


def _near(new: tuple, old: tuple, percent: int) -> list[np.ndarray]:
    (ka, na, ca, xa), (kb, nb, cb, xb) = new, old
    width = min(xa.shape[1], xb.shape[1])
    xa, xb = (np.bitwise_xor.reduce(x.reshape(len(x), -1, width), axis=1) for x in (xa, xb))
    apart = np.bitwise_count(xa[:, None] ^ xb[None]).sum(2, dtype=np.int64)
    both = na[:, None] + nb[None]
    fits = (apart <= both * (100 - percent) // (100 + percent)) & (ca[:, None] != cb[None]) & (np.minimum(na[:, None], nb[None]) * 100 >= np.maximum(na[:, None], nb[None]) * percent)
    if ka is kb:
        fits = np.triu(fits, 1)
    i, j = np.nonzero(fits)
    return [np.c_[ka[i], kb[j]]] if len(i) else []


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of sets with one document of each."""
    left, right = (classes.select(F.col("k").alias(x), F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "doc_a", "doc_b")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs ``a, b, doc_a, doc_b`` those ``a, b`` whose whole sets are similar enough.

    The texts of one document of each set meet under the pair's first set, which is repeated for every BLOCK
    partners, so that no group grows with the number of copies. In a sorted partition the first set comes before its
    partners, and only that one is held.
    """
    block = F.floor((F.row_number().over(Window.partitionBy("a", "part").orderBy("b")) - 1) / BLOCK).cast("int")
    numbered = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")).withColumn("block", block)
    first = numbered.select("a", "part", "block", F.lit(0).alias("role"), F.col("a").alias("k"), F.col("doc_a").alias("id")).distinct()
    others = numbered.select("a", "part", "block", F.lit(1).alias("role"), F.col("b").alias("k"), F.col("doc_b").alias("id"))
    asked = first.unionByName(others)
    needed = asked.select("id").distinct()
    # the ids grow with the corpus, so they are never sent to all tasks
    texts = docs.join(needed.hint("merge"), docs["doc_id"] == needed["id"], "left_semi").select(F.col("doc_id").alias("_id"), "text")
    rows = asked.join(texts, F.col("id") == F.col("_id")).select("a", "part", "block", "role", "k", "text")

    def run(batches):
        cut = Shingler(words)
        group = centre = None
        for part in slices(batches):
            a, p, q, role, k = (part.column(i).to_pylist() for i in range(5))
            found = []
            for i, text in enumerate(texts_of(part)):
                s = cut(text)
                if xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) != k[i]:
                    continue  # another text under a repeated id
                if role[i] == 0:
                    group, centre = (a[i], p[i], q[i]), s
                elif group == (a[i], p[i], q[i]):
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(s) - both):
                        found.append((a[i], k[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    dealt = rows.repartition("a", "part", "block").sortWithinPartitions("a", "part", "block", "role")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, row`` of each row: the set's size, the smallest id reachable by links, a hash of the text.

    Rows with equal sets are linked (similarity 1). A text without words, also a null one, has no shingles and is linked
    with nothing, its component is its own id. Rows with a null id take no part and have a null component. Rows that repeat an id
    are joined each with its own text. An empty table gives an empty result; other columns are not read.

    Sets are compared by 64-bit hashes of their shingles. First every bucket's members are compared with its
    centre. What remains unlinked in a bucket is compared pair by pair, after each set has left out its most frequent buckets;
    members of one component need no comparison.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = stored(shingle_table(docs, words=words, percent=percent), "shingles")
    per_set = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"))
    classes = stored(per_set, "sets")
    emitted = rows.where("sigs IS NOT NULL").select(F.explode("sigs").alias("sig"), "k", "n")
    hits = stored(_shared(emitted), "hits")
    stars = hits.where(F.col("k") != F.col("centre")).where(_near_sizes(F.col("n"), F.col("centre_n"), percent)).select(F.least("centre", "k").alias("a"), F.greatest("centre", "k").alias("b")).distinct()
    edges = stored(_verified(stored(_sifted(stars, classes, percent), "pairs"), docs, words, percent), "links")
    groups = components(edges)

    # what the first comparison left open
    left = hits.join(groups, "k", "left").withColumn("c", F.coalesce("c", "k"))
    buckets = left.groupBy("sig").agg(F.count("*").alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    open_ = stored(left.join(buckets, "sig").select("sig", "k", "n", "c", "centre", "f", (F.col("c0") < F.col("c1")).alias("mixed")), "open")
    place = F.row_number().over(Window.partitionBy("k", F.col("sig").bitwiseAND(F.lit(1))).orderBy(F.desc("f"), "sig"))
    skip = F.when(F.col("n") >= first_exact(percent), 2 + F.floor(F.floor(F.col("n") * percent / 100) / 64)).otherwise(0)
    kept = open_.withColumn("place", place).where((F.col("place") > skip) & F.col("mixed") & (F.col("k") != F.col("centre")))
    more = stored(_named(_met(kept.select("sig", "k", "n", "c"), classes, percent), classes), "pairs")
    if not more.isEmpty():
        groups = components(edges.unionByName(stored(_verified(more, docs, words, percent), "links")))

    known = classes.select("k", F.col("doc_id").alias("own")).join(groups, "k", "left").withColumn("c", F.coalesce("c", "k"))
    least = known.groupBy("c").agg(F.min("own").alias("component_id"))
    of_set = known.join(least, "c").select(F.col("k").alias("_k"), "component_id")
    out = rows.select("doc_id", "row", "n", "k").join(of_set, F.col("k") == F.col("_k"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "row")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of sets of five words that are similar by 0.8 or more: the one with the smallest id.

    Documents without words or id stay, and so do repeated rows of one document.
    """
    found = join(docs, words=STAGE_WORDS, percent=STAGE_PERCENT)
    gone = found.where("n_shingles > 0 AND doc_id > component_id").select(F.col("doc_id").alias("_gone"), F.col("row").alias("_row")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_row"]), "left_anti")
