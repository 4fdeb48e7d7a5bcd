"""Removal of byte strings that occur more than once anywhere in a corpus, by suffix order of the places that can repeat.

Every string of ``length`` bytes (a window) is owned by the substring of ANCHOR bytes in it that hashes lowest, so equal windows have
equal anchors at equal offsets. Neighbouring windows with one anchor form a piece. Pieces travel as hashes first:

* an anchor met once has no repeated window;
* equal pieces of one anchor repeat as a whole;
* unlike pieces of one anchor are compared as texts: anchors are dealt into blocks of bounded size, and each block finds its repeated
  windows by the Burrows-Wheeler transform of its pieces (``suffix_array``).

An anchor with very many unlike pieces (a passage met in different surroundings) would make one block large; its pieces are dealt
into several blocks, and what a block leaves open is compared with the windows of the others by 128-bit hashes: first the bytes that
CLASS neighbouring windows have in common, then the single windows of those that are met. Both are rows of an aggregation that Spark
spreads over all tasks.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import query, slices, stored, table
from roadlens.llm.suffix_array import repeated
from roadlens.session import work_dir

#: Bytes of an anchor; text hashed at once; bytes of pieces in a block; kinds of pieces of an anchor in one block.
ANCHOR, STEP, BLOCK_BYTES, HOT = 64, 2 << 20, 1 << 20, 1024
#: Bytes of a bucket of the stored texts, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 50_000
#: Windows whose offsets from their anchor are compared as one first.
CLASS = 8
#: Distinct texts that a task remembers while it drops repeats.
REMEMBERED = 200_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = 24  # bits of a place inside the text hashed at once


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Hasher:
    """Hashes of all substrings of ANCHOR bytes by prefix sums of a polynomial modulo 2^64."""

    def __init__(self):
        n = 2 * STEP + ANCHOR  # and the part that a text shares with the next
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[:n], out=sums[1:])
        h = (sums[ANCHOR:] - sums[: n - ANCHOR + 1]) * self.down[: n - ANCHOR + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def runs(data: np.ndarray, sizes: np.ndarray, length: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, start, number of windows and place of the anchor in the piece, of each piece in texts that lie one after the other in ``data``."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    hashes = hasher(data)
    wide = length - ANCHOR + 1
    # the lowest hash of each window, the leftmost of equal ones: block-wise running minima from both sides
    key = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.r_[key, np.full(-len(key) % wide, _MASK, np.uint64)].reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(key) - wide + 1
    lowest = np.minimum(behind[:windows], ahead[wide - 1 : len(key)])
    place = (lowest & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    enough = sizes >= length
    change = np.zeros(windows + 1, np.int32)
    np.add.at(change, starts[enough], 1)
    np.add.at(change, np.minimum(ends[enough] - length + 1, windows), -1)
    whole = np.cumsum(change)[:windows] > 0
    new = np.r_[True, place[1:] != place[:-1]]
    new[1:] |= whole[1:] != whole[:-1]
    new[starts[enough]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, windows])
    keep = whole[first]
    first, count = first[keep], count[keep]
    return hashes[place[first]], first, count, place[first] - first


def _parts(texts: list[bytes], length: int, step: int):
    """Batches of about 2 ``step`` bytes at most as (row, offset, bytes); long texts in parts that share ``length - 1`` bytes."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), step):
            part = text[at : at + step + length - 1]
            if batch and size + len(part) > 2 * step:
                yield batch
                batch, size = [], 0
            batch.append((row, at, part))
            size += len(part)
    if batch:
        yield batch


def _key(text: Column) -> list[Column]:
    """124 bits of a text as two longs."""
    return [F.xxhash64(text).alias("k1"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("k2")]


def _distinct_texts(docs: DataFrame, length: int) -> DataFrame:
    """``k1, k2, text, copies`` of the texts with a window, stored in buckets by key so that later joins do not move texts.

    Tasks drop repeats before the shuffle: a text of which a third of all rows are copies arrives once a task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def once(batches):
        seen: dict[tuple[int, int], int] = {}

        def extra():
            again = [(k, n) for k, n in seen.items() if n]
            return batch([k for k, _ in again], pa.nulls(len(again), pa.string()), [n for _, n in again])

        def batch(keys, texts, copies):
            k1, k2 = zip(*keys) if keys else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), texts, pa.array(copies, pa.int64())], names=["k1", "k2", "text", "copies"])

        for part in slices(batches):
            new, keys = [], []
            for i, key in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                if key in seen:
                    seen[key] += 1
                else:
                    seen[key] = 0
                    new.append(i)
                    keys.append(key)
            if new:
                yield batch(keys, part.column(2).take(pa.array(new)).cast(pa.string()), [1] * len(new))
            if len(seen) > REMEMBERED:
                yield extra()
                seen.clear()
        yield extra()

    thin = rows.select(*_key(F.col("text")), "text").mapInArrow(once, "k1 long, k2 long, text string, copies long")
    buckets = min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))
    one = thin.repartition(buckets, "k1", "k2").groupBy("k1", "k2").agg(F.max("text").alias("text"), F.sum("copies").alias("copies"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    path = f"{work_dir(spark).rstrip('/')}/llm-{name}"
    one.write.bucketBy(buckets, "k1", "k2").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _pieces(texts: DataFrame, length: int, step: int) -> DataFrame:
    """``a, g, k1, k2, start, windows, anchor``: anchor hash, hash of the piece's bytes, text, place, and place of the anchor in it."""

    def run(batches):
        hasher = Hasher()
        for part in slices(batches, 1024):
            keys = [np.asarray(part.column(i)) for i in (0, 1)]
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
            for batch in _parts(texts, length, step):
                joined = b"".join(p for _, _, p in batch)
                sizes = np.array([len(p) for _, _, p in batch], np.int64)
                a, first, count, at_anchor = runs(np.frombuffer(joined, np.uint8), sizes, length, hasher)
                ends = (first + count + length - 1).tolist()
                g = [hashlib.blake2b(joined[s:e], digest_size=8).digest() for s, e in zip(first.tolist(), ends)]
                borders = np.cumsum(sizes)
                at = np.searchsorted(borders, first, side="right")
                row = np.array([r for r, _, _ in batch], np.int64)[at]
                start = first - (borders - sizes)[at] + np.array([o for _, o, _ in batch], np.int64)[at]
                columns = [a.view(np.int64), np.frombuffer(b"".join(g), np.int64), keys[0][row], keys[1][row], start, count.astype(np.int32), at_anchor.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "g", "k1", "k2", "start", "windows", "anchor"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "a long, g long, k1 long, k2 long, start long, windows int, anchor int")


def _unlike(pieces: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``a, k1, k2, start, alone, share, anchor, piece``: the bytes of one of each kind of piece of the anchors that have several kinds.

    ``share`` is null, or for anchors with more than HOT kinds the number of the part to which the piece is dealt.
    """
    kinds = pieces.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1")
    share = F.when(F.col("kinds") > HOT, F.pmod(F.xxhash64("g"), F.ceil(F.col("kinds") / HOT)))
    places = F.struct("start", "windows", "anchor", "a", F.expr("n = 1").alias("alone"), share.cast("long").alias("share"))
    wanted = pieces.join(kinds, "a").groupBy("k1", "k2").agg(F.collect_list(places).alias("places"))  # the pieces of one text

    def run(batches):
        for part in slices(batches, 64):
            k1, k2, texts, places = (part.column(i).to_pylist() for i in range(4))
            out = []
            for i, text in enumerate(texts):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(p["a"], k1[i], k2[i], p["start"], p["alone"], p["share"], p["anchor"], raw[p["start"] : p["start"] + p["windows"] + length - 1]) for p in places[i]]
                if len(out) > 4096:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows):
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "k1", "k2", "start", "alone", "share", "anchor", "piece"])

    read = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "places")
    return read.mapInArrow(run, "a long, k1 long, k2 long, start long, alone boolean, share long, anchor int, piece binary")


_FOUND = "k1 long, k2 long, start long, stop long, h1 long, h2 long, open long, body binary"


def _hash(data: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _classes(piece: bytes, a: int, anchor: int, again: np.ndarray, alone: bool, length: int):
    """For each group of windows of a hot piece: hash of what they share, first window, bits of the open ones, bytes, all repeated?

    The offset from the anchor decides the group, so equal windows are in groups with equal shared bytes.
    """
    n = len(piece) - length + 1
    for group in range((anchor - n + 1) // CLASS, anchor // CLASS + 1):
        top = anchor - group * CLASS
        low, high = max(0, top - CLASS + 1), min(n - 1, top)
        shared = piece[top : top - CLASS + 1 + length]
        key = _hash(shared + a.to_bytes(8, "little", signed=True) + group.to_bytes(4, "little"))
        open_ = sum(1 << (w - low) for w in range(low, high + 1) if alone and not again[w])
        yield key, low, open_, piece[low : high + length], bool(again[low : high + 1].all())


def _blocks(unlike: DataFrame, length: int) -> DataFrame:
    """What the blocks find: spans of repeated windows (``stop`` is set), and of hot anchors the windows that other blocks may hold.

    Only pieces that are the only ones of their kind need spans: the others repeat as a whole. A hot piece's windows are sent by
    groups; groups in which all windows repeat in the block are sent once. ``open`` has a bit for each window that a repeat elsewhere
    would remove.
    """
    size = unlike.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def run(block: pa.Table) -> pa.Table:
        pieces = block.column("piece").to_pylist()
        found = repeated(pieces, length)
        a, alone, share, anchor, start = (block.column(c).to_pylist() for c in ("a", "alone", "share", "anchor", "start"))
        rows, out, sent = [], [], set()
        for i, hit in enumerate(found):
            if alone[i] and len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                first, last = hit[np.r_[0, cut + 1]].tolist(), hit[np.r_[cut, len(hit) - 1]].tolist()
                rows += [i] * len(first)
                out += [(start[i] + b, start[i] + e + length, 0, 0, 0, None) for b, e in zip(first, last)]
            if share[i] is not None:
                again = np.zeros(len(pieces[i]) - length + 1, bool)
                again[hit] = True
                for (h1, h2), low, open_, body, whole in _classes(pieces[i], a[i], anchor[i], again, alone[i], length):
                    if whole:
                        if (h1, h2, body) in sent:
                            continue
                        sent.add((h1, h2, body))
                    rows.append(i)
                    out.append((start[i] + low, -1, h1, h2, open_, body))
        at = pa.array(rows, pa.int64())
        kinds = [pa.int64()] * 5 + [pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        names = ["start", "stop", "h1", "h2", "open", "body"]
        return pa.table({"k1": block.column("k1").take(at), "k2": block.column("k2").take(at), **dict(zip(names, columns))})

    number = F.pmod(F.xxhash64("a", F.coalesce("share", F.lit(-1).cast("long"))), F.lit(blocks)).alias("block")
    return unlike.select(number, "a", "k1", "k2", "start", "alone", "share", "anchor", "piece").groupBy("block").applyInArrow(run, _FOUND)


def spans(texts: DataFrame, length: int, step: int = STEP) -> DataFrame:
    """``k1, k2, start, stop``: byte spans of distinct texts whose windows also start elsewhere; spans may overlap."""
    met = stored(_pieces(texts, length, step), "suffix-pieces")
    again = met.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    live = stored(met.join(again, "a", "left_semi"), "suffix-live")
    one = [F.first(c).alias(c) for c in ("k1", "k2", "start", "windows", "anchor")]  # of one and the same row
    pieces = stored(live.groupBy("a", "g").agg(F.count("*").alias("n"), *one), "suffix-kinds")
    alike = live.join(pieces.where("n > 1").select("a", "g"), ["a", "g"], "left_semi")
    alike = alike.select("k1", "k2", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop"))
    found = stored(_blocks(stored(_unlike(pieces, texts, length), "suffix-unlike"), length), "suffix-found")
    return alike.unionByName(found.where("stop >= 0").select("k1", "k2", "start", "stop")).unionByName(_across(found.where("stop < 0"), length))


def _across(groups: DataFrame, length: int) -> DataFrame:
    """Spans of open windows of hot anchors that occur in another block."""
    met = groups.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.col("open") > 0).alias("some")).where("n > 1 AND some").select("h1", "h2")

    def run(batches):
        for part in slices(batches, 1024):
            k1, k2, start, open_, body = (part.column(i).to_pylist() for i in range(5))
            out = []
            for i, data in enumerate(body):
                for w in range(len(data) - length + 1):
                    out.append((*_hash(data[w : w + length]), k1[i], k2[i], start[i] + w, bool(open_[i] >> w & 1)))
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["h1", "h2", "k1", "k2", "start", "open"])

    some = groups.join(met, ["h1", "h2"], "left_semi").select("k1", "k2", "start", "open", "body")
    windows = stored(some.mapInArrow(run, "h1 long, h2 long, k1 long, k2 long, start long, open boolean"), "suffix-windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    hit = windows.where("open").join(twice, ["h1", "h2"], "left_semi")
    return hit.select("k1", "k2", "start", (F.col("start") + length).alias("stop"))


def union_of(parts: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[list[int]] = []
    for start, stop in sorted((p["start"], p["stop"]) for p in parts):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(s, e) for s, e in out]


def drop_repeats(docs: DataFrame, *, length: int = 200, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` of each row.

    Every byte of a text covered by a string of ``length`` (at least ANCHOR) bytes that also starts anywhere else, in the same text or
    another row, is removed; strings are judged on the input. Texts are hashed ``step`` bytes (at most STEP) at a time. ``removed`` lists the maximal runs as ``start, stop`` byte offsets; the
    kept text is what is left, joined. A null text counts as empty; rows without an id and repeated rows are kept
    (a repeated text of ``length`` bytes or more loses all its bytes); an empty table gives an empty result; only the two
    columns are read. Kinds of pieces are told apart by 64-bit hashes within one 64-bit anchor hash.

    Texts move once; after that narrow rows meet them in their buckets. No step gathers the places of one passage: equal pieces are
    counted, unlike ones lie in blocks of about BLOCK_BYTES, and anchors with more than HOT kinds are dealt over several of them.
    """
    if not ANCHOR <= length <= STEP or step > STEP:
        raise ValueError(f"length must be {ANCHOR} to {STEP}, step at most {STEP}")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    texts = _distinct_texts(rows, length)
    found = spans(texts, length, step).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))

    def run(batches):
        for part in slices(batches, 256):
            out = []
            for text, parts in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                raw, runs_ = text.encode("utf-8", "surrogatepass"), union_of(parts)
                kept, at = hashlib.sha256(), 0
                for start, stop in runs_:
                    kept.update(raw[at:start])
                    at = stop
                kept.update(raw[at:])
                out.append((kept.hexdigest(), [{"start": s, "stop": e} for s, e in runs_]))
            kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], names=["k1", "k2", "kept", "removed"])

    schema = "k1 long, k2 long, kept string, removed array<struct<start: long, stop: long>>"
    read = texts.where("copies = 1").join(found, ["k1", "k2"]).select("k1", "k2", "text", "parts")
    some = read.mapInArrow(run, schema)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop")))
    whole = texts.where("copies > 1").select("k1", "k2", F.sha2(F.lit(""), 256).alias("kept"), all_.alias("removed"))
    cut = stored(some.unionByName(whole), "suffix-cut")
    narrow = rows.select("doc_id", *_key(F.col("text")), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all"))
    out = narrow.join(cut, ["k1", "k2"], "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<start: long, stop: long>>"))
    total = F.aggregate(removed, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return out.select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size(removed).cast("long").alias("n_spans"), F.coalesce("kept", "all").alias("kept_sha256"), removed.alias("removed")
    )


_DIGITS = "hex(encode(coalesce(text, '')))"

SQL_TWIN = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_DIGITS} AS h FROM documents),
w AS MATERIALIZED (SELECT r, s, md5_number(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT r, h, unnest(range(greatest(0, length(h) // 2 - 199))) AS s FROM d)),
t AS MATERIALIZED (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, s, sum(CASE WHEN s - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT r, s, coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1000) AS p FROM t)),
c AS MATERIALIZED (SELECT r, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY r, i),
n AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM c),
k AS (
  SELECT r, sum(b - a) AS gone, count(*) AS runs, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS left_
  FROM n JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
  sha256(unhex(coalesce(left_, h))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


@query("op12_suffix_dedup", sql=SQL_TWIN)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).drop("removed")
