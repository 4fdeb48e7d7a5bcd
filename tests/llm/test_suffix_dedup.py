import hashlib
import random
from collections import Counter

import pytest
from odd import ROWS, documents, empty
from roadlens.llm import suffix_array as a
from roadlens.llm import suffix_dedup as d


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, raw):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, x in zip(t, gone) if not x)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, df, length=200, **options):
    return sorted((tuple(r)[:5] for r in d.drop_repeats(df, length=length, **options).collect()), key=repr)


def texts(n, seed=0):
    """Unlike texts with shared passages, near copies, copies, periodic and multi-byte text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeèfghß") for _ in range(rnd.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(60), prose(45), prose(38)]
    out = []
    for i in range(n):
        parts = [prose(rnd.randint(0, 60)), rnd.choice(passages) if rnd.random() < 0.6 else "", prose(rnd.randint(0, 60))]
        out.append(" ".join(parts))
    base = prose(400)
    for i in range(10):
        cut = rnd.randint(0, len(base) - 1)
        out.append(base[:cut] + "#" + base[cut + 1 :])
    out += [out[0]] * 3 + ["ab" * 400, "z" * 199, "z" * 200, "y" * 201, "xyz" * 150 + prose(50)]
    return out


@pytest.mark.parametrize("length", [1, 3, 8])
def test_transform_finds_repeats(length):
    rnd = random.Random(length)
    for alphabet in (b"a", b"ab", b"abc\x00\xff"):
        for _ in range(20):
            pieces = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(rnd.randint(0, 5))]
            counts = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
            want = [[i for i in range(len(p) - length + 1) if counts[p[i : i + length]] > 1] for p in pieces]
            assert [x.tolist() for x in a.repeated(pieces, length)] == want


@pytest.mark.parametrize("hot", [4096, 3])
def test_same_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(d, "HOT", hot)  # 3: most shared anchors are dealt over several blocks
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000 if hot == 3 else 1 << 20)
    rows = list(enumerate(texts(60)))
    rows += [(None, rows[1][1]), (7, rows[7][1]), (1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(spark, df) == brute(rows, 200)


def test_long_texts_in_parts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(20, 1))] + [(99, " ".join(texts(20, 2)))]
    monkeypatch.setattr(d, "BLOCK_BYTES", 20000)
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 120, step=1000) == brute(rows, 120)


def test_odd_rows(spark):
    assert got(spark, documents(spark)) == brute([r[:2] for r in ROWS], 200)
    assert got(spark, empty(spark)) == []


def test_removed_spans_are_listed(spark):
    shared = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(1, "first " + shared + " one"), (2, "other " + shared + " two")]
    for r in d.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        # the space on both sides belongs to the repeat
        assert [(x.start, x.stop) for x in r.removed] == [(5, 267)] and r.n_removed == 262
