import random
import re

import numpy as np
import pytest
from odd import ROWS, documents, empty
from roadlens.llm import jaccard_join as j
from roadlens.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, words=4, percent=85):
    """(id, set size, component) of each row by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    ids = [i for i, _ in rows]
    least = list(range(len(rows)))

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and None not in (ids[a], ids[b]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                least[top(a)] = top(b)
    groups = {}
    for x in range(len(rows)):
        if ids[x] is not None:
            groups.setdefault(top(x), []).append(ids[x])
    return [(ids[x], len(sets[x]), min(groups[top(x)]) if ids[x] is not None and sets[x] else ids[x]) for x in range(len(rows))]


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def plain(rows):
    return sorted((-1 if i is None else i, n, -1 if c is None else c) for i, n, c in rows)


def test_odd_rows(spark):
    assert result(j.join(documents(spark))) == plain(brute([(i, t) for i, t, _, _ in ROWS]))
    assert result(j.join(empty(spark))) == []


@pytest.mark.parametrize("percent", [85, 60])
def test_against_all_pairs(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for size in (3, 5, 8, 10, 12, 16, 24, 40, 60, 130, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):  # edits around the limit
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            if rng.random() < 0.3:
                copy = copy + passage
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, percent=percent)
    assert len({c for _, _, c in want}) < len(rows) - 30
    assert result(j.join(docs, percent=percent)) == plain(want)


@pytest.mark.parametrize("percent", [85, 60])
def test_similar_sets_share_a_signature_and_sketches_bound_the_difference(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 250, 320, 900, 4000]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            allowed = int(rng.integers(0, max(1, j.differing(len(a), len(a), percent)) + 1))
            gone = int(rng.integers(0, allowed + 1))
            b = np.unique(np.r_[rng.permutation(a)[: len(a) - gone], rng.integers(0, 2**64, allowed - gone, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            same = np.intersect1d(j.signatures(a, percent), j.signatures(b, percent))
            skipped = min(j.spare(x * percent // 100) if x >= j.first_exact(percent) else 0 for x in (len(a), len(b)))
            assert np.array_equal(a, b) or len(same) > skipped
            x, y = (np.unpackbits(j.sketch(s).view(np.uint8), bitorder="little") for s in (a, b))
            if len(x) == len(y):
                assert (x != y).sum() <= len(np.setxor1d(a, b))


def test_stage_keeps_one_of_each_group(spark):
    left = j.stage(spark, documents(spark), "").select("doc_id", "text").collect()
    assert sorted(r.doc_id or -1 for r in left) == sorted(i or -1 for i in (1, 3, 4, 5, 6, 7, 8, 9, None, None, 10, 11, 11))


def test_hot_groups(spark):
    """A third of all rows are copies, and another third near copies of one text."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [" ".join(base)] * 400
    for _ in range(400):
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(words)
        rows.append(" ".join(copy))
    rows += [" ".join(rng.choice(words) for _ in range(100)) for _ in range(400)]
    got = result(j.join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert [c for _, _, c in got] == [0] * 800 + list(range(800, 1200))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(350)]
    least = {x: x for e in edges for x in e}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        least[max(a, b)] = min(a, b)
    got = {r.k: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in least if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stage_keeps_no_near_copy_of_five_words(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([49, 98, 150, 400]))]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 5):  # from near to too far
            cut = list(words)
            for at in range(1, 1 + k * len(words) // 49):
                cut[at * len(words) // (2 + k * len(words) // 49)] = f"x{rng.randrange(10**6)}"
            rows.append((10 * g + k, " ".join(cut)))
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL AND doc_id IS NOT NULL").collect()]

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(x) for i, x in sorted(rows) if x.split()}
    first = {i: i for i in sets}
    ids = list(sets)
    for at, i in enumerate(ids):
        for o in ids[:at]:
            both = len(sets[i] & sets[o])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[o]) - both):
                low, high = sorted((first[i], first[o]))
                first = {x: low if c == high else c for x, c in first.items()}
    want = {i for i, c in first.items() if i == c}
    kept = {r.doc_id for r in j.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert want == {i for i in kept if i in sets} and {0, 10, 20} < want
    assert {i for i in range(120) if i in sets} - want  # some went
