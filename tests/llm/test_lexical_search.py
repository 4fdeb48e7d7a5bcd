import re

import numpy as np
from roadlens.llm import lexical_search as s

from odd import ROWS, documents, empty

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [w.translate(FOLD) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    from collections import Counter

    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n_all, total = len(bags), sum(b[2] for b in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    terms = {}
    for i, t in items:
        if i is not None:
            terms.setdefault(i, set()).update(words(t))
    out = set()
    for i, mine in terms.items():
        rows = []
        for d, bag, n in bags:
            m = 100 - 90 + (90 * n * n_all) // total
            score = sum(s.weight(n_all, df[w]) * ((1000000000 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in mine if w in bag)
            if score > 0 and d is not None:
                rows.append((-score, d))
        out |= {(i, r, d, -score) for r, (score, d) in enumerate(sorted(rows)[:k], 1)}
    return out


def found(spark, docs, items, **options):
    index, n, _ = s.build_index(docs, **options)
    return {tuple(r) for r in s.search(index, n, spark.createDataFrame(items, "item_id long, text string, rank int")).collect()}


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows = []
    for i in range(n):
        rows.append((int(rng.integers(0, n)), " ,".join(vocabulary[min(399, int(x))] for x in rng.zipf(1.3, int(rng.integers(1, 60))))))
    return rows, [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 12)))), 0) for i in range(30)]


def test_tree_holds_all_points():
    rng = np.random.default_rng(3)
    for top_row, top_col, n in ((1, 1, 1), (5, 300, 40), (70000, 20, 500), (64, 64, 4096)):
        place = np.unique(np.c_[rng.integers(0, top_row, n), rng.integers(0, top_col, n)], axis=0)
        value = rng.integers(1, 1000000, len(place))
        words_, ids = [str(i).encode() for i in range(top_row)], np.arange(top_col)
        grid = s.Grid({"ids": ids.tobytes(), "terms": b"\n".join(words_), **s.build_tree(place[:, 0], place[:, 1], value)})
        for row in np.unique(place[:, 0])[:20]:
            best = s.Best(1, 5000)
            grid.search([([str(row).encode()], [1])], best)
            mine = place[:, 0] == row
            assert dict(zip(best.key.tolist(), best.score.tolist())) == dict(zip(place[mine, 1].tolist(), value[mine].tolist()))


def test_same_as_brute_force(spark, monkeypatch):
    rows, items = corpus(700)
    rows += [(5000 + i, rows[0][1]) for i in range(60)] + [(None, rows[1][1]), (6000, None), (6001, "...")]
    items += [(100, None, 0), (101, "unknownterm", 0), (102, rows[0][1], 0), (103, "w1", 0), (103, "W2 w3", 0), (None, "w1", 0)]
    want = brute(rows, [i[:2] for i in items])
    got = found(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items, shard_docs=100)  # several shards in a task
    assert got == want
    monkeypatch.setattr(s, "BLOCK_TERMS", 40)  # several blocks of items
    monkeypatch.setattr(s, "TOGETHER", 10)
    assert found(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), items) == want


def test_odd_rows(spark):
    items = [(1, "old house word", 0), (2, "x" * 70000, 0), (3, "Turm σ Σ", 0), (4, "", 0)]
    assert found(spark, documents(spark), items) == brute([r[:2] for r in ROWS], [i[:2] for i in items])
    assert found(spark, empty(spark), items) == set()
    assert found(spark, documents(spark), []) == set()


def test_row_groups_of_the_index_hold_few_shards(spark):
    """Spark's reader holds a row group at once: all shards of a task in one took its memory."""
    import pyarrow.parquet as pq

    rows = [(i, " ".join(f"word{i}x{j}" for j in range(60000))) for i in range(16)]
    index, n, _ = s.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shard_docs=1)
    (file,) = index.inputFiles()
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert meta.num_rows == 16 and sum(sizes) > 12e6 and max(sizes) < 10e6
    assert not any(meta.row_group(0).column(i).is_stats_set for i in range(meta.num_columns)), "the writer holds those of all row groups, whole values"
    items = spark.createDataFrame([(1, "word3x17", 0), (2, "word7x59999 word0x0", 0)], "item_id long, text string, rank int")
    assert {(r.item_id, r.doc_id) for r in s.search(index, n, items).collect()} == {(1, 3), (2, 7), (2, 0)}
