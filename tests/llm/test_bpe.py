import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from odd import ROWS, documents, empty
from roadlens.llm import bpe_codec as b
from roadlens.llm import token_counts as t
from roadlens.llm.word_bpe import Vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return Vocabulary(f.read())


def random_texts(n=4000):
    rng = random.Random(3)
    alphabet = "aab'stré éÉ!!<|endof12 ́漢Σς\x1c\n |>xyzТолstoı̇"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return texts + ["<|endoftext|><|startoftext|>a<|endoftext|", "a" * 999, "aaaa aaaaa ababab", "it's'll 'Re don't!!'s"]


def test_counts_and_ids_equal_the_library(library, vocabulary):
    texts = random_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert t.Counter(vocabulary)(texts) == [len(w) for w in want]
    words = {w.encode() for x in texts[:500] for w in x.split() if "<|" not in w}
    known = {w: np.array(library.encode(w.decode(), add_special_tokens=False).ids, np.int32) for w in words}
    lexicon = b.Lexicon.mapped(b.Lexicon.compile(known).to_bytes())
    assert [x.tolist() for x in b.Encoder(vocabulary, lexicon)(texts)] == want


def test_lexicon_holds_exactly_its_words():
    rng = random.Random(5)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(300)}
    ids = {w: np.array([len(w), *w], np.int32) for w in words}
    lexicon = b.Lexicon.mapped(b.Lexicon.compile(ids).to_bytes())
    tries = sorted(words) + [w + b"z" for w in words] + [b"", b"q"] + [bytes(rng.choices(b"abc", k=5)) for _ in range(300)]
    for w, place in zip(tries, lexicon.find(tries)):
        assert (place >= 0) == (w in words)
        if place >= 0:
            assert lexicon.ids[lexicon.offsets[place] : lexicon.offsets[place + 1]].tolist() == ids[w].tolist()
    assert len(lexicon.final) < sum(map(len, words)) / 3  # prefixes and suffixes are shared
    assert b.Lexicon.compile({}).find([b"a"]).tolist() == [-1]


def test_count_table(spark, library):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in t.count_tokens(documents(spark), PATH).collect())
    want = []
    for i, x, _, _ in ROWS:
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        want.append((i or -1, len((x or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert t.count_tokens(empty(spark), PATH).collect() == []


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_encode_table(spark, library, size):
    rows = b.encode(documents(spark), PATH, lexicon_size=size, decoded=True, keep=("source",)).collect()
    want = []
    for i, x, _, s in ROWS:
        ids = library.encode(x or "", add_special_tokens=False).ids
        want.append((i or -1, s or "", ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id or -1, r.source or "", list(r.ids), r.decoded) for r in rows) == sorted(want)
    assert b.encode(empty(spark), PATH).collect() == []


def test_query(spark, library, tmp_path):
    documents(spark).select("doc_id", "text", "n_tokens").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in b.op6(spark, str(tmp_path)).collect())
    want = []
    for i, x, _, _ in ROWS:
        ids = library.encode(x or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(y.encode()).hexdigest() for y in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((i or -1, len(ids), *digests))
    assert got == sorted(want)
    counts = {r.word: r.n for r in b.word_counts(documents(spark)).collect()}
    assert counts["word"] == 60000 and "x" * 70000 not in counts
