"""Token counts by rank-synchronous merging in ragged arrays."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadlens.llm.common import ids_of, map_slices, query, table, texts_of
from roadlens.llm.word_bpe import Vocabulary, chunks, encode_chunks

#: Chunks whose counts a task keeps, and the longest chunk that is kept.
KEPT, KEPT_LENGTH = 1 << 19, 64


class Counter:
    """Counts the tokens of texts; remembers the counts of short chunks, never more than KEPT."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT:
            self.known.clear()
        cut = [[chunks(p) for p in self.vocabulary.parts(t)[::2]] for t in texts]
        known = self.known
        new = {c for parts in cut for p in parts for c in p}.difference(known)
        for batch, _, ends in encode_chunks(self.vocabulary, new):
            known.update(zip(batch, np.diff(ends).tolist()))
        # one token for each special string between the parts
        out = [len(parts) - 1 + sum(sum(map(known.__getitem__, p)) for p in parts) for parts in cut]
        for chunk in new:
            if len(chunk) > KEPT_LENGTH:
                del known[chunk]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Token count of every row's whole text, as the vocabulary's library counts it, without added tokens.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens), one row for each
    input row, in any order. A null text counts as empty (0 bytes, 0 tokens); null and repeated ids
    are kept as they are; an empty table gives an empty result; other columns are not read, so their
    names cannot clash. Nothing is shuffled; texts of any length are merged in arrays of bounded size
    (a single chunk without white space is merged as a whole).
    """
    with open(tokenizer, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the table

    def make():
        count = Counter(Vocabulary(raw.value))

        def work(part):
            texts = texts_of(part)
            n = count(texts)
            return {"doc_id": ids_of(part), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_slices(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
