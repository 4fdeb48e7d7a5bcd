"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words of the whole corpus are counted in Spark; the most frequent are encoded once and
compiled into an automaton that shares prefixes and suffixes and whose edges carry numbers. The
sum of the numbers on a word's path is the place of its ids. The automaton is a few flat arrays
in one file, which every Python worker maps into memory. All other words are merged exactly.
"""

from __future__ import annotations

import mmap
import tempfile
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import ids_of, map_slices, query, slices, stored, table, texts_of
from roadlens.llm.word_bpe import Vocabulary, chunks, encode_chunks

#: Words in the lexicon at most (a few MB as an automaton, whatever the corpus); the longest word it takes.
LEXICON, LONGEST = 1 << 16, 64
#: Words a worker remembers between texts.
KEPT = 1 << 19


class Lexicon:
    """A minimal acyclic transducer from words to id lists, as flat arrays."""

    _PARTS = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.uint8), ("offsets", np.int64), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, np.ndarray]) -> Lexicon:
        """Build from sorted words: each state is frozen once no later word can change it, and equal states are one."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        accepted: list[int] = []

        def freeze(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                accepted.append(int(node[0]) + sum(accepted[t] for _, t in node[1]))
            return register[key]

        stack, before = [[False, []]], b""
        ordered = sorted(words)
        for word in ordered:
            shared = 0
            while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                shared += 1
            for at in range(len(before), shared, -1):
                child = freeze(stack.pop())
                stack[-1][1].append((before[at - 1], child))
            stack.extend([False, []] for _ in word[shared:])
            stack[-1][0] = True
            before = word
        for at in range(len(before), 0, -1):
            child = freeze(stack.pop())
            stack[-1][1].append((before[at - 1], child))
        root = freeze(stack.pop())
        new = {root: 0}  # the root becomes state 0
        for s in range(len(states)):
            new.setdefault(s, len(new))
        edges = []
        for s, (final, out) in enumerate(states):
            passed = int(final)
            for byte, target in out:
                edges.append((new[s] * 256 + byte, new[target], passed))
                passed += accepted[target]
        edges.sort()
        keys, targets, outputs = (np.array([e[i] for e in edges], kind) for i, kind in ((0, np.int64), (1, np.int32), (2, np.int32)))
        final = np.zeros(len(states), np.uint8)
        for s, (is_final, _) in enumerate(states):
            final[new[s]] = is_final
        lists = [words[w] for w in ordered]
        ids = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        return cls({"keys": keys, "targets": targets, "outputs": outputs, "final": final, "offsets": np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64), "ids": ids})

    def to_bytes(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, n), k) for n, k in self._PARTS]
        head = np.array([len(a) for a in arrays], np.int64).tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, raw: bytes) -> Lexicon:
        """Write the arrays to a temporary file without a name and map it: nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        n = np.frombuffer(view, np.int64, len(cls._PARTS))
        arrays, at = {}, n.nbytes
        for (name, kind), size in zip(cls._PARTS, n):
            arrays[name] = np.frombuffer(view, kind, size, at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word's ids, -1 for words it lacks: all words walk through the automaton together."""
        size = np.array([len(w) for w in words], np.int64)
        place = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return place
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        alive = np.flatnonzero(size > 0)
        state, passed = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        depth = 0
        while len(alive):
            key = state * 256 + raw[start[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            alive, at = alive[there], at[there]
            state, passed = self.targets[at].astype(np.int64), passed[there] + self.outputs[at]
            depth += 1
            ended = size[alive] == depth
            hit = ended & (self.final[state] == 1)
            place[alive[hit]] = passed[hit]
            alive, state, passed = alive[~ended], state[~ended], passed[~ended]
        return place


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each white-space separated word of up to LONGEST characters occurs in all texts.

    Each task adds up what it has read and passes it on when it holds many words, so a very
    frequent word is one row per task, and memory is bounded.
    """

    def run(batches):
        counts: Counter = Counter()

        def rows():
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return found

        for part in slices(batches):
            for text in texts_of(part):
                counts.update(chunks(text))
            if len(counts) > KEPT:
                yield rows()
        yield rows()

    parts = docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n long")
    return parts.where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", size: int = LEXICON) -> Lexicon:
    """The most frequent words of the corpus, at most ``size``, with their ids.

    A histogram of the counts in steps of a sixteenth of a power of two (some hundred rows) gives the least count
    that leaves no more than ``size`` words; only these reach the driver. The bound does not depend on the
    corpus. It decides what is looked up and what is merged, never what comes out.
    """
    counts = stored(word_counts(docs, text_col).where("n > 1"), "words")
    step = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, 1 << 30
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > size:
            break
        least = r["step"]
    top = counts.where(step >= least).collect()
    words: dict[bytes, np.ndarray] = {}
    for batch, ids, ends in encode_chunks(vocabulary, [r.word for r in top if not any(s in r.word for s in vocabulary.special)]):
        words.update((c.encode(), ids[a:b]) for c, a, b in zip(batch, ends[:-1], ends[1:]))
    return Lexicon.compile(words)


class Encoder:
    """Ids of texts: lexicon first, exact merging for the rest."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes] = {}
        self.special = {s: np.int32(i).tobytes() for s, i in vocabulary.special.items()}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        cut = [self.vocabulary.parts(t) for t in texts]
        cut = [[chunks(p) if i % 2 == 0 else p for i, p in enumerate(parts)] for parts in cut]
        new = list({c for parts in cut for p in parts[::2] for c in p}.difference(known))
        places = self.lexicon.find([c.encode() for c in new])
        offsets, ids = self.lexicon.offsets, self.lexicon.ids
        rest = []
        for chunk, place in zip(new, places.tolist()):
            if place < 0:
                rest.append(chunk)
            else:
                known[chunk] = ids[offsets[place] : offsets[place + 1]].tobytes()
        for batch, found, ends in encode_chunks(self.vocabulary, rest):
            raw, ends = found.tobytes(), (4 * ends).tolist()
            known.update((c, raw[a:b]) for c, a, b in zip(batch, ends, ends[1:]))
        out = []
        for parts in cut:
            got = [b"".join(map(known.__getitem__, p)) if i % 2 == 0 else self.special[p] for i, p in enumerate(parts)]
            out.append(np.frombuffer(b"".join(got), np.int32))
        for chunk in rest:
            if len(chunk) > LONGEST:
                del known[chunk]
        return out


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = LEXICON, decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids of every row's whole text without added tokens, and with ``decoded`` the text decoded from them.

    Returns ``doc_id, ids array<int>[, decoded string]`` and the columns in ``keep``, one row for each input row.
    A null text counts as empty: no ids, and the empty text. Special strings inside a text become their own ids.
    Null and repeated ids are kept; an empty table gives an empty result (and an empty lexicon); other
    columns are not read. Decoding joins the ids' tokens by one space, as a vocabulary file without a decoder says.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        raw = f.read()
    lexicon = build_lexicon(docs, Vocabulary(raw), text_col=text_col, size=lexicon_size)
    files = spark.sparkContext.broadcast((raw, lexicon.to_bytes()))  # both of bounded size
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep if c not in ("doc_id", "text")])
    kept = [f for f in rows.schema if f.name != "text"]

    def make():
        vocabulary = Vocabulary(files.value[0])
        work = Encoder(vocabulary, Lexicon.mapped(files.value[1]))
        token = vocabulary.tokens.__getitem__

        def run(part):
            ids = work(texts_of(part))
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            out = {f.name: ids_of(part, f.name) for f in kept}
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            if decoded:
                out["decoded"] = [" ".join(map(token, x.tolist())) for x in ids]
            return out

        return run

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return map_slices(rows, make, ", ".join([*fields, "ids array<int>", *["decoded string"] * decoded]))


@query("op6_bpe_codec")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
