"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import ids_of, map_slices, query, table, texts_of, uniform

#: Bytes of a window, values of a byte's embedding, widths of the filters and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: Windows in one matrix product: its inputs and outputs stay in the processor's cache.
BATCH = 64
#: Training sample: rows of a language, windows of a text, languages (the most frequent ones).
ROWS, WINDOWS, LANGUAGES = 1000, 3, 200

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_REACH = max(WIDTHS) - 1


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a whole text as bytes, and how many of its bytes each holds.

    A window also sees the next bytes as far as the widest filter reaches, so no n-gram is lost between two.
    """
    raw = text.lower().encode()
    n = max(1, -(-len(raw) // WINDOW))
    padded = np.zeros(n * WINDOW + _REACH, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    held = np.minimum(WINDOW, len(raw) - WINDOW * np.arange(n))
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + _REACH)[::WINDOW], held


class ByteNetwork:
    """Embedding, filters of several widths, maximum over positions, softmax.

    The filters of all widths are columns of one matrix over the widest span; rows beyond a filter's width stay 0.
    """

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        span = max(WIDTHS) * EMBED
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (span, FILTERS * len(WIDTHS))).astype(np.float32)
        self.mask = np.zeros_like(self.filters)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters *= self.mask
        self.bias = np.zeros(self.filters.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.filters.shape[1], classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def _spans(self, x: np.ndarray) -> np.ndarray:
        """Embedded bytes of each position and the next ones: (windows, WINDOW, span)."""
        e = self.embed[x].reshape(len(x), -1)
        return np.lib.stride_tricks.sliding_window_view(e, max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = np.ascontiguousarray(self._spans(x))
        return spans, (spans.reshape(-1, spans.shape[2]) @ self.filters).reshape(len(x), WINDOW, -1)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (windows, classes), a few windows at a time."""
        return np.concatenate([self._softmax(self._pooled(x[i : i + BATCH])[1].max(1)) for i in range(0, len(x), BATCH)])

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 12, rate: float = 0.004, seed: int = 11) -> ByteNetwork:
        """Adam on cross entropy with class weights; the gradient flows through each filter's best position."""
        rng = np.random.default_rng(seed)
        weight = len(y) / np.maximum(1, np.bincount(y, minlength=self.out.shape[1])) / self.out.shape[1]
        names = ("embed", "filters", "bias", "out", "out_bias")
        m, v, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for name, g in self._gradients(x[pick], y[pick], weight[y[pick]]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    change = rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - change).astype(np.float32))
        return self

    def _gradients(self, x, y, weight) -> dict[str, np.ndarray]:
        spans, conv = self._pooled(x)
        best = conv.argmax(1)  # (windows, filters)
        rows = np.arange(len(x))[:, None]
        pooled = np.take_along_axis(conv, best[:, None, :], 1)[:, 0]
        hidden = np.maximum(pooled + self.bias, 0)
        p = self._softmax(pooled)
        p[np.arange(len(y)), y] -= 1
        p *= (weight / len(y))[:, None]
        back = (p @ self.out.T) * (hidden > 0)
        chosen = spans[rows, best]  # (windows, filters, span)
        embed = np.zeros_like(self.embed)
        into = (back[:, :, None] * self.filters.T[None]).reshape(len(x), best.shape[1], max(WIDTHS), EMBED)
        codes = x[rows[:, :, None], best[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(embed, codes.reshape(-1), into.reshape(-1, EMBED))
        return {"embed": embed, "filters": np.einsum("bf,bfs->sf", back, chosen) * self.mask, "bias": back.sum(0), "out": hidden.T @ p, "out_bias": p.sum(0)}


def fold(id_col: Column) -> Column:
    """crc32 of the id's text modulo 4; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> tuple[list[str], ByteNetwork] | None:
    """Fit the network on about ``rows`` texts of each language, WINDOWS windows of each.

    The sample is taken by a hash of id and text, so it does not depend on the plan; its size does not
    grow with the table. Held-out rows (fold 2), null ids, languages and texts take no part. None if nothing is left.
    """
    usable = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    usable = usable.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, rows / r["count"]))])
    sample = usable.where(uniform(F.col("doc_id")) < share[F.col("lang")])

    def make():
        def cut(part):
            out = {"doc_id": [], "lang": [], "bytes": []}
            for key, text, lang in zip(ids_of(part).to_pylist(), texts_of(part), part.column(2).to_pylist()):
                if _LETTER.search(text):
                    all_, _ = windows(text)
                    for k in np.unique(np.linspace(0, len(all_) - 1, WINDOWS).astype(int)):
                        for name, value in zip(out, (key, lang, all_[k].tobytes())):
                            out[name].append(value)
            return out

        return cut

    found = sorted(map(tuple, map_slices(sample, make, "doc_id long, lang string, bytes binary").collect()))
    if not found:
        return None
    x = np.frombuffer(b"".join(bytes(r[2]) for r in found), np.uint8).reshape(len(found), -1)
    y = np.searchsorted(langs, [r[1] for r in found])
    return langs, ByteNetwork(len(langs)).fit(x, y)


def identify(docs: DataFrame, model: tuple[list[str], ByteNetwork] | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its whole text alone.

    The windows' probabilities are averaged by the bytes they hold. ``und`` with score 0 if the text is
    null or has no letter, or if there is no model. Null ids give held_out false; repeated rows are kept;
    an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some ten kB
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(fold(docs[id_col]) == 2, F.lit(False)).alias("held_out"), docs[text_col].alias("text"))

    def make():
        langs, network = sent.value or ([], None)

        def work(part):
            texts = texts_of(part)
            known = [i for i, t in enumerate(texts) if network is not None and _LETTER.search(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            pending, cut = [], 0
            for i in [*known, None]:
                if i is not None:
                    pending.append((i, *windows(texts[i])))
                    cut += len(pending[-1][2])
                if pending and (i is None or cut >= 4096):
                    p = network.predict(np.concatenate([w for _, w, _ in pending]))
                    at = 0
                    for k, w, held in pending:
                        mean = held @ p[at : at + len(w)] / held.sum()
                        at += len(w)
                        best = int(mean.argmax())
                        lang[k], score[k] = langs[best], min(1.0, float(mean[best]))
                    pending, cut = [], 0
            return {"doc_id": ids_of(part), "held_out": ids_of(part, "held_out"), "lang_pred": pa.array(lang), "score": score}

        return work

    return map_slices(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


@query("op3_language_cnn")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
