"""Quality classification by co-training: a view of the text and a view of the metadata teach each other."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import query, table, uniform

#: Rows of the fitting sample: labelled documents, and documents without a label.
LABELLED, UNLABELLED = 20_000, 10_000
#: Rows of a step of the fit in full precision.
BLOCK = 2048
#: Rounds, pseudo-labels of a round as a share of the unlabelled rows, confidence they need, share of the labelled rows kept for calibration.
ROUNDS, SHARE, CONFIDENT, HELD = 5, 0.1, 0.95, 0.25

_SOURCES, _LANGS, _LENGTHS = 64, 16, 24


def text_view(texts) -> np.ndarray:
    """Features of whole texts: shares of the printable bytes, length, and how much words and lines repeat."""
    out = np.zeros((len(texts), 95 + 12), np.float32)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if not raw:
            continue
        n = len(raw)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
        known = len(set(words))
        out[i, :95] = np.sqrt(counts[32:127] / n)
        out[i, 95:] = (
            np.log1p(n),
            letters / n,
            counts[65:91].sum() / max(1, letters),
            counts[48:58].sum() / n,
            counts[128:].sum() / n,
            np.log1p(known) / np.log(len(words) + 2.0),
            known / max(1, len(words)),
            len(set(lines)) / len(lines),
            n / max(1, len(words)) / 20,
            repeats := sum(map(eq, words, words[1:])) / max(1, len(words)),
            np.sqrt(repeats),
            np.sqrt((counts[33:39].sum() + counts[42:44].sum() + counts[124]) / n),
        )
    return out


def metadata_view(sources, langs, sizes) -> np.ndarray:
    """Features beside the text: source and language by hash, length by powers of two."""
    out = np.zeros((len(sources), _SOURCES + _LANGS + _LENGTHS + 3), np.float32)
    for i, (source, lang, size) in enumerate(zip(sources, langs, sizes)):
        for at, value, width in ((0, source, _SOURCES), (_SOURCES, lang, _LANGS)):
            if isinstance(value, str):
                out[i, at + zlib.crc32(value.encode()) % width] = 1
            else:
                out[i, -1 - (at > 0)] = 1
        if size is None or size != size or size < 0:
            out[i, -3] = 1
        else:
            out[i, _SOURCES + _LANGS + min(_LENGTHS - 1, int(size).bit_length())] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton steps until they vanish."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean = x.mean(0, dtype=np.float64)
        blocks = [slice(at, at + BLOCK) for at in range(0, len(x), BLOCK)]  # only one block is held in full precision
        scale = np.sqrt(sum(((x[b] - mean) ** 2).sum(0) for b in blocks) / len(x))
        scale[scale < 1e-9] = 1.0
        n = x.shape[1] + 1
        penalty = np.full(n, ridge)
        penalty[-1] = 1e-6
        w = np.zeros(n)
        value = np.inf

        def standard(b: slice) -> np.ndarray:
            part = x[b]
            return np.c_[(part - mean) / scale, np.ones(len(part))]

        while True:
            curve, slope = np.diag(penalty), penalty * w
            for b in blocks:
                z = standard(b)
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                curve = curve + (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
                slope = slope + z.T @ (p - y[b])
            step = np.linalg.solve(curve, slope)
            size = 1.0
            while True:  # halve a step that does not lower the loss
                new = w - size * step
                loss = sum(np.logaddexp(0, -(2 * y[b] - 1) * (standard(b) @ new)).sum() for b in blocks) + 0.5 * (penalty * new**2).sum()
                if loss <= value or size < 1e-4:
                    break
                size /= 2
            if not value - loss >= 1e-6 * max(1.0, abs(loss)):  # also where a loss is no number
                return cls(mean, scale, w[:-1], float(w[-1]))
            w, value = new, loss

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -30, 30)


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


@dataclass
class Quality:
    """Both views, their calibrations and the weights of the joint score."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    joint: Logistic
    pseudo: tuple[int, int]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale.logit(self.text.logit(text)[:, None])
        b = self.meta_scale.logit(self.meta.logit(meta)[:, None])
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.joint.logit(np.c_[a, b]))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, free_text: np.ndarray, free_meta: np.ndarray, rounds: int = ROUNDS) -> Quality:
    """Fit both views. Rows in ``held`` are only used to calibrate; ``free_*`` are the rows without a label.

    In each round each view labels the free rows it is surest of, as many of each class as the known
    shares allow, and the other view learns from them. A view that is never sure teaches nothing.
    """
    views, free = (text[~held], meta[~held]), (free_text, free_meta)
    known = y[~held]
    taught: list[dict[int, int]] = [{}, {}]  # free row -> label, for the text view and the metadata view

    def fitted(v: int) -> Logistic:
        rows = np.fromiter(taught[v], int, len(taught[v]))
        return Logistic.fit(np.r_[views[v], free[v][rows]], np.r_[known, np.fromiter(taught[v].values(), float, len(rows))])

    models = [fitted(0), fitted(1)]
    for _ in range(rounds):
        for v in (0, 1):
            p = _sigmoid(models[v].logit(free[v])) if len(free[v]) else np.zeros(0)
            for label, sure in ((1, p), (0, 1 - p)):
                share = known.mean() if label else 1 - known.mean()
                take = int(np.ceil(SHARE * len(p) * share))
                order = [i for i in np.argsort(-sure, kind="stable") if i not in taught[1 - v]][:take]
                taught[1 - v].update((int(i), label) for i in order if sure[i] >= CONFIDENT)
        models = [fitted(0), fitted(1)]
    a, b, target = models[0].logit(text[held]), models[1].logit(meta[held]), y[held]
    scales = Logistic.fit(a[:, None], target), Logistic.fit(b[:, None], target)
    both = np.c_[scales[0].logit(a[:, None]), scales[1].logit(b[:, None])]
    joint = Logistic.fit(both, target)
    if joint.weight.min() < 0:  # a calibrated view that points the wrong way is noise: it is left out
        joint = Logistic.fit(both * (joint.weight > 0), target)
    return Quality(*models, *scales, joint, (len(taught[0]), len(taught[1])))


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Quality | float | None:
    """Fit on about ``labelled`` labelled and ``unlabelled`` other documents, taken by a hash of their ids.

    Both bounds are parameters and do not grow with the tables. Labels that are null or contradict each other
    are left out. With labels of one class only the result is that class (1.0 or 0.0), without any it is None.
    """
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top")).where("y = top")
    n_labels, n_docs = labels.count(), docs.count()
    if not n_labels or not n_docs:
        return None
    chosen = labels.where(uniform(F.col("doc_id"), F.lit("labelled")) < min(1.0, labelled / n_labels)).select(F.col("doc_id").alias("of_doc"), "y")
    pick = uniform(F.col("doc_id"), F.lit("free")) < min(1.0, unlabelled / n_docs)
    sample = (
        docs.select("doc_id", "text", "source", "lang", "n_chars")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("of_doc"), "left")  # some 20,000 pairs of numbers
        .where(F.col("doc_id").isNotNull() & (F.col("y").isNotNull() | pick))
    )
    held = uniform(F.col("doc_id"), F.lit("held")) < HELD
    rows = sample.select("doc_id", F.col("y").cast("double").alias("y"), held.alias("held"), _views()("text", "source", "lang", "n_chars").alias("v")).select("doc_id", "y", "held", "v.*").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.text, r.meta))
    text, meta = (np.frombuffer(b"".join(r[k] for r in rows), np.float32).reshape(len(rows), -1) for k in ("text", "meta"))
    has = np.array([r.y is not None for r in rows])
    y, held = np.array([r.y or 0.0 for r in rows]), np.array([r.held for r in rows])
    del rows  # the arrays are all that is needed
    if not has.any():
        return None
    if len(set(y[has])) < 2:
        return float(y[has][0])
    if len(set(y[has & held])) < 2 or len(set(y[has & ~held])) < 2:  # too few for a part of their own
        x, target = np.r_[text[has], text[has]], np.r_[y[has], y[has]]
        both = np.arange(len(x)) >= has.sum()
        return cotrain(x, np.r_[meta[has], meta[has]], target, both, text[~has], meta[~has])
    return cotrain(text[has], meta[has], y[has], held[has], text[~has], meta[~has])


def _views():
    @F.pandas_udf("text binary, meta binary")
    def views(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        a, b = text_view(text.tolist()), metadata_view(source.tolist(), lang.tolist(), size.tolist())
        return pd.DataFrame({"text": [x.tobytes() for x in a], "meta": [x.tobytes() for x in b]})

    return views


def score(docs: DataFrame, model: Quality | float | None, *, into: str = "quality") -> DataFrame:
    """``docs`` with a struct ``into``: ``p_text, p_meta, score, keep`` (score of 0.5 or more).

    An empty or null text scores 0 and is not kept. Without a model scores are null and everything is kept; a
    model of one class gives that class. All rows and columns stay, also repeated ones and those with null ids;
    null metadata is a value of its own. ``into`` must be a name that ``docs`` does not have.
    """
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    if model is None or isinstance(model, float):
        p = F.lit(model).cast("double")
        fixed = F.when(empty, F.lit(0.0)).otherwise(p)
        return docs.withColumn(into, F.struct(fixed.alias("p_text"), fixed.alias("p_meta"), fixed.alias("score"), F.coalesce(fixed >= 0.5, F.lit(True)).alias("keep")))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    @F.pandas_udf("p_text double, p_meta double, score double, keep boolean")
    def scored(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(text), 1024):
            t, s, l, n = (c.iloc[at : at + 1024].tolist() for c in (text, source, lang, size))
            a, b, p = sent.value.scores(text_view(t), metadata_view(s, l, n))
            void = np.array([not (x or "").strip(" ") for x in t])
            parts.append(pd.DataFrame({"p_text": np.where(void, 0.0, a), "p_meta": np.where(void, 0.0, b), "score": np.where(void, 0.0, p)}))
        out = pd.concat(parts) if parts else pd.DataFrame({"p_text": [], "p_meta": [], "score": []}, dtype=float)
        return out.assign(keep=out["score"] >= 0.5)

    return docs.withColumn(into, scored("text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")))


@query("op9_quality_cotraining")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected."""
    rated = score(docs, fit(docs, table(spark, sf_dir, "labels")), into="_quality")
    return rated.where("_quality.keep").drop("_quality")
