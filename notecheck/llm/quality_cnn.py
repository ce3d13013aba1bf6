"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are embedded, `filters` learnt filters of `width` bytes slide over them in steps of two, and the largest
response of each filter is kept for every chunk. Chunks of `chunk` bytes overlap by half and cover the whole text. A hidden
layer turns a chunk's responses into a logit; the mean over a text's chunks, calibrated on the labels, gives the probability.

At most `per_class` labelled documents of each class are drawn by a hash of doc_id, whatever the table. One of `kept_back` of them is not
trained on: its whole text's logit calibrates. The network is fitted on the driver on `sample_chunks` chunks of each of the others (evenly
spaced over the text). Seeds are fixed, so reruns agree. Class shares are counted over all labelled rows of the training part.
A very long text is scored in blocks, all its chunks counting alike; of filter responses that tie the first wins in training, and ties of
score have no order to keep.

Nulls and edges: a null or empty text has no chunks and scores as a text with logit 0, calibrated; a null doc_id is never held
out and never labelled; rows whose label is null are not used; with no labels, or one class alone, every score is the smoothed
share of class 1; repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

STRIDE = 2


@dataclass(frozen=True)
class CnnParams:
    folds: int = 5
    per_class: int = 1900
    kept_back: int = 5  # one of so many sampled documents calibrates
    sample_chunks: int = 3
    chunk: int = 512
    width: int = 8
    dims: int = 6
    filters: int = 24
    hidden: int = 16
    epochs: int = 8
    rate: float = 0.01
    seed: int = 11
    threshold: float = 0.3


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _raw(text: object) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if isinstance(text, str) else np.empty(0, np.uint8)


def sample_of(raw: np.ndarray, chunk: int, most: int) -> list[bytes]:
    """At most `most` chunks, evenly spaced from the first to the last byte."""
    n = len(raw)
    if not n:
        return []
    starts = np.unique(np.linspace(0, max(0, n - chunk), most).astype(int))
    return [raw[s : s + chunk].tobytes() for s in starts]


class ByteCnn:
    """E (256, dims), W (width * dims, filters), hidden layer H, output o; a, b calibrate the mean logit."""

    def __init__(self, params: CnnParams):
        rng = np.random.default_rng(params.seed)
        self.p = params
        self.E = rng.normal(0, 0.5, (256, params.dims)).astype(np.float32)
        self.W = rng.normal(0, (params.width * params.dims) ** -0.5, (params.width * params.dims, params.filters)).astype(np.float32)
        self.c = np.zeros(params.filters, np.float32)
        self.H = rng.normal(0, params.filters**-0.5, (params.filters, params.hidden)).astype(np.float32)
        self.d = np.zeros(params.hidden, np.float32)
        self.o = rng.normal(0, params.hidden**-0.5, params.hidden).astype(np.float32)
        self.e = np.zeros(1, np.float32)
        self.a, self.b = 1.0, 0.0
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {k: None if k == "_tables" else v for k, v in self.__dict__.items()}

    def fit(self, chunks: list[bytes], labels: np.ndarray) -> None:
        """Adam on the cross-entropy of chunks; gradients pass through the position that won each maximum."""
        p, rng = self.p, np.random.default_rng(self.p.seed + 1)
        length = max(p.width + STRIDE, p.chunk)
        data = np.zeros((len(chunks), length), np.uint8)
        for i, x in enumerate(chunks):
            data[i, : len(x)] = np.frombuffer(x, np.uint8)
        sizes = np.array([max(1, -(-(len(x) - p.width + 1) // STRIDE)) for x in chunks])
        at = np.arange(0, length - p.width + 1, STRIDE)
        names = ["E", "W", "c", "H", "d", "o", "e"]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for _ in range(p.epochs):
            order = rng.permutation(len(chunks))
            for k in range(0, len(order), 64):
                pick = order[k : k + 64]
                n = len(pick)
                seen = data[pick]
                idx = at[:, None] + np.arange(p.width)
                grams = seen[:, idx]  # n, positions, width
                x = self.E[grams].reshape(n, len(at), -1)
                y = x @ self.W + self.c
                y[np.arange(len(at))[None, :] >= sizes[pick][:, None]] = -np.inf
                won = y.argmax(1)  # n, filters
                top = np.take_along_axis(y, won[:, None], 1)[:, 0]
                pooled = np.maximum(top, 0)
                hidden = np.maximum(pooled @ self.H + self.d, 0)
                z = hidden @ self.o + self.e
                g = (1 / (1 + np.exp(-z)) - labels[pick]) / n
                grad = {"o": hidden.T @ g, "e": np.array([g.sum()], np.float32)}
                gh = np.outer(g, self.o) * (hidden > 0)
                grad["H"], grad["d"] = pooled.T @ gh, gh.sum(0)
                gp = (gh @ self.H.T) * (top > 0)
                xw = x[np.arange(n)[:, None], won]  # n, filters, width * dims
                grad["W"], grad["c"] = np.einsum("nf,nfk->kf", gp, xw), gp.sum(0)
                gx = (gp[:, :, None] * self.W.T[None]).reshape(n, p.filters, p.width, p.dims)
                ge = np.zeros_like(self.E)
                np.add.at(ge, grams[np.arange(n)[:, None], won].reshape(-1), gx.reshape(-1, p.dims))
                grad["E"] = ge
                t += 1
                for q in names:
                    m[q] = 0.9 * m[q] + 0.1 * grad[q]
                    v[q] = 0.999 * v[q] + 0.001 * grad[q] ** 2
                    getattr(self, q)[...] -= (p.rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)

    def _lookup(self) -> list[np.ndarray]:
        """Per pair of positions in the filter, the response to each pair of bytes: a gather replaces the products."""
        if self._tables is None:
            d = self.p.dims
            one = [self.E @ self.W[j * d : (j + 1) * d] for j in range(self.p.width)]
            self._tables = [(one[j][None, :, :] + one[j + 1][:, None, :]).reshape(65536, -1) for j in range(0, self.p.width, 2)]
        return self._tables

    def logit(self, text: object) -> float:
        """Mean logit over all overlapping chunks of a text."""
        raw = _raw(text)
        p, half = self.p, self.p.chunk // 2
        if not len(raw):
            return 0.0
        if len(raw) < p.width + 1:
            raw = np.concatenate((raw, np.zeros(p.width + 1 - len(raw), np.uint8)))
        tables, tops = self._lookup(), []
        block = half * 64
        for lo in range(0, len(raw), block):  # blocks bound the memory that a long text takes
            part = raw[lo : lo + block + p.width]
            n = -(-(min(len(part), block + p.width - 1) - p.width + 1) // STRIDE)
            if n <= 0:
                break
            even = np.zeros(2 * (n + p.width // 2), np.uint8)
            even[: min(len(part), len(even))] = part[: len(even)]
            pairs = even.view("<u2")
            y = tables[0][pairs[:n]]
            for j in range(1, len(tables)):
                y += tables[j][pairs[j : j + n]]
            tops.append(np.maximum.reduceat(y, np.arange(0, n, half // STRIDE), axis=0))
        top = np.concatenate(tops)
        if len(top) > 1:
            top = np.maximum(top[:-1], top[1:])
        hidden = np.maximum(np.maximum(top + self.c, 0) @ self.H + self.d, 0)
        return float((hidden @ self.o + self.e).mean())

    def probability(self, text: object) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.logit(text) + self.b, -30, 30))))


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one variable, by Newton steps with a small ridge."""
    x = np.stack([logits, np.ones_like(logits)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-2, 0.0])
        g = x.T @ (weights * (q - labels)) + ridge * (w - [1, 0])
        h = (x * (weights * q * (1 - q))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def labelled(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """doc_id and label (0 or 1) of the training part, one row per document (its largest label)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(folds, fold))
    return rows.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))


def bounded_sample(documents: DataFrame, known: DataFrame, per_class: int, seed: int) -> DataFrame:
    """doc_id, label, text of at most per_class documents of each class, chosen by a hash of doc_id; the choice is broadcast (2 * per_class rows).

    Of rows that repeat a doc_id the least text stands for all.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = known.where("label = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("label = 0").orderBy(order, "doc_id").limit(per_class))
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(documents: DataFrame, labels: DataFrame, params: CnnParams = CnnParams()) -> ByteCnn | float:
    """The fitted network; where there are not both classes, the smoothed share of class 1."""
    known = labelled(labels, "quality", params.folds, 0)
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return share
    most, chunk = params.sample_chunks, params.chunk
    kept_back = F.pmod(F.xxhash64("doc_id", F.lit(params.seed + 1)), F.lit(params.kept_back)) == 0
    sample = materialize(bounded_sample(documents, known, params.per_class, params.seed).withColumn("kept_back", kept_back), "cnn-sample")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, y, x) for i, y, t in zip(b["doc_id"], b["label"], b["text"], strict=True) for x in sample_of(_raw(t), chunk, most)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "chunk"])

    drawn = sample.where("not kept_back").mapInPandas(cut, "doc_id long, label int, chunk binary").collect()
    drawn.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    if len({r[1] for r in drawn}) < 2:
        return share
    model = ByteCnn(params)
    model.fit([bytes(r[2]) for r in drawn], np.array([r[1] for r in drawn], np.float32))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(int(y), model.logit(t)) for y, t in zip(b["label"], b["text"], strict=True)], columns=["label", "logit"])

    judged = sorted(tuple(r) for r in sample.where("kept_back").mapInPandas(judge, "label int, logit double").collect())
    y, logits = np.array([r[0] for r in judged], float), np.array([r[1] for r in judged], float)
    if len(set(y)) == 2:  # too few labels to keep any back: uncalibrated
        model.a, model.b = calibrate(logits, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def score_column(model: ByteCnn | float, text: Column) -> Column:
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.probability(t) for t in b], dtype="float64")

    return score(text)


def score_quality(documents: DataFrame, labels: DataFrame, params: CnnParams = CnnParams()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents."""
    model = train(documents, labels, params)
    out = documents.select("doc_id", held_out(params.folds, 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def keep_quality(documents: DataFrame, labels: DataFrame, params: CnnParams = CnnParams()) -> DataFrame:
    """The rows of documents that are not rejected, all their columns as they were."""
    model = train(documents, labels, params)
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), score_column(model, F.col("text")).alias("__score"))
    return row.where(F.col("__score") >= params.threshold).select("__row.*")
