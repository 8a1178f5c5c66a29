"""Quality classifier by attention-based multiple-instance learning: passages, gated attention, one label a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import cut, documents, hash_spans, lean, limit_batches, utf8_view, word_spans

#: Bytes of a passage; the last one of a text is shorter.
PASSAGE = 400
#: Labelled documents of each class that the model is trained on, with all their passages.
TRAIN_DOCS = 1500
HIDDEN, GATE, STEPS, RATE = 16, 8, 200, 0.03
#: Score from which a document is predicted to have label 1.
THRESHOLD = 0.3

_PUNCTUATION = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_CLASS = np.full(256, 5, np.int64)  # 5: other control characters
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[_PUNCTUATION] = np.arange(6, 6 + len(_PUNCTUATION))
CLASSES = 6 + len(_PUNCTUATION)
FEATURES = CLASSES + 6


def passage_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one row of features a passage, passages of each text); an empty text is one passage.

    Features: roots of the shares of digits, cases, other letters, white space, control characters and each
    ASCII punctuation mark; and from the words that begin in the passage the share of distinct ones, their
    mean length, the share of capitalised ones, how many there are, how many bytes there are, and lines.
    """
    data, starts, ends, first = word_spans(texts, False)
    offsets = utf8_view(texts)[1]
    lengths = np.diff(offsets)
    per = np.maximum(1, -(-lengths // PASSAGE))
    base = np.cumsum(per) - per
    total = int(per.sum())

    def passage(at: np.ndarray) -> np.ndarray:
        text = np.searchsorted(offsets, at, side="right") - 1
        return base[text] + (at - offsets[text]) // PASSAGE

    of_byte = passage(np.arange(len(data))) if len(data) else np.zeros(0, np.int64)
    counts = np.bincount(of_byte * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES)
    size = np.maximum(counts.sum(1), 1)
    x = np.zeros((total, FEATURES), np.float32)
    x[:, :CLASSES] = np.sqrt(counts / size[:, None])
    of_word = passage(starts) if len(starts) else np.zeros(0, np.int64)
    words = np.bincount(of_word, minlength=total)
    n = np.maximum(words, 1)
    pairs = np.sort(np.rec.fromarrays([of_word, hash_spans(data, starts, ends)], names="p,h"), order=["p", "h"])
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs["p"][1:] != pairs["p"][:-1]) | (pairs["h"][1:] != pairs["h"][:-1])
    x[:, CLASSES] = np.where(words > 0, np.bincount(pairs["p"][new], minlength=total) / n, 1)
    x[:, CLASSES + 1] = np.bincount(of_word, ends - starts, minlength=total) / n / 10
    x[:, CLASSES + 2] = np.bincount(of_word, (data[starts] >= 65) & (data[starts] <= 90), minlength=total) / n
    x[:, CLASSES + 3] = np.log1p(words)
    x[:, CLASSES + 4] = np.log1p(counts.sum(1))
    x[:, CLASSES + 5] = np.sqrt(np.bincount(of_byte, data == 10, minlength=total) / size)
    return x, per


@dataclass
class AttentionModel:
    """Gated attention over passages; with `prior` alone where there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float | None = None

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.weights, np.cumsum(per) - per
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["w1"] + w["b1"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), per))
        a = e / np.repeat(np.add.reduceat(e, at), per)
        z = np.add.reduceat(a[:, None] * h, at)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "at": at}

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(per), self.prior)
        return self.forward(x, per)["p"]


def train(x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 3) -> AttentionModel:
    """Fit by Adam on the weighted log loss of document labels; passages have no labels of their own."""
    if not len(y) or y.min() == y.max():
        prior = float(y.mean()) if len(y) else 0.5
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), {}, prior)
    rng, f = np.random.default_rng(seed), x.shape[1]
    new = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"w1": new(f, HIDDEN), "b1": np.zeros(HIDDEN), "v": new(HIDDEN, GATE), "u": new(HIDDEN, GATE), "a": new(GATE), "c": new(HIDDEN), "b": np.zeros(1)}
    model = AttentionModel(x.mean(0), x.std(0) + 0.02, w)
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        r = model.forward(x, per)
        d = (r["p"] - y) * weight
        dz = d[:, None] * w["c"]
        dz_p = np.repeat(dz, per, axis=0)
        da = (dz_p * r["h"]).sum(1)
        de = r["a"] * (da - np.repeat(np.add.reduceat(r["a"] * da, r["at"]), per))
        dt, dg = de[:, None] * w["a"] * r["g"], de[:, None] * w["a"] * r["t"]
        dt, dg = dt * (1 - r["t"] ** 2), dg * r["g"] * (1 - r["g"])
        dh = (r["a"][:, None] * dz_p + dt @ w["v"].T + dg @ w["u"].T) * (1 - r["h"] ** 2)
        grad = {"w1": r["x"].T @ dh, "b1": dh.sum(0), "v": r["h"].T @ dt, "u": r["h"].T @ dg, "a": (r["t"] * r["g"]).T @ de, "c": r["z"].T @ d, "b": np.array([d.sum()])}
        for k, g in grad.items():
            g = g + 1e-4 * w[k]
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
            w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


@lean
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, per = passage_features(b.column("text"))
        at = np.cumsum(per) - per
        bags = [x[a : a + n].tobytes() for a, n in zip(at.tolist(), per.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; such rows are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> AttentionModel:
    """Learn from at most per_class labelled documents of each class, the first in order of a hash of doc_id.

    Only rows whose id is not held out count; rows with a null id or label are ignored. Each class weighs as
    much as it has rows among all that may be learned from.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out()).select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    sizes = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    order = (F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id"))
    sample = [usable.where(F.col("quality") == q).orderBy(*order).limit(per_class) for q in (0, 1)]
    sample = cut(sample[0].unionByName(sample[1]), "quality-sample")
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    bags = sorted((r.doc_id, r.quality, bytes(r.bag)) for r in rows.mapInArrow(_bags, "doc_id long, quality int, bag binary").collect())
    x = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in bags]
    y = np.array([r[1] for r in bags], np.float64)
    weight = np.array([sizes[q] / max(1, (y == q).sum()) for q in (0, 1)])[y.astype(int)] if len(y) and len(sizes) == 2 else np.ones(len(y))
    return train(np.concatenate(x).astype(np.float64) if x else np.zeros((0, FEATURES)), np.array([len(b) for b in x], np.int64), y, weight)


@lean
def _scores(batches: Iterator[pa.RecordBatch], model: AttentionModel) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, per = passage_features(b.column("text"))
        p = np.round(model.score(x, per), 9)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.astype(np.float64))], ["doc_id", "score"])


def attention_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Return (doc_id, held_out, score, predicted), one row for each row of docs.

    Every passage of the whole text is encoded; gated attention weighs the passages, and the score is the
    logistic of the weighted representation: higher where label 1 is likelier. It depends on the text alone.
    Null and empty texts are one passage without bytes. Without labels of both classes the score is the share
    of label 1, or 0.5. A null id counts as the empty text for held_out. Other columns are ignored.

    The model is some hundred numbers, trained on the driver from all passages of 2 * TRAIN_DOCS documents at
    most, about 180 bytes for each 400 of their text; scoring shuffles nothing.
    """
    limit_batches(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(lambda it: _scores(it, model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
