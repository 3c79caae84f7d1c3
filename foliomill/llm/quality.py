"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes. Every passage is encoded as a vector (shares
of character classes, hashed byte pairs, self-similarity at short lags), projected, and
weighted by gated attention: softmax over the bag of ``w . (tanh(h V) * sigmoid(h U))``.
The weighted sum of the projected passages gives the document's score. Only document
labels are needed; attention learns which passages they hang on.

The model is fitted on the driver with numpy, on a bounded sample of labelled documents
(``sample`` rows, chosen by a hash of doc_id); scoring runs over all whole texts in one
pass without a shuffle.

Edge cases: null and empty texts are a bag of one empty passage and get a score like any
other; labels that are null, or contradict each other for one doc_id, teach nothing;
without labels of both kinds the score is the share of label 1 (0.5 if there is none);
repeated rows get equal scores; other columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrow_text import let_go, slices, texts_as_bytes
from foliomill.llm.divergence import CLASS_OF, CLASSES

PASSAGE = 512
PART_BYTES = 1 << 19
PAIRS = 64
LAGS = range(2, 25)
WIDTH = CLASSES + PAIRS + len(LAGS) + 2


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text)."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    total = int(counts.sum())
    grid = np.zeros(total * PASSAGE, np.uint8)
    lengths = np.full(total, PASSAGE, np.int64)
    for t, s, c in zip(texts, starts, counts):
        grid[s * PASSAGE : s * PASSAGE + len(t)] = np.frombuffer(t, np.uint8)
        lengths[s + c - 1] = len(t) - (c - 1) * PASSAGE
    grid = grid.reshape(total, PASSAGE)
    inside = np.arange(PASSAGE) < lengths[:, None]
    out = np.zeros((total, WIDTH), np.float32)
    rows = np.arange(total)[:, None]
    share = np.maximum(lengths, 1)[:, None]
    kinds = np.bincount((rows * (CLASSES + 1) + np.where(inside, CLASS_OF[grid], CLASSES)).ravel(), minlength=total * (CLASSES + 1))
    out[:, :CLASSES] = np.sqrt(kinds.reshape(total, CLASSES + 1)[:, :CLASSES] / share)
    pair = (grid[:, :-1].astype(np.int32) * 37 + grid[:, 1:].astype(np.int32) * 101) % PAIRS
    pairs = np.bincount((rows * (PAIRS + 1) + np.where(inside[:, 1:], pair, PAIRS)).ravel(), minlength=total * (PAIRS + 1))
    out[:, CLASSES : CLASSES + PAIRS] = np.sqrt(pairs.reshape(total, PAIRS + 1)[:, :PAIRS] / share)
    at = CLASSES + PAIRS
    for i, lag in enumerate(LAGS):
        same = (grid[:, lag:] == grid[:, :-lag]) & inside[:, lag:]
        out[:, at + i] = same.sum(1) / np.maximum(lengths - lag, 1)
    out[:, -2] = out[:, at : at + len(LAGS)].max(1)
    out[:, -1] = np.log1p(lengths) / np.log1p(PASSAGE)
    return out, starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class GatedAttention:
    """Gated attention pooling over bags of passage vectors, with hand-written gradients."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"W": init(width, hidden), "b": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        counts = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return _sigmoid(z @ p["c"] + p["d"][0]), {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "counts": counts}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (score, k) = self.p, self.forward(x, starts)
        err = ((score - y) / len(y)).astype(np.float32)
        dz = err[:, None] * p["c"]
        dz_each = np.repeat(dz, k["counts"], axis=0)
        da = (dz_each * k["h"]).sum(1)
        mean_da = np.add.reduceat(da * k["a"], starts)
        de = k["a"] * (da - np.repeat(mean_da, k["counts"]))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * k["g"] * (1 - k["t"] ** 2), dtg * k["t"] * k["g"] * (1 - k["g"])
        dh = dz_each * k["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - k["h"] ** 2)
        return {"W": k["x"].T @ dpre, "b": dpre.sum(0), "V": k["h"].T @ dt, "U": k["h"].T @ dg, "w": (k["t"] * k["g"]).T @ de, "c": k["z"].T @ err, "d": err.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 3000, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        rng, m, v = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(bags), min(batch, len(bags)))
            part = [bags[i] for i in chosen]
            starts = np.cumsum([0, *map(len, part[:-1])])
            for name, grad in self.gradients(np.concatenate(part), starts, labels[chosen].astype(np.float32)).items():
                grad = grad + decay * self.p[name]
                m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                v[name] = 0.999 * v.get(name, 0) + 0.001 * grad**2
                slow = rate * (1 - step / (steps + 1))
                self.p[name] = (self.p[name] - slow * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 5000, sample_passages: int = 200) -> GatedAttention | float:
    """The model, or the share of label 1 where the labels of the sample are of one kind.

    ``labels`` holds doc_id and quality of the rows to learn from. At most ``sample`` of
    them are used, and of a longer text ``sample_passages`` passages evenly spread over it,
    so that the training set is bounded; scoring has no such bounds. Of rows that share a
    doc_id the text with the smallest hash is used.
    """
    agreed = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("low").cast("double").alias("quality"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, PART_BYTES):
                x, starts = encode_passages(texts_as_bytes(part.column(1)))
                bags = np.split(x, starts[1:])
                bags = [bag[np.unique(np.linspace(0, len(bag) - 1, sample_passages).astype(int))] if len(bag) > sample_passages else bag for bag in bags]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([bag.tobytes() for bag in bags], pa.binary())], names=["doc_id", "quality", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(texts.select("doc_id", "text", "quality").mapInArrow(encode, f"doc_id {kind}, quality double, bag binary").collect(), key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return GatedAttention(WIDTH).fit([np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH) for r in rows], y)


def score_quality(docs: DataFrame, model: GatedAttention | float) -> DataFrame:
    """(doc_id, score) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = shipped.value
        for batch in batches:
            for part in slices(batch, 1, PART_BYTES):
                texts = texts_as_bytes(part.column(1))
                if isinstance(model, float):
                    found = np.full(len(texts), model)
                else:
                    found = model.forward(*encode_passages(texts))[0].astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(found, 0.0, 1.0), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds`` (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents; learned from the labels not held out."""
    model = fit_quality(docs, labels.where(~held_out()), **options)
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
