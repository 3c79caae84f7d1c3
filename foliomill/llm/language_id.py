"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a window from either side; a softmax over
both states labels every byte with a language, and a document's probabilities are the mean
over all its labelled bytes. Texts are read whole, in windows of ``WINDOW`` bytes, each
with ``CONTEXT`` bytes of its neighbours on both sides to warm up the states.

Training is plain numpy: backpropagation through time on windows of a bounded sample of
labelled documents (``sample`` documents chosen by a hash, at most ``sample_windows``
windows of each). Only letters and what stands between them matter; runs of digits and
symbols are read like any other byte.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without
labels every text is ``und``; with a single language all texts get it with score 1;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrow_text import slices, texts_as_bytes
from foliomill.llm.quality import held_out

WINDOW = 112
CONTEXT = 8
STEP = WINDOW + 2 * CONTEXT
BLOCK = 2048
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by window, mask of the bytes that a window labels, text of each window)."""
    grids, masks, owners = [], [], []
    for i, text in enumerate(texts):
        n = len(text)
        if not n:
            continue
        count = -(-n // WINDOW)
        padded = np.zeros(count * WINDOW + 2 * CONTEXT, np.uint8)
        padded[CONTEXT : CONTEXT + n] = np.frombuffer(text, np.uint8)
        grids.append(np.lib.stride_tricks.sliding_window_view(padded, STEP)[::WINDOW])
        owner = np.zeros((count, STEP), bool)
        owner[:, CONTEXT : CONTEXT + WINDOW] = True
        owner[-1, CONTEXT + n - (count - 1) * WINDOW :] = False
        masks.append(owner)
        owners.append(np.full(count, i))
    if not grids:
        return np.zeros((0, STEP), np.uint8), np.zeros((0, STEP), bool), np.zeros(0, np.int64)
    return np.concatenate(grids), np.concatenate(masks), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class GatedLayer:
    """One direction: z, r = sigmoid(gates), n = tanh(x + r * (h U)), h = (1 - z) n + z h."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.hidden = hidden
        self.p = {
            "E": (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32),
            "U": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        }

    def states(self, steps: np.ndarray) -> np.ndarray:
        """What ``run`` returns first, by contiguous in-place steps and without a trace."""
        k = self.hidden
        # a gate is 1 / (1 + exp(-a)) and tanh(a) is 2 / (1 + exp(-2 a)) - 1: the factors are taken into the weights
        scale = np.repeat(np.array([-1.0, -1.0, -2.0], np.float32), k)
        tables = [np.ascontiguousarray(x) for x in np.split(self.p["E"] * scale, 3, axis=1)]
        mats = [np.ascontiguousarray(x) for x in np.split(self.p["U"] * scale, 3, axis=1)]
        shape = (steps.shape[1], k)
        x, z, r, n, state = (np.zeros(shape, np.float32) for _ in range(5))
        out = np.empty((*steps.shape, k), np.float32)

        def open_gate(gate: np.ndarray, table: np.ndarray, column: np.ndarray) -> None:
            np.add(gate, np.take(table, column, 0, out=x, mode="clip"), out=gate)
            np.exp(gate, out=gate)
            np.add(gate, 1, out=gate)
            np.reciprocal(gate, out=gate)

        with np.errstate(over="ignore"):
            for t, column in enumerate(steps):
                for gate, mat in ((z, mats[0]), (r, mats[1]), (n, mats[2])):
                    np.matmul(state, mat, out=gate)
                open_gate(z, tables[0], column)
                open_gate(r, tables[1], column)
                n *= r
                open_gate(n, tables[2], column)
                n *= 2
                n -= 1
                state -= n
                state *= z
                state += n
                out[t] = state
        return out

    def run(self, steps: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step; ``steps`` is (time, windows)."""
        h2, table, u = 2 * self.hidden, self.p["E"], self.p["U"]
        state = np.zeros((steps.shape[1], self.hidden), np.float32)
        states, trace = np.empty((*steps.shape, self.hidden), np.float32), []
        for t, column in enumerate(steps):
            x, s = table[column], state @ u
            gates = _sigmoid(x[:, :h2] + s[:, :h2])
            z, r = gates[:, : self.hidden], gates[:, self.hidden :]
            new = np.tanh(x[:, h2:] + r * s[:, h2:])
            if keep:
                trace.append((state, z, r, new, s[:, h2:]))
            state = new + z * (state - new)
            states[t] = state
        return states, trace

    def back(self, steps: np.ndarray, trace: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the gradients of all states."""
        u, k = self.p["U"], self.hidden
        d_table, d_u, d_state = np.zeros_like(self.p["E"]), np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
        for t in range(len(steps) - 1, -1, -1):
            before, z, r, new, sn = trace[t]
            d_state = d_state + grad[t]
            d_new = d_state * (1 - z) * (1 - new**2)
            d_z = d_state * (before - new) * z * (1 - z)
            d_r = d_new * sn * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], 1)
            d_s = np.concatenate([d_z, d_r, d_new * r], 1)
            np.add.at(d_table, steps[t], d_x)
            d_u += before.T @ d_s
            d_state = d_state * z + d_s @ u.T
        return {"E": d_table, "U": d_u}


class ByteTagger:
    """Bidirectional network with a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = GatedLayer(hidden, rng), GatedLayer(hidden, rng)
        self.out = {"O": (rng.standard_normal((2 * hidden, len(languages))) * 0.2).astype(np.float32), "o": np.zeros(len(languages), np.float32)}

    def tag(self, grid: np.ndarray) -> np.ndarray:
        """Language probabilities of every byte: (languages, time, windows)."""
        k, steps = self.ahead.hidden, np.ascontiguousarray(grid.T)
        ahead, behind = self.ahead.states(steps), self.behind.states(steps[::-1])[::-1]
        # states lie within (-1, 1), so the sums are bounded and need no shift before exp
        e = ahead.reshape(-1, k) @ self.out["O"][:k] + np.ascontiguousarray(behind).reshape(-1, k) @ self.out["O"][k:] + self.out["o"]
        e = np.exp(np.clip(np.ascontiguousarray(e.T), -60, 60))
        return (e / e.sum(0)).reshape(-1, *steps.shape)

    def gradients(self, grid: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, dict[str, np.ndarray]]]:
        steps, k = np.ascontiguousarray(grid.T), self.ahead.hidden
        ahead, trace_a = self.ahead.run(steps, keep=True)
        behind, trace_b = self.behind.run(steps[::-1], keep=True)
        both = np.concatenate([ahead, behind[::-1]], 2)
        e = both @ self.out["O"] + self.out["o"]
        e = np.exp(e - e.max(2, keepdims=True))
        p = e / e.sum(2, keepdims=True)
        weight = mask.T[:, :, None] / max(1, mask.sum())
        loss = -float((np.log(p[:, np.arange(len(y)), y] + 1e-9) * weight[:, :, 0]).sum())
        p[:, np.arange(len(y)), y] -= 1
        d = (p * weight).astype(np.float32)
        d_both = d @ self.out["O"].T
        flat = both.reshape(-1, 2 * k)
        return loss, {
            "out": {"O": flat.T @ d.reshape(len(flat), -1), "o": d.sum((0, 1))},
            "ahead": self.ahead.back(steps, trace_a, d_both[:, :, :k]),
            "behind": self.behind.back(steps[::-1], trace_b, np.ascontiguousarray(d_both[::-1, :, k:])),
        }

    def fit(self, grid: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 96, rate: float = 0.02, seed: int = 11) -> ByteTagger:
        rng, m, v = np.random.default_rng(seed), {}, {}
        groups = {"out": self.out, "ahead": self.ahead.p, "behind": self.behind.p}
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(y), batch)
            _, grads = self.gradients(grid[chosen], mask[chosen], y[chosen])
            for group, found in grads.items():
                for name, g in found.items():
                    key = group, name
                    g = np.clip(g, -1, 1)
                    m[key] = 0.9 * m.get(key, 0) + 0.1 * g
                    v[key] = 0.99 * v.get(key, 0) + 0.01 * g**2
                    slow = rate * (1 - step / (steps + 1))
                    groups[group][name] -= (slow * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def fit_language_id(docs: DataFrame, sample: int = 4000, sample_windows: int = 6, **options) -> ByteTagger | None:
    """A tagger learned from (text, lang) of at most ``sample`` rows; None without any."""
    usable = docs.where("lang is not null and text is not null and text <> ''")
    # only ids are sorted for the sample; the texts of the few chosen follow by a join
    ids = usable.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = usable.select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), "doc_id")
    # of rows that share a doc_id the one with the smallest hash
    chosen = chosen.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("text", "lang")).alias("x")).select("x.lang", "x.text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows, masks = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                grid, mask, _ = cut_windows([text])
                spread = np.unique(np.linspace(0, len(grid) - 1, sample_windows).astype(int))
                langs += [lang] * len(spread)
                rows += [x.tobytes() for x in grid[spread]]
                masks += [x.tobytes() for x in mask[spread]]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary()), pa.array(masks, pa.binary())], names=["lang", "bytes", "mask"])

    rows = sorted(chosen.mapInArrow(cut, "lang string, bytes binary, mask binary").collect(), key=lambda r: (r.lang, bytes(r.bytes)))
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    grid = np.frombuffer(b"".join(r.bytes for r in rows), np.uint8).reshape(-1, STEP)
    mask = np.frombuffer(b"".join(r.mask for r in rows), bool).reshape(-1, STEP)
    y = np.array([languages.index(r.lang) for r in rows])
    tagger = ByteTagger(languages, **options)
    return tagger.fit(grid, mask, y) if len(languages) > 1 else tagger


def document_probabilities(tagger: ByteTagger, texts: list[bytes]) -> np.ndarray:
    """Mean of the byte labels of each text; zeros for an empty text."""
    grid, mask, owner = cut_windows(texts)
    total = np.zeros((len(texts), len(tagger.languages)))
    for at in range(0, len(grid), BLOCK):
        part = slice(at, at + BLOCK)
        labels = tagger.tag(grid[part]) * mask[part].T
        np.add.at(total, owner[part], labels.sum(1).T)
    return total / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def predict_language(docs: DataFrame, tagger: ByteTagger | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shipped.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                texts = texts_as_bytes(part.column(1))
                lettered = [LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
                if tagger is None:
                    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                else:
                    found = document_probabilities(tagger, texts)
                    best = found.argmax(1)
                    names = [tagger.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
                    scores = [float(min(1.0, max(0.0, row[b]))) if ok else 0.0 for row, b, ok in zip(found, best, lettered)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents; learned from those not held out."""
    out = held_out("doc_id", 4, 2)
    tagger = fit_language_id(docs.where(~out), **options)
    return predict_language(docs, tagger).select("doc_id", out.alias("held_out"), "lang_pred", "score")
