import zlib

import numpy as np
import pytest

pytest.importorskip("foliomill.llm.quality")
from foliomill.llm import quality
from foliomill.llm.queries import QUERIES


def test_held_out_accuracy_and_bounds(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality"](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    known = got[got.held_out].merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    assert (known.predicted == known.quality).mean() > 0.95


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = quality.GatedAttention(6, hidden=4, gate=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, starts, y = rng.standard_normal((9, 6)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, starts)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = model.gradients(x, starts, y)
    for name, value in model.p.items():
        for i in np.ndindex(value.shape):
            old = value[i]
            value[i] = old + 1e-5
            up = loss()
            value[i] = old - 1e-5
            down = loss()
            value[i] = old
            assert grads[name][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_attention_finds_the_bad_passage_of_a_long_text(spark):
    rng = np.random.default_rng(1)
    words = ["lan", "tor", "mi", "esta", "wen", "os", "dun"]
    prose = lambda n: " ".join(rng.choice(words, n)) + "."
    rows = [(i, prose(400) + (" %%% ### $$$" * 60 if i % 2 else "") + prose(300), 1 - i % 2) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = quality.classify_quality(docs, labels).toPandas()
    assert ((got.predicted == 1) == (got.doc_id % 2 == 0)).mean() > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b " * 30000, "x"), (3, "a b " * 30000, "x"), (None, "c", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify_quality(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (3, 1), (3, 0), (None, 1), (4, 1)], "doc_id long, quality int")
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify_quality(docs.limit(0), labels).count() == 0


def plain_score(model, text):
    """One document by plain loops: features of each passage, attention over passages, weighted sum."""
    p, passages = model.p, [text[i : i + quality.PASSAGE] for i in range(0, max(1, len(text)), quality.PASSAGE)]
    hidden, energy = [], []
    for passage in passages:
        n = len(passage)
        x = np.zeros(quality.WIDTH)
        for b in passage:
            x[quality.CLASS_OF[b]] += 1
        x[: quality.CLASSES] = np.sqrt(x[: quality.CLASSES] / max(n, 1))
        pairs = np.zeros(quality.PAIRS)
        for a, b in zip(passage, passage[1:]):
            pairs[(a * 37 + b * 101) % quality.PAIRS] += 1
        x[quality.CLASSES : quality.CLASSES + quality.PAIRS] = np.sqrt(pairs / max(n, 1))
        lags = [sum(a == b for a, b in zip(passage, passage[lag:])) / max(n - lag, 1) for lag in quality.LAGS]
        x[quality.CLASSES + quality.PAIRS : -2] = lags
        x[-2], x[-1] = max(lags), np.log1p(n) / np.log1p(quality.PASSAGE)
        h = np.tanh(((x - model.mean) / model.scale) @ p["W"] + p["b"])
        energy.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        hidden.append(h)
    weights = [np.exp(e - max(energy)) for e in energy]
    z = sum(w * h for w, h in zip(weights, hidden)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))


def test_query_equals_plain_loops(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels.where(~quality.held_out()))
    got = {r.doc_id: r.score for r in QUERIES["op1_quality"](spark, sf).collect()}
    for d in sorted(docs.collect(), key=lambda d: d.doc_id)[::3]:
        assert got[d.doc_id] == pytest.approx(plain_score(model, (d.text or "").encode()), abs=2e-4)


def test_long_documents_teach_and_repeated_ids_teach_the_same(spark):
    rows = [(i, ("good prose stands here. " if i % 2 else "zzz 000 ### ") * 12_000, "x") for i in range(6)] + [(0, "other text", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id int, quality int")
    a, b = (quality.fit_quality(d, labels) for d in (docs, docs.repartition(3, "text")))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs.where("text <> 'other text'"), a).collect()}
    assert min(scores[i] for i in (1, 3, 5)) > max(scores[i] for i in (2, 4))
