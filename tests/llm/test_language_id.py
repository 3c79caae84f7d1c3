import zlib

import numpy as np
import pytest

pytest.importorskip("foliomill.llm.language_id")
from foliomill.llm import language_id
from foliomill.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))
    known = got[got.held_out].merge(docs, on="doc_id")
    assert (known.lang_pred == known.lang).mean() > 0.97


def test_fast_states_equal_the_plain_recurrence():
    tagger = language_id.ByteTagger(["a", "b", "c"], hidden=5)
    steps = np.random.default_rng(0).integers(0, 256, (40, 7)).astype(np.uint8)
    assert np.abs(tagger.ahead.states(steps) - tagger.ahead.run(steps)[0]).max() < 1e-5


def test_backpropagation_equals_differences():
    tagger = language_id.ByteTagger(["a", "b"], hidden=3)
    groups = {"out": tagger.out, "ahead": tagger.ahead.p, "behind": tagger.behind.p}
    for group in groups.values():
        for name in group:
            group[name] = group[name].astype(np.float64)
    rng = np.random.default_rng(1)
    grid, mask, y = rng.integers(0, 4, (3, 6)).astype(np.uint8), rng.random((3, 6)) < 0.8, np.array([0, 1, 1])
    _, grads = tagger.gradients(grid, mask, y)
    for g, group in groups.items():
        for name, value in group.items():
            for i in list(np.ndindex(value.shape))[:40]:
                old = value[i]
                value[i] = old + 1e-3
                up, _ = tagger.gradients(grid, mask, y)
                value[i] = old - 1e-3
                down, _ = tagger.gradients(grid, mask, y)
                value[i] = old
                assert grads[g][name][i] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-4)


def plain_probabilities(tagger, text):
    """One text by plain loops: each byte's label from both directions within its window, then the mean."""
    k, total = tagger.ahead.hidden, np.zeros(len(tagger.languages))
    sigmoid = lambda a: 1 / (1 + np.exp(-a))

    def walk(layer, seen):
        h, out = np.zeros(k), []
        for b in seen:
            x, s = layer.p["E"][b].astype(float), h @ layer.p["U"].astype(float)
            z, r = sigmoid(x[:k] + s[:k]), sigmoid(x[k : 2 * k] + s[k : 2 * k])
            new = np.tanh(x[2 * k :] + r * s[2 * k :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    for begin in range(0, len(text), language_id.WINDOW):
        seen = [text[i] if 0 <= i < len(text) else 0 for i in range(begin - language_id.CONTEXT, begin + language_id.WINDOW + language_id.CONTEXT)]
        ahead, behind = walk(tagger.ahead, seen), walk(tagger.behind, seen[::-1])[::-1]
        for t in range(language_id.CONTEXT, language_id.CONTEXT + min(language_id.WINDOW, len(text) - begin)):
            e = np.exp(np.concatenate([ahead[t], behind[t]]) @ tagger.out["O"] + tagger.out["o"])
            total += e / e.sum()
    return total / max(len(text), 1)


def test_query_equals_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tagger = language_id.fit_language_id(docs.where(~language_id.held_out("doc_id", 4, 2)))
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, sf).collect()}
    for d in sorted(docs.collect(), key=lambda d: d.doc_id)[::20]:
        want = plain_probabilities(tagger, d.text.encode())
        assert got[d.doc_id].lang_pred == tagger.languages[int(want.argmax())] and got[d.doc_id].score == pytest.approx(want.max(), abs=1e-3)


def test_windows_label_every_byte_once():
    texts = [b"", b"x" * 5, b"y" * language_id.WINDOW, b"z" * 1000]
    grid, mask, owner = language_id.cut_windows(texts)
    assert [int(mask[owner == i].sum()) for i in range(4)] == [0, 5, language_id.WINDOW, 1000]
    assert all(set(grid[owner == i][mask[owner == i]]) == {texts[i][0]} for i in (1, 2, 3))


def test_edge_cases(spark):
    schema = "doc_id long, lang string, text string, score string"
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "en", "", "x"), (3, "en", "a b " * 20000, "x"), (3, "en", "a b " * 20000, "x"), (None, "fr", "12 !!", None)], schema)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify_languages(docs).collect()}
    assert (1, "und") in got and (2, "und") in got and (None, "und") in got and len(got) == 4
    unlabelled = docs.selectExpr("doc_id", "cast(null as string) lang", "text")
    assert {r.lang_pred for r in language_id.identify_languages(unlabelled).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0)).count() == 0
