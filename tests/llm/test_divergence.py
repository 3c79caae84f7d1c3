import math
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("foliomill.llm.divergence")
from foliomill.llm import divergence
from foliomill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeats = sum(any(0 <= j and j + 2 < len(words) and windows[tuple(words[j : j + 3])] > 1 for j in (i - 2, i - 1, i)) for i in range(len(words)))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeats, failed


def plain_js(p, q):
    sp, sq = sum(p), sum(q)
    total = 0.0
    for a, b in zip(p, q):
        a, b = a / sp, b / sq
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(total, 0))


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op3_divergence"](spark, sf).collect()}
    assert len(got) == len(docs)
    langs = {d.lang for d in docs}
    counts = {lang: Counter(w for d in docs if d.lang == lang for w in d.text.encode().lower().split()) for lang in langs}
    chars = {lang: sum(divergence.char_classes(d.text.encode()) for d in docs if d.lang == lang) for lang in langs}
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(d.text)
        top = sorted(counts[d.lang].items(), key=lambda x: (-x[1], x[0]))[:64]
        mine = Counter(d.text.encode().lower().split())
        hist = [mine[w] for w, _ in top]
        ref = [n for _, n in top]
        word_d = plain_js([*hist, r.n_words - sum(hist)], [*ref, sum(counts[d.lang].values()) - sum(ref)])
        char_d = plain_js(divergence.char_classes(d.text.encode())[2:].tolist(), chars[d.lang][2:].tolist())
        assert r.word_distance == pytest.approx(word_d, abs=1e-9) and r.char_distance == pytest.approx(char_d, abs=1e-9)
        n = math.sqrt(max(r.n_words, 1))
        far = (r.word_chars >= 200 and char_d > 0.22 + 1.3 / n) or (r.n_words >= 50 and word_d > 0.26 + 1.45 / n)
        assert r.kept == (not r.base_failed and not far)


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op3_divergence"](spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    got = got[~got.base_failed]
    assert got[got.quality == 1].kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.1


def test_random_texts_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", " ", "\n", "\x0b", "é ", "# "], rng.integers(0, 40)))
        words = text.encode().split()
        assert (divergence.duplicate_lines(text.encode()), divergence.repeated_window_words(words)) == base(text)[3:5]


def test_edge_cases(spark):
    schema = "doc_id long, lang string, text string, kept string"
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "en", "", "x"), (3, None, "the cat sat " * 4000, "x"), (3, None, "the cat sat " * 4000, "x"), (None, "xx", "a b", None)], schema)
    got = divergence.divergence_rules(docs).collect()
    assert len(got) == 5 and not any(r.kept for r in got) and sorted(r.n_words for r in got) == [0, 0, 2, 12000, 12000]
    assert divergence.divergence_rules(docs.limit(0)).count() == 0
