import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("foliomill.llm.lattice_lm")
from foliomill.llm import lattice_lm
from foliomill.llm.queries import QUERIES

PIECES = [("</s>", 0.0)] + [(p, -float(i)) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"])] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]


def segmentations(text, pieces):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        if text[:i] in pieces:
            for rest in segmentations(text[i:], pieces):
                yield [text[:i], *rest]
        elif i == 1:
            for rest in segmentations(text[1:], pieces):
                yield [*(f"<0x{b:02X}>" for b in text[0].encode()), *rest]


def test_marginals_and_expected_counts_equal_enumeration():
    trie = lattice_lm.PieceTrie(PIECES)
    log_p, ids = np.log(trie.prior), {p: i for i, (p, _) in enumerate(PIECES)}
    words, times = ["", "a", "abab", "bé", "ababab", "日a", "bbab"], np.array([1, 2, 3, 1, 2, 5, 1])
    got, counts = lattice_lm.word_log_probabilities(trie, log_p, words), np.zeros(len(PIECES))
    for w, t, g in zip(words, times, got):
        paths = [[ids[p] for p in s] for s in segmentations("▁" + w, {p for p, _ in PIECES})]
        weights = [math.exp(sum(log_p[i] for i in s)) for s in paths]
        assert g == pytest.approx(math.log(sum(weights)))
        for s, x in zip(paths, weights):
            for i in s:
                counts[i] += t * x / sum(weights)
    assert lattice_lm.expected_counts(trie, log_p, words, times) == pytest.approx(counts)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op2_lattice_lm"](spark, sf).collect()}
    tokens = {d.doc_id: [m[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))] + [None] for d in docs}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(t for d, ts in tokens.items() if not out[d] for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    trie = lattice_lm.PieceTrie(lattice_lm.read_vocabulary())
    train = [t for t in counts if t is not None]
    uses = lattice_lm.expected_counts(trie, np.log(trie.prior), train, np.array([counts[t] for t in train]))
    uses[trie.end_id] += counts[None]
    log_p = np.log((uses + trie.size * trie.prior) / (uses.sum() + trie.size * trie.prior.sum()))
    every = sorted({t for ts in tokens.values() for t in ts if t is not None})
    word_p = dict(zip(every, lattice_lm.word_log_probabilities(trie, log_p, every)))
    prior_p = dict(zip(every, lattice_lm.word_log_probabilities(trie, np.log(trie.prior), every)))
    assert len(got) == len(docs)
    for d, ts in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(ts), sum(counts[t] > 0 for t in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in ts), rel=1e-9)
        assert r.score == pytest.approx((sum(word_p[t] for t in ts[:-1]) + log_p[trie.end_id]) / math.log(10), rel=1e-9)
        # the vocabulary's own weights, without the refit, in single precision
        assert r.prior_score == pytest.approx((sum(prior_p[t] for t in ts[:-1]) + np.log(trie.prior[trie.end_id])) / math.log(10), rel=1e-6)


def test_training_beats_the_starting_weights(spark):
    got = QUERIES["op2_lattice_lm"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.score < 0).all()
    assert held.score.sum() > held.base_score.sum() * 1.5


def test_edge_cases(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "a b " * 30000, 1.0), (3, "a b " * 30000, 1.0), (None, "x" * 5000, None), (4, "日本 \x00 é", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    from pyspark.sql import functions as F

    got = lattice_lm.score_documents(docs, F.coalesce(F.col("doc_id") == 4, F.lit(False))).collect()
    assert len(got) == 6 and sorted(r.n_tokens for r in got) == [1, 1, 2, 4, 60001, 60001] and all(math.isfinite(r.score) for r in got)
    none = lattice_lm.score_documents(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}
    assert lattice_lm.score_documents(docs.limit(0), F.lit(False)).count() == 0
