import hashlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("foliomill.llm.repeats")
from foliomill.llm import repeats
from foliomill.llm.queries import QUERIES


def brute(rows, length, keep_first=False):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, kept)]."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    where = defaultdict(list)
    for n, (d, data) in enumerate(rows):
        for i in range(len(data) - length + 1):
            where[data[i : i + length]].append((d, n, i))
    out = []
    for n, (d, data) in enumerate(rows):
        gone = np.zeros(len(data) + 1, np.int8)
        for i in range(len(data) - length + 1):
            places = where[data[i : i + length]]
            if len(places) > 1 and (not keep_first or (d, n, i) != min(places)):
                gone[i : i + length] = 1
        runs = int(((gone[1:] == 1) & (gone[:-1] == 0)).sum()) + int(gone[0] == 1)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((d, len(data), len(data) - len(kept), runs, kept))
    return sorted(out)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 200)]
    assert sorted(map(tuple, QUERIES["op4_repeats"](spark, folder).collect())) == want


def texts_of(seed):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "bdfgk" for b in ("a", "é", "or", "int")]
    prose = lambda n: " ".join(rng.choice(words, n))
    passages = [prose(30) for _ in range(4)] + ["ab" * 90, "x" * 150, "-" * 700, "one two 3 " * 60]
    rows = [(i, " ".join([prose(rng.integers(0, 40)), str(rng.choice(passages)), prose(rng.integers(0, 40)), str(rng.choice(passages))])) for i in range(40)]
    return rows + [(40, rows[3][1]), (41, rows[3][1]), (42, None), (43, ""), (44, "short"), (45, "short"), (46, "z" * 400), (47, prose(3000))]


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"bucket": 5}])
@pytest.mark.parametrize("keep_first", [False, True])
def test_random_corpora_all_paths(spark, options, keep_first):
    rows = texts_of(len(options) + keep_first)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    got = repeats.remove_repeats(docs, length=80, keep_first=keep_first, **options).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 80, keep_first)


@pytest.mark.parametrize("keep_first", [False, True])
def test_small_and_large_groups_agree_with_all_pairs(keep_first):
    rng = np.random.default_rng(5)
    for n in (2, 7, 24, 25, 80):
        left = [bytes(rng.choice([97, 98], rng.integers(0, 20), p=[0.9, 0.1]).astype(np.uint8)) for _ in range(n)]
        right = [b"g" * 64 + bytes(rng.choice([97, 98], rng.integers(0, 17), p=[0.9, 0.1]).astype(np.uint8)) for _ in range(n)]
        rank = rng.permutation(n)
        back, ahead = repeats.shared_factors(left, right, rank, 80, keep_first)
        for i in range(n):
            pairs = []
            for j in range(n):
                if j != i and (not keep_first or rank[j] < rank[i]):
                    a, b = (next((k for k, (p, q) in enumerate(zip(x[i], x[j])) if p != q), min(len(x[i]), len(x[j]))) for x in (left, right))
                    pairs += [(a, b)] if a + b >= 80 else []
            # strings of 80 bytes reach no further back than 16 bytes, nor ahead than 80
            want = (min(16, max(a for a, _ in pairs)), min(80, max(b for _, b in pairs))) if pairs else (0, 0)
            assert (min(back[i], 16), min(ahead[i], 80)) == want


def test_a_text_of_one_letter_sends_one_period():
    rows, own = repeats.anchors(np.full(500_000, 120, np.uint8), 200)
    assert len(rows) == 1 and tuple(rows[0, 2:]) == (0, 0) and own == [(0, 1, 500_000)]


def test_periodic_long_texts(spark):
    texts = ["x" * 3_000_000, "-=" * 300_000 + " end of one " + "lone words " * 3, "abc" * 100 + "x" * 250, ("x" * 100 + "\n") * 3000, "=" * 199]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(5)] == [(3_000_000, 1), (600_000, 1), (550, 1), (303_000, 1), (0, 0)]
    first = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_first=True).collect()}
    assert first[0].n_removed == 3_000_000 - 1 and first[3].n_removed == 303_000 - 101


def test_edge_cases(spark):
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 4
    docs = spark.createDataFrame([(None, same), (3, same), (3, same), (4, None)], "doc_id long, text string")
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == 4 and {r.n_removed for r in got} == {0, len(same)}
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, same * 16000)], "doc_id long, text string")
    r = repeats.remove_repeats(long).first()
    assert (r.n_bytes, r.n_removed, r.n_spans) == (len(same) * 16000, len(same) * 16000, 1)
