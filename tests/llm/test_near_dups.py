import time

import numpy as np
import pytest

pytest.importorskip("foliomill.llm.near_dups")
from foliomill.llm import near_dups
from foliomill.llm.queries import QUERIES


def brute(texts, shingle=2, percent=80):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = {}
    for d, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        common = {}
        for x in s:
            for o in holders[x]:
                if o < d:
                    common[o] = common.get(o, 0) + 1
        for o, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def same(rows, texts, **options):
    want = brute(texts, **options)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, folder):
    folder = f"/root/testdata/{folder}"
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    same(QUERIES["op9_near_dups"](spark, folder).collect(), texts)


def families(n=150, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts, at = {}, 0
    for length in (4, 6, 12, 40, 120):
        for _ in range(3):
            base = list(rng.choice(words, length))
            for _ in range(n // 15):
                copy = list(base)
                for i in rng.integers(0, length, rng.integers(0, max(2, length // 12))):
                    copy[i] = str(rng.choice(words))
                texts[at] = " ".join(copy)
                at += 1
    return texts


def test_families_of_near_copies_in_small_blocks(spark):
    texts = families()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same(near_dups.near_duplicates(docs, shingle=2, block=7).collect(), texts)
    same(near_dups.near_duplicates(docs, shingle=5).collect(), texts, shingle=5)
    kept = near_dups.keep_first(docs, shingle=2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(texts).values()}) and kept.columns == docs.columns


def test_chains_of_unlike_families_are_joined_across_clusters(spark):
    """Windows sliding over one sequence: neighbours are near, the ends of the chain share nothing."""
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[3 * i : 3 * i + 60]) for i in range(110)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same(near_dups.near_duplicates(docs, shingle=2, block=16).collect(), texts)


def test_a_large_family_of_different_near_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(10_000):
        copy = list(base)
        copy[rng.integers(0, 120)] = f"own{d}"
        rows.append((d, " ".join(copy)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert len(got) == 10_000 and {r.component_id for r in got} == {0}


def test_texts_of_a_repeated_id_both_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (3, b + " more"), (9, "alone")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]


def test_many_texts_under_one_id_cost_what_they_cost_under_their_own(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for d in range(3_000):
        copy = list(base)
        copy[rng.integers(0, 120)] = f"own{d}"
        texts.append(" ".join(copy))
    seconds = []
    for ids in (range(3_000), [7] * 3_000):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        began = time.time()
        got = near_dups.near_duplicates(docs, shingle=2).collect()
        seconds.append(time.time() - began)
        assert len(got) == 3_000 and {r.component_id for r in got} == {min(ids)}
    assert seconds[1] < 2 * seconds[0] + 5


def test_a_row_that_repeats_often_is_read_once(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a)] * 2_000 + [(2, a + " more"), (3, a + " other"), (4, "alone")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert len(got) == 2_003 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_sketch_columns_estimate_like_the_arrays(spark):
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 1 << 63, (20, 8), dtype=np.int64)
    near = maps ^ (rng.random((20, 8)) < 0.3).astype(np.int64)
    rows = [(a.tolist(), b.tolist()) for a, b in zip(maps, near)]
    table = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r.e for r in table.select(near_dups.sketch_estimate(table.a, table.b).alias("e")).collect()]
    assert np.allclose(got, [near_dups.estimate(a.view(np.uint64), b.view(np.uint64)[None])[0] for a, b in zip(maps, near)])


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            union = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
            cut = int(500 * (1 - share) / 2)
            a, b = np.unique(union[cut:]), np.unique(union[: 500 - cut])
            s, t = (near_dups.odd_sketch(near_dups.minhash(x)) for x in (a, b))
            errors.append(near_dups.estimate(s, t[None])[0] - share)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < near_dups.MARGIN / 2


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "One", "x"), (5, "one", "x"), (6, "a b " * 20000, "x"), (7, "A B " * 20000, "x"), (7, "A B " * 20000, "x"), (None, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, shingle=2).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (7, 2, 6, False), (None, 1, None, True)}
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0
