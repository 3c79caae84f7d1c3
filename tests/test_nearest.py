import math
import random

import numpy as np
import pytest

from foliomill.operators import vectors
from foliomill.operators.nearest import nearest

SHAPE = "chunk_id {}, embedding array<{}>, section_type string, retrieval_override string"


def cosine(a, b):
    """As SQL has it: sums in the order of the components."""
    dot = aa = bb = 0.0
    for p, q in zip(a, b):
        dot, aa, bb = dot + p * q, aa + p * p, bb + q * q
    return min(1.0, max(-1.0, dot / math.sqrt(aa * bb)))


def by_hand(rows, k, threshold):
    """All pairs of rows; repeated rows count each time."""
    found = []
    for one in {i for i, _ in rows}:
        near = sorted((-cosine(v, w), j) for i, v in rows if i == one for j, w in rows if j != one and len(v) == len(w))
        found += [(one, j, -s) for s, j in near[:k] if -s >= threshold]
    return sorted(found)


def of(spark, rows, kind="long", number="float"):
    return spark.createDataFrame([(i, v, None, None) for i, v in rows], SHAPE.format(kind, number))


def vector(rng, width=6):
    return [float(np.float32(rng.gauss(0, 1))) for _ in range(width)]


def test_copies_are_found_by_id_whatever_block_they_are_in(spark):
    rng = random.Random(1)
    base = [vector(rng) for _ in range(12)]
    rows = [(i, base[i * 7 % 12]) for i in range(130)]
    want = by_hand(rows, 3, 0.2)
    for block in (4096, 5):
        assert sorted(map(tuple, vectors.knn_edges(of(spark, rows), 3, 0.2, block).collect())) == want


def test_a_copy_is_no_nearer_than_a_vector_in_the_same_direction(spark):
    rows = [(i, [2.0**n, 0.0, 2.0**n]) for i, n in enumerate((0, 3, 0, 1, 0, 2))] + [(9, [1.0, 0.5, 1.0])]
    got = vectors.knn_edges(of(spark, rows), 2, 0.5, 2)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 2, 0.5)


def test_ids_with_several_vectors_repeated_rows_and_unlike_dimensions(spark):
    rng = random.Random(2)
    rows = [(f"c{i % 9}", vector(rng, 3 + i % 2)) for i in range(30)]
    rows += rows[:7] + [("x", rows[0][1]), ("y", rows[0][1]), ("x", rows[3][1])]
    chunks = of(spark, rows, "string", "double").unionByName(of(spark, [(None, rows[0][1])], "string", "double"))
    assert sorted(map(tuple, vectors.knn_edges(chunks, 4, -1.0, 4).collect())) == by_hand(rows, 4, -1.0)


def test_nothing_to_compare(spark):
    none = of(spark, [(1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")])])
    assert vectors.knn_edges(none).count() == 0 and vectors.knn_edges(none.limit(0)).count() == 0
    assert vectors.knn_edges(of(spark, [(1, [1.0]), (2, [1.0, 1.0])]), threshold=-1.0).count() == 0


@pytest.mark.parametrize("least", [-1.0, 0.3])
def test_blocks_give_what_all_pairs_give(least):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1100, 16)).astype(np.float32), rng.normal(size=(1300, 16)).astype(np.float32)
    y[:200], x[500:700] = 2 * x[:200], x[3] + rng.normal(size=(200, 16)).astype(np.float32) * 1e-7

    def pairs(a, b):
        dot, aa, bb = np.zeros((len(a), len(b))), np.zeros(len(a)), np.zeros(len(b))
        for p, q in zip(a.T.astype(np.float64), b.T.astype(np.float64)):
            dot, aa, bb = dot + p[:, None] * q, aa + p * p, bb + q * q
        return np.clip(dot / np.sqrt(aa[:, None] * bb), -1, 1)

    def best(sims, start, other):
        out = set()
        for i, row in enumerate(sims):
            out |= {(i + start, int(j) + other, row[j]) for j in np.lexsort((np.arange(len(row)), -row))[:5] if row[j] >= least}
        return out

    rows = lambda found: {(int(a), int(b), s) for a, b, s in zip(*found)}
    mine, theirs = nearest(x, y, 0, 5000, 5, least)
    assert rows(mine) == best(pairs(x, y), 0, 5000) and rows(theirs) == best(pairs(x, y).T, 5000, 0)
    alone = pairs(x, x)
    np.fill_diagonal(alone, -9)
    assert rows(nearest(x, x, 7, 7, 5, least)[0]) == best(alone, 7, 7)
