import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_definition(rows, anchor, positives=5, negatives=10):
    fine = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, label) in enumerate(fine):
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other == label) for m, (j, w, other) in enumerate(fine) if m != n and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2])[:positives]:
            window = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j, _) in enumerate(window, 1)]
    return sorted(out)


def run(spark, rows, schema=SCHEMA, anchors="vec_id % 10 = 0", **options):
    out = hard_negatives.mine(spark.createDataFrame(rows, schema), F.expr(anchors), **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def table(rng, n, width):
    centers = rng.normal(size=(6, width))
    return [(i, (centers[rng.integers(0, 6)] * rng.choice([0.0, 0.3]) + rng.normal(size=width) * 0.1).round(rng.integers(1, 4)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("width,block,anchor_block", [(16, 8192, 1024), (64, 50, 7), (70, 8192, 1024), (1, 40, 3)])
def test_equals_all_products(spark, width, block, anchor_block):
    rows = table(np.random.default_rng(width), 260, width)
    expected = by_definition(rows, lambda i: i % 10 == 0)
    assert expected and run(spark, rows, block=block, anchor_block=anchor_block) == expected


def test_intervals_hold_the_scores_and_leave_most_rows_out():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(4000, 64)) / 8).astype(np.int64)
    low, high = hard_negatives.Anchors(x[:40]).intervals(*hard_negatives.encode(x))
    true = x[:40] @ x.T
    assert (low <= true).all() and (true <= high).all()
    left = [hard_negatives.survivors(low[n], high[n], np.arange(4000) != n, 5).sum() for n in range(40)]
    assert np.mean(left) < 300


def test_ties_odd_rows_and_repeated_ids(spark):
    same = [0.5, 0.25, -0.1]
    rows = [
        *[(i, same, i % 2) for i in range(24)], (30, None, 1), (40, same, None), (50, [0.5, None, 1.0], 1), (60, [float("nan")] * 3, 1), (70, [float("inf"), 0.0, 0.0], 1), (None, same, 1), (80, [0.1, 0.2], 1), (81, [0.15, 0.1], 1), (82, [0.1, 0.12], 2),
        (90, [], 1), (91, [], 1), (92, [], 2), (100, [-0.4, 0.1, 0.9], 3), (10, [0.3, 0.2, -0.1], 0), (25, [0.3, 0.2, -0.1], 0), (26, [0.35, 0.2, -0.1], 1), (26, [0.35, 0.2, -0.1], 1), (110, [0.0, 0.0, 0.0], 1),
    ]
    expected = by_definition(rows, lambda i: i % 10 == 0)
    assert expected and run(spark, rows) == expected
    assert run(spark, [(i, v, label, 0) for i, v, label in rows], SCHEMA + ", row int") == expected
    assert run(spark, []) == [] and run(spark, rows[24:29]) == []


def test_products_beyond_64_bits(spark):
    rows = [(0, [2.0**30, 1.0], 1), (1, [2.0**30, 3.0], 1), (2, [2.0**16, 5.0], 2), (3, [2.0**15, 5.0], 2), (4, [2.0**13, 5.0], 2), (5, [1e300, 0.0], 3)]
    most = (1 << 63) - 1
    assert run(spark, rows) == [(0, 1, 1, 2, most, (1 << 62) + 5 * (1 << 16))]
    assert hard_negatives.products(np.array([1 << 40]), np.array([[1 << 40], [-(1 << 40)], [2]])).tolist() == [most, -most, 1 << 41]


def test_best_orders_by_score_then_id():
    assert hard_negatives.best(np.array([3, 5, 5, 1]), np.array([1, 9, 2, 4]), 3).tolist() == [2, 1, 0]
