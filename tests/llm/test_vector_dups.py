import numpy as np
import pytest

from foliomill.llm import vector_dups

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_definition(rows, threshold=0.98):
    """Every pair by its cosine; rows with one id hang together."""
    fine = [v is not None and label is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    n, links = len(rows), [0] * len(rows)
    component = list(range(n))

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    for a in range(n):
        for b in range(a):
            if not (fine[a] and fine[b]):
                continue
            near = rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= threshold
            if near:
                links[a] += 1
                links[b] += 1
            if near or rows[a][0] == rows[b][0]:
                component[root(a)] = root(b)
    lowest = {}
    for i in range(n):
        if fine[i]:
            lowest[root(i)] = min(rows[i][0], lowest.get(root(i), rows[i][0]))
    smallest = [lowest[root(i)] if fine[i] else rows[i][0] for i in range(n)]
    return sorted(((rows[i][0], links[i], smallest[i], rows[i][0] is None or rows[i][0] == smallest[i]) for i in range(n)), key=str)


def cosine(a, b):
    a, b = (np.array(x, float) / np.abs(x).max() for x in (a, b))
    return a @ b / np.sqrt((a @ a) * (b @ b))


def run(spark, rows, schema=SCHEMA, **options):
    out = vector_dups.near_vectors(spark.createDataFrame(rows, schema), **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def families(rng, n, width=24, labels=3):
    """Random vectors and families round them, some at the very edge of a link."""
    rows, centers = [], rng.normal(size=(12, width))
    for i in range(n):
        if rng.random() < 0.5:
            v = rng.normal(size=width)
        else:
            c = centers[rng.integers(0, 12)]
            noise = rng.normal(size=width)
            v = c / np.linalg.norm(c) + noise / np.linalg.norm(noise) * rng.choice([0.0, 0.05, 0.13, 0.19, 0.2, 0.21])
        rows.append((int(i), (v * rng.choice([1, 7.5])).tolist(), int(rng.integers(0, labels))))
    return rows


@pytest.mark.parametrize("block", [8192, 20])
def test_equals_all_pairs(spark, block):
    rows = families(np.random.default_rng(3), 500)
    assert run(spark, rows, block=block) == by_definition(rows)


def test_tiny_sample_loses_nothing(spark):
    rows = families(np.random.default_rng(4), 300, width=10)
    assert run(spark, rows, sample=9, block=16, part=3) == by_definition(rows)


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.05]
    rows = [
        (1, a, 1), (2, a, 1), (3, b, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [float("inf"), 2.0, 3.0], 1),
        (None, a, 1), (11, [], 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (14, [1e300, 2e300, 3e300], 1), (15, [1e-300, 2e-300, 3e-300], 1), (2, [-1.0, 5.0, 0.0], 1), (16, [-1.0, 5.0, 0.01], 1), (16, [-1.0, 5.0, 0.01], 1),
    ]
    assert run(spark, rows) == by_definition(rows)
    assert run(spark, [(i, v, 0, "x") for i, v, _ in rows], "vec_id long, embedding array<double>, label int, links string") == by_definition([(i, v, 0) for i, v, _ in rows])
    assert run(spark, []) == []
    assert run(spark, rows[4:10]) == by_definition(rows[4:10])


def test_group_of_copies_and_floats(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i in range(700)] + [(700 + i, [float(np.float32(x)) for x in v + rng.normal(size=16) * 0.01], 1) for i in range(150)]
    assert run(spark, rows, "vec_id long, embedding array<float>, label int", block=64) == by_definition(rows)


def test_no_list_within_reach_is_left_out():
    rng = np.random.default_rng(9)
    points = vector_dups.unit(rng.normal(size=(3000, 16)))
    index = vector_dups.ReachingIndex(vector_dups.ProductQuantiser.fit(points, 60), 0.2)
    own = index.own(points)
    noise = rng.normal(size=(3000, 16))
    # towards other centroids, the worst direction there is
    noise[::2] = index.centers[rng.integers(0, 60, 1500)] - index.centers[own[::2]]
    moved = points + 0.2 * noise / np.maximum(np.sqrt((noise**2).sum(1, keepdims=True)), 1e-9)
    assert index.probed(points)[np.arange(3000), index.own(moved)].all()
    codes = index.encode(moved)
    found = set()
    for query, entry in vector_dups.candidates(index, points, index.probed(points), *codes):
        found |= set(query[query == entry].tolist())
    assert len(found) == 3000


def test_forest_keeps_joining_links_only():
    forest = vector_dups.Forest(np.arange(10))
    forest.join(np.array([1, 2, 3, 1]), np.array([2, 3, 1, 3]))
    forest.join(np.array([5, 9]), np.array([5, 3]))
    links = list(zip(*forest.links()))
    assert len(links) == 3 and {x for p in links for x in p} == {1, 2, 3, 9}
