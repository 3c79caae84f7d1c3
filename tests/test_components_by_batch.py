import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators import graph
from foliomill.streaming.batches import BatchTables
from foliomill.streaming.components import ComponentStore


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def numbered(batches):
    """{node: (component, cluster)} after all batches, by sets."""
    groups, given = [], 0
    for pairs in batches:
        touched = []
        for a, b in pairs:
            if None in (a, b) or a == b:
                continue
            met = [g for g in groups if a in g[0] or b in g[0]]
            groups = [g for g in groups if g not in met]
            held = [g[1] for g in met if g[1] is not None]
            touched.append(({a, b}.union(*[g[0] for g in met]), min(held) if held else None))
            groups.append(touched[-1])
        for g in sorted((g for g in groups if g[1] is None), key=lambda g: min(g[0])):
            groups[groups.index(g)] = (g[0], given)
            given += 1
    return {n: (min(g), c) for g, c in groups for n in g}


def found(kept):
    return {r.node: (r.component, r.cluster) for r in kept.clusters().collect()}


def test_many_random_batches_equal_one_full_run(spark, tmp_path):
    rng, kept, batches = random.Random(5), ComponentStore(spark, str(tmp_path / "s")), []
    for number in range(20):
        batches.append([(rng.randint(1, 90), rng.randint(1, 90)) for _ in range(rng.randint(1, 4))])
        kept.add(frame(spark, batches[-1]), number)
    everything = graph.connected_components(frame(spark, [p for b in batches for p in b]), "source", "target")
    assert {(r.node, r.component) for r in kept.labels().collect()} == {(r.node, r.component) for r in everything.collect()}
    got = found(kept)
    assert got == numbered(batches)
    assert len({c for _, c in got.values()}) == len({c for c, _ in got.values()})


def test_numbers_stay_when_components_join_or_get_a_smaller_node(spark, tmp_path):
    kept = ComponentStore(spark, str(tmp_path / "s"))
    kept.add(frame(spark, [(10, 11), (20, 21), (30, 31)]), 0)
    assert found(kept) == {10: (10, 0), 11: (10, 0), 20: (20, 1), 21: (20, 1), 30: (30, 2), 31: (30, 2)}
    kept.add(frame(spark, [(31, 1), (5, 6)]), 1)
    assert found(kept)[30] == (1, 2) and found(kept)[5] == (5, 3)
    kept.add(frame(spark, [(21, 31), (7, 7), (None, 8), (7, None)]), 2)
    assert {found(kept)[n] for n in (1, 20, 21, 30, 31)} == {(1, 1)} and not {7, 8} & set(found(kept))
    kept.add(frame(spark, [(50, 51)]), 3)
    assert found(kept)[50] == (50, 4)


def test_a_batch_cut_short_goes_on_and_a_repeated_one_changes_nothing(spark, tmp_path, monkeypatch):
    kept = ComponentStore(spark, str(tmp_path / "s"))
    kept.add(frame(spark, [(1, 2), (3, 4)]), 0)
    before = found(kept)
    whole = BatchTables.stage
    for last in ("nodes", "moves", "numbers", "commits"):
        def stage(self, table, make, last=last):
            if table == last:
                raise RuntimeError("lost")
            return whole(self, table, make)

        monkeypatch.setattr(BatchTables, "stage", stage)
        with pytest.raises(RuntimeError):
            kept.add(frame(spark, [(2, 3), (8, 9)]), 1)
        assert found(kept) == before
    monkeypatch.undo()
    kept.add(frame(spark, [(2, 3), (8, 9)]), 1)
    after = found(kept)
    assert after == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (1, 0), 8: (8, 2), 9: (8, 2)}
    kept.add(frame(spark, [(1, 8)]), 1)
    assert found(kept) == after


def test_earlier_edges_are_not_needed_again(spark, tmp_path):
    kept, path = ComponentStore(spark, str(tmp_path / "s")), str(tmp_path / "edges")
    frame(spark, [(i, i + 1) for i in range(50)]).write.parquet(path)
    kept.add(spark.read.parquet(path), 0)
    for f in (tmp_path / "edges").iterdir():
        f.unlink()
    kept.add(frame(spark, [(50, 77)]), 1)
    assert {r.component for r in kept.labels().collect()} == {0} and kept.labels().count() == 52


def test_empty_batches_and_text_nodes(spark, tmp_path):
    kept = ComponentStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        kept.labels()
    words = "source string, target string"
    kept.add(spark.createDataFrame([], words), 0)
    assert kept.clusters().count() == 0
    kept.add(spark.createDataFrame([("b", "c"), ("b", "c"), ("x", "y")], words), 1)
    kept.add(spark.createDataFrame([], words), 2)
    kept.add(spark.createDataFrame([("a", "c")], words), 3)
    assert found(kept) == {"a": ("a", 0), "b": ("a", 0), "c": ("a", 0), "x": ("x", 1), "y": ("x", 1)}
    assert kept.labels().groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count() == 0
