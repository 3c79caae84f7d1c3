import pytest

pytest.importorskip("foliomill.llm.mixing")
from foliomill.llm import mixing
from foliomill.llm.queries import QUERIES
from pyspark.sql import functions as F


def reshared(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, got, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(got.values())
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            return got | {s: level * w[s] for s in open_}
        got |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return got


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 20, None: 400}, {"a": 5}, {"a": 1, "b": 1, "c": 1, "d": 900, "é": 30}, {"a": 0, "b": 7}])
def test_targets_equal_iterated_resharing(spark, sizes):
    items = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(items).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_query_keeps_rows_bounds_and_totals(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = QUERIES["op10_mixing"](spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    sizes = docs.text.map(lambda x: len(x.encode().split()))
    assert dict(zip(got.doc_id, got["size"])) == dict(zip(docs.doc_id, sizes))
    assert (got.taken <= 2 * got["size"]).all()
    for _, part in got.groupby("source"):
        assert part["size"].sum() == part.source_size.iloc[0]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()
    again = QUERIES["op10_mixing"](spark, sf).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))


def test_large_source_goes_through_several_levels(spark):
    items = spark.range(6000).select("id", F.lit("s").alias("source"), (F.col("id") % 37 + 1).alias("size"))
    items = items.unionByName(items.limit(1).select((F.col("id") + 10000).alias("id"), F.lit("z").alias("source"), F.lit(10**6).cast("long").alias("size")))
    got = mixing.mix(items).where("source = 's'").toPandas()
    assert len(got) == 6000 and abs((got["size"] * got.copies).sum() - got.target.iloc[0]) <= 37


def test_rounding_by_hand(spark):
    """One block, one source: every meeting leaves one item whole, and the weighted sum never moves."""
    sizes = [3, 5, 7, 11, 2]
    items = [(i, "s", float(x), 0.4, i) for i, x in enumerate(sizes)]
    rest = spark.createDataFrame(items, "id long, source string, size double, p double, row long").withColumn("n_items", F.lit(5).cast("long"))
    for seed in range(12):
        got = mixing._round_level(rest, 0, seed).collect()
        fractional = [r for r in got if r.p not in (0.0, 1.0)]
        assert len(got) == 5 and len(fractional) <= 1
        assert sum(r.size * r.p for r in got) == pytest.approx(0.4 * sum(sizes)) and all(0 <= r.p <= 1 for r in got)


def test_expected_copies_are_kept(spark):
    """Over many seeds each item is taken as often as its share says."""
    items = spark.createDataFrame([(i, "s", float(x), 0.3, i) for i, x in enumerate([4, 9, 2, 8])], "id long, source string, size double, p double, row long").withColumn("n_items", F.lit(4).cast("long"))
    many = items.crossJoin(spark.range(3000).select(F.col("id").alias("n"))).withColumn("id", F.xxhash64("id", "n")).withColumn("source", F.col("n").cast("string"))
    got = mixing._round_level(many, 0, 5).groupBy("row").agg(F.avg("p").alias("p")).collect()
    assert [round(abs(r.p - 0.3), 1) for r in got] == [0.0] * 4


def test_many_sources_and_repeated_rows(spark):
    items = spark.range(4000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("source"), (F.col("id") % 50 + 1).alias("size"))
    got = {r.source: r.target for r in mixing.source_targets(items).collect()}
    assert got == pytest.approx(reshared({f"h{i}": i % 50 + 1 for i in range(4000)}))
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 > 0, "a").alias("source"))
    docs = docs.unionByName(docs.select((F.col("doc_id") * 0).cast("long").alias("doc_id"), F.lit("x " * 9000).alias("text"), F.lit("b").alias("source")).limit(1))
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == 3001
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in ("a", None)}
    target = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - target[s]) <= 3 for s in taken)
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted((str(r.source), r.taken) for r in again) == sorted((str(r.source), r.taken) for r in rows)


def test_clashing_columns_of_the_stage(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 7, "t") for i in range(20)], "doc_id long, text string, source string, _mix_text int, t string")
    out = mixing.repeat_by_mix(docs)
    assert out.columns == docs.columns and {(r._mix_text, r.t) for r in out.collect()} <= {(7, "t")}


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, copies string, size string"
    docs = spark.createDataFrame([(1, None, "a", "x", "y"), (2, "", None, "x", "y"), (3, "w " * 5000, "a", "x", "y"), (3, "w " * 5000, "a", "x", "y"), (None, "b c", None, None, None)], schema)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [0, 0, 2, 5000, 5000]
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    again = mixing.repeat_by_mix(docs)
    assert again.columns == docs.columns and again.count() <= 10
