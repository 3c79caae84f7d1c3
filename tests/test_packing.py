import random
import time

import pytest
from pyspark.sql import functions as F

from foliomill.operators import packing
from tests.test_cleaning_chunking import check_packing

MOST, OVERLAP = 60, 15


def documents(seed, n, blocks):
    rng = random.Random(seed)
    return {d: [(rng.choice([1, 3, 14, 15, 16, 40, 59, 60, 61, 90]), rng.random() < 0.15) for _ in range(rng.randint(1, blocks))] for d in range(n)}


def found(spark, docs, most=MOST, overlap=OVERLAP, **options):
    rows = [(str(d), i, t, a) for d, blocks in docs.items() for i, (t, a) in enumerate(blocks, 1)]
    df = spark.createDataFrame(rows, "document_id string, i int, tokens int, atomic boolean")
    return sorted((int(r.document_id), r.chunk_index, r.first, r.last, r.opener) for r in packing.spans(df, most, overlap, **options).collect())


@pytest.mark.parametrize("stretch", [4096, 7, 1])
def test_spans_keep_the_rules_of_packing(spark, stretch):
    docs = documents(3, 30, 40)
    got = found(spark, docs, stretch=stretch)
    for d, blocks in docs.items():
        named = [(f"b{i}", t, a, False) for i, (t, a) in enumerate(blocks)]
        mine = [x for x in got if x[0] == d]
        assert [x[1] for x in mine] == list(range(len(mine)))
        check_packing(named, [("\n\n".join(f"b{i - 1}" for i in range(first, last + 1)), None) for _, _, first, last, _ in mine], MOST, OVERLAP)
        # a chunk's opener is the first block that the chunk before does not hold
        assert [x[4] for x in mine] == [1, *(x[3] + 1 for x in mine[:-1])]


def test_stretches_change_nothing(spark):
    docs = documents(4, 12, 300)
    whole = found(spark, docs)
    assert whole == found(spark, docs, stretch=16) == found(spark, docs, stretch=3)
    for overlap in (0, MOST, 5 * MOST):
        assert found(spark, docs, overlap=overlap) == found(spark, docs, overlap=overlap, stretch=8)


def test_without_overlap_spans_cut_the_document(spark):
    docs = documents(5, 1, 60)
    got = found(spark, docs, overlap=0)
    assert [i for _, _, first, last, _ in got for i in range(first, last + 1)] == list(range(1, len(docs[0]) + 1))


def test_a_document_of_a_million_blocks(spark):
    n = 1_000_000
    blocks = spark.range(1, n + 1, numPartitions=4).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).cast("int").alias("tokens"), (F.col("id") % 1000 == 7).alias("atomic"))
    began = time.time()
    out = packing.spans(blocks, 1000, 100).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("low"), F.max("last").alias("high"), F.sum(F.col("last") - F.col("opener") + 1).alias("new")).first()
    # every block is new in one chunk
    assert out.low == 1 and out.high == n and out.new == n and out.n > n / 12
    assert time.time() - began < 300
