import random

import pytest

pytest.importorskip("foliomill.llm.divergence")
from foliomill.llm import divergence


def texts_in(spark, languages):
    rng, rows = random.Random(3), []
    for k in range(languages):
        words = [f"w{k}x{i}" for i in range(40)]
        for d in range(2):
            rows.append((len(rows), f"l{k:03}", " ".join(rng.choices(words, k=120)), "s"))
    rows += [(len(rows) + i, None, f"w{k}x1 w{k}x2 w{k}x3 " * 30, "s") for i, k in enumerate((0, 5, languages - 1))]
    rows += [(9000, None, None, "s"), (9001, "l001", None, "s"), (9002, "only-null", None, "s"), (None, None, "", "s")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rare_languages_keep_their_references(spark):
    docs = texts_in(spark, 300)
    got = {r.doc_id: r for r in divergence.divergence_rules(docs).collect()}
    assert len(got) == docs.count()
    assert max(got[i].word_distance for i in range(600)) < 0.5 and all(got[i].kept for i in range(600))


def test_joined_references_equal_broadcast_ones(spark):
    docs = texts_in(spark, 12)
    assert listed(divergence.divergence_rules(docs, broadcast_languages=5)) == listed(divergence.divergence_rules(docs))
