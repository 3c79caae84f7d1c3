import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from foliomill.llm import bpe
from foliomill.plans.workspace import materialize
from tests.llm.test_near_dups import brute


def test_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], folder)))
        assert kept[-1].columns == docs.columns and kept[-1].schema.simpleString() == docs.schema.simpleString()
    raw, good, single, masked, mixed = [df.toPandas() for df in kept]
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id").quality
    gone = set(raw.doc_id) - set(good.doc_id)
    assert 0.05 < len(gone) / len(raw) < 0.3
    assert labels.reindex([d for d in gone if d in labels.index]).mean() < 0.05
    texts = dict(zip(good.doc_id, good.text))
    assert sorted(single.doc_id) == sorted({c for _, c in brute(texts, shingle=5).values()})
    assert sorted(masked.doc_id) == sorted(single.doc_id) and masked.text.str.contains("[SECRET]", regex=False).sum() > 5
    assert (masked.n_chars == masked.text.str.len()).all()
    assert set(mixed.doc_id) <= set(masked.doc_id) and mixed.doc_id.value_counts().max() == 2
    codec = bpe.BpeCodec(open(bpe.default_vocabulary(), encoding="utf-8").read(), bpe.default_pattern())
    encoded = corpus_pipeline.STAGES[-1][1](spark, kept[-1], folder).collect()
    assert len(encoded) == len(mixed)
    texts = dict(zip(mixed.doc_id, mixed.text))
    for r in encoded:
        assert codec.decode(r.ids) == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_on_the_smallest_tables_and_on_none(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
