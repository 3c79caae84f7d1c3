import __spark_entry__

NAMES = [
    "op1_quality", "op2_lattice_lm", "op3_divergence", "op4_repeats", "op5_ann", "op6_bpe", "op7_secrets", "op8_language_id", "op9_near_dups", "op10_mixing",
    "op11_vector_dups", "op12_alignment", "op13_hard_negatives", "pipeline",
]
CONTRACTS = {
    "op11_vector_dups": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op12_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
}


def test_every_operator_is_registered():
    assert [n for n in NAMES if n not in __spark_entry__.queries()] == []


def test_new_queries_keep_their_contracts(spark, sf):
    for name, columns in CONTRACTS.items():
        out = __spark_entry__.queries()[name](spark, sf)
        assert {f.name: f.dataType.simpleString() for f in out.schema.fields} == columns
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in __spark_entry__.queries()["op12_alignment"](spark, sf).collect()) == sorted(ids)
