"""Each stage of the pipeline with nulls, repeated rows, columns of clashing names and a very long text."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

LONG = "a long text of many words that goes on " * 40_000
#: columns whose names operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, hash string, cls long, component string, copies int, size long, start int, kept boolean"
PLAIN = ["quiet words of one kind stand here in a row and then some more of them follow", "other words are in this one, which says that nothing is like it at all, or nearly", "third text, with numbers 1 2 3 4 5 and so on until the end of the line is reached"]


def table(spark):
    extra = (7, "h", 8, "c", 9, 10, 11, True)
    rows = [(i, t, "en", "web", len(t), *extra) for i, t in enumerate(PLAIN)]
    rows += [rows[0], (10, None, None, None, None, *extra), (11, "", "en", None, 0, *extra), (None, PLAIN[1], "en", "web", 5, *extra), (None, None, None, None, None, *[None] * 8), (12, LONG, "en", "web", len(LONG), *extra)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, 0) for i in (0, 1, 2, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def counts(frame):
    found = {}
    for r in frame.collect():
        key = (r.doc_id, None if r.text is None else len(r.text))
        found[key] = found.get(key, 0) + 1
    return found


def test_quality_stage_keeps_or_drops_whole_rows(spark, folder):
    docs = table(spark)
    out = pipeline.quality_stage(spark, docs, folder)
    assert out.columns == docs.columns
    before, after = counts(docs), counts(out)
    # rows without an id stay, of the others all rows of an id stay or go
    assert all(after[k] == n for k, n in before.items() if k[0] is None) and all(before[k] == n for k, n in after.items())


def test_near_duplicate_stage_keeps_rows_without_words_or_id(spark, folder):
    docs = table(spark)
    out = pipeline.near_duplicate_stage(spark, docs, folder)
    assert out.columns == docs.columns and counts(out) == counts(docs)


def test_secrets_stage_masks_and_loses_no_row(spark, folder):
    secret = "token=Abcd1234Efgh5678Ijkl"
    docs = table(spark).unionByName(table(spark).where("doc_id = 2").selectExpr("20L AS doc_id", f"'{secret}' AS text", "lang", "source", "n_chars", "row", "hash", "cls", "component", "copies", "size", "start", "kept"))
    out = pipeline.secrets_stage(spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [(r.text, r.n_chars) for r in out.where("doc_id = 20").collect()] == [("[SECRET]", 8)]
    assert out.where("text is null and n_chars is null").count() == 2


def test_mixing_stage_repeats_whole_rows(spark, folder):
    docs = table(spark)
    out = pipeline.mixing_stage(spark, docs, folder)
    assert out.columns == docs.columns
    before = counts(docs)
    assert all(k in before and n <= 2 * before[k] for k, n in counts(out).items())


def test_encoding_stage_gives_a_row_for_each(spark, folder):
    out = {(r.doc_id, r.n_tokens) for r in pipeline.encoding_stage(spark, table(spark), folder).collect()}
    assert len(out) == 8 and {(10, 0), (11, 0), (None, 0)} <= out and max(n for _, n in out) > 300_000


def test_empty_tables(spark, folder):
    docs = table(spark).limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
