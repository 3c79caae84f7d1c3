import pytest

pytest.importorskip("foliomill.llm.secrets")
from foliomill.llm import secrets

TEXT = "use token=LiveLive0123456789ab and Zx11Qp47LmNo39TyUv00 here"


def rows(spark, sources):
    return spark.createDataFrame([(i, TEXT, s) for i, s in enumerate(sources)], "doc_id long, text string, source string")


def test_copies_inside_few_owners_stay_live(spark):
    for sources in (["a"] * 9, ["a"] * 500, ["a"] * 30 + ["b"] * 30, [None] * 20):
        got = secrets.scan_secrets(rows(spark, sources)).collect()
        assert len(got) == len(sources) and {(r.n_live, r.n_examples, r.n_owned) for r in got} == {(2, 0, 1)}
        masked = {r.text for r in secrets.redact_secrets(rows(spark, sources)).collect()}
        assert masked == {"use [SECRET] and [SECRET] here"}


def test_more_owners_make_an_example(spark):
    got = secrets.scan_secrets(rows(spark, ["a", "b", "c"])).collect()
    assert {(r.n_live, r.n_examples, r.n_owned) for r in got} == {(0, 2, 0)}


def test_repositories_and_owners_are_both_counted(spark):
    for sources, repositories, owners in ((["a"] * 50, 50, 1), (["a", "b", "c", "d", "e"], 5, 5), (["a", "a", "b", None, None], 5, 3)):
        got = secrets.scan_secrets(rows(spark, sources)).collect()
        live = owners <= 2
        assert {x.repositories for r in got for x in r.found} == {repositories} and {x.owners for r in got for x in r.found} == {owners}
        assert {x.live for r in got for x in r.found} == {live}
        assert {r.frequencies for r in got} == {",".join([f"{repositories}/{owners}"] * len(got[0].found))}


def test_rows_of_one_document_are_one_repository(spark):
    docs = spark.createDataFrame([(1, TEXT, "a"), (1, TEXT, "a"), (None, TEXT, "a"), (None, TEXT, "a"), (2, TEXT, "b")], "doc_id long, text string, source string")
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == 5 and {(x.repositories, x.owners) for r in got for x in r.found} == {(3, 2)}
