import os

import pytest
from pyspark.sql import functions as F

from foliomill.operators import store
from foliomill.plans.scoped import DocumentStore


def tables(spark, n=40):
    documents = spark.range(n).select(F.concat(F.lit("d"), "id").alias("document_id"), F.lit("done").alias("status"), F.lit("x").alias("error_message"))
    chunks = documents.select("document_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_index"), F.array(F.lit(1.0)).alias("embedding"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    pages = documents.select("document_id", F.lit("text").alias("text"))
    return {"documents": documents, "chunks": chunks, "pages_clean": pages}


def kept(spark, tmp_path, n=40):
    out = DocumentStore(spark, str(tmp_path / "store"), buckets=16)
    out.create(tables(spark, n))
    return out


def contents(s):
    return {name: sorted(map(str, s.table(name).collect())) for name in s.names()}


def files(tmp_path):
    """{bucket folder of a table: its files with their times}."""
    root, out = tmp_path / "store" / "tables", {}
    for folder in root.glob("*/_bucket=*"):
        out[str(folder.relative_to(root))] = {(f.name, f.stat().st_mtime_ns) for f in folder.iterdir() if f.name.endswith(".parquet")}
    return out


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "document_id string")


def test_one_document_rewrites_one_bucket_of_what_changes(spark, tmp_path):
    s = kept(spark, tmp_path)
    before, rows = files(tmp_path), contents(s)
    s.change("one", ids(spark, "d7"), lambda t: store.reprocess(t, ids(spark, "d7"), "clean"))
    after = files(tmp_path)
    moved = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert len(moved) == 2 and {f.split(os.sep)[0] for f in moved} == {"documents", "pages_clean"}
    plain = store.reprocess(tables(spark), ids(spark, "d7"), "clean")
    assert contents(s) == {name: sorted(map(str, t.select(*tables(spark)[name].columns).collect())) for name, t in plain.items()}
    assert contents(s)["chunks"] == rows["chunks"]
    s.change("one", ids(spark, "d8"), lambda t: store.hard_reset(t, ids(spark, "d8")))
    assert files(tmp_path) == after


@pytest.mark.parametrize("cut", ["rows", "mark", "first", "second"])
def test_a_change_cut_short_is_none_or_is_finished(spark, tmp_path, monkeypatch, cut):
    s = kept(spark, tmp_path)
    before, gone = contents(s), ids(spark, "d1", "d2", "d30")
    want = {name: [r for r in rows if not any(f"'{d}'" in r for d in ("d1", "d2", "d30"))] for name, rows in before.items()}
    calls = []

    def lost(self, *args):
        calls.append(args)
        if len(calls) == {"mark": 1, "first": 1, "second": 2, "rows": 1}[cut]:
            raise RuntimeError("lost")
        return real(self, *args)

    name = "_mark" if cut in ("rows", "mark") else "_write_over"
    real = getattr(DocumentStore, name)
    monkeypatch.setattr(DocumentStore, name, lost)
    make = lambda t: store.hard_reset(t, gone)
    with pytest.raises(RuntimeError):
        s.change("reset", gone, make)
    monkeypatch.undo()
    if name == "_mark":
        assert contents(s) == before and s.recover() == []
        s.change("reset", gone, make)
    elif cut == "first":
        s.change("other", ids(spark, "d3"), lambda t: {})
    else:
        assert s.recover() == ["reset"]
    assert contents(s) == want
    s.change("reset", gone, make)
    assert contents(s) == want


def test_inserts_emptied_buckets_and_null_ids(spark, tmp_path):
    s = kept(spark, tmp_path, 3)
    s.change("all", ids(spark, "d0", "d1", "d2"), lambda t: store.delete_documents(t, ids(spark, "d0", "d1", "d2")))
    assert [s.table(n).count() for n in s.names()] == [0, 0, 0] and files(tmp_path) == {}
    new = spark.createDataFrame([("e1", "queued"), (None, "queued")], "document_id string, status string")
    s.change("new", new, lambda t: {"documents": store.insert(t["documents"], new)})
    assert sorted((str(r.document_id), r.error_message) for r in s.table("documents").collect()) == [("None", None), ("e1", None)]
    s.change("none", new.limit(0), lambda t: 1 / 0)


def test_rows_outside_and_unknown_tables_are_refused(spark, tmp_path):
    s = kept(spark, tmp_path)
    before = contents(s)
    others = tables(spark)["documents"].where("document_id <> 'd7'")
    with pytest.raises(Exception, match="not in the change"):
        s.change("wide", ids(spark, "d7"), lambda t: {"documents": others})
    with pytest.raises(KeyError):
        s.change("odd", ids(spark, "d7"), lambda t: {"pages": others})
    with pytest.raises(KeyError):
        s.change("unknown", ids(spark, "zz"), lambda t: store.hard_reset(t, ids(spark, "zz")))
    assert contents(s) == before and s.recover() == []
