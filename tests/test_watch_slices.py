import os

import pytest

from foliomill.operators.providers import HashingProvider
from foliomill.plans.documents import DocumentPipeline
from foliomill.plans.workspace import materialize, shared_dir, working_files
from foliomill.streaming import ingest
from foliomill.streaming.batches import BatchTables

PROSE = "A page of text that is long enough to be read as it is and not from its image."


def batch_of(spark, n):
    rows = [(f"/x/{i}.pdf", f"{i}.pdf", f"{i:04x}", f"{'bad' if i % 5 == 4 else i} {PROSE}\f{i} again, {PROSE}".encode()) for i in range(n)]
    return spark.createDataFrame(rows, "path string, file_name string, file_hash string, content binary")


def extractor(content):
    if content.startswith(b"bad"):
        raise ValueError("broken")
    return content.decode().split("\f")


def run(spark, store, n=12):
    ingest.process_batch(batch_of(spark, n), 0, store, DocumentPipeline(HashingProvider(4)), extractor)


def tables(spark, store):
    return {t: sorted(map(repr, ingest.processed(spark, store, t).collect())) for t in ingest.PROCESSED}


def working(spark):
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def test_slices_give_the_same_tables_and_leave_no_working_files(spark, tmp_path, monkeypatch):
    before, codec = working(spark), spark.conf.get("spark.sql.parquet.compression.codec")
    run(spark, str(tmp_path / "one"))
    monkeypatch.setattr(ingest, "SLICE_BYTES", 1)
    run(spark, str(tmp_path / "six"))
    assert working(spark) == before and spark.conf.get("spark.sql.parquet.compression.codec") == codec
    one, six = (tables(spark, str(tmp_path / name)) for name in ("one", "six"))
    assert one == six and len(one["documents"]) == 12 and len(one["chunks"]) == 10


def test_a_batch_that_ends_within_its_slices_is_made_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "SLICE_BYTES", 1)
    run(spark, str(tmp_path / "whole"))
    add = BatchTables.add

    def dying(self, table, make, n, of):
        if (table, n) == ("pages_clean", 2):
            raise RuntimeError("lost driver")
        add(self, table, make, n, of)

    store = str(tmp_path / "cut")
    monkeypatch.setattr(BatchTables, "add", dying)
    with pytest.raises(RuntimeError, match="lost driver"):
        run(spark, store)
    assert ingest.processed(spark, store, "chunks") is None
    monkeypatch.setattr(BatchTables, "add", add)
    run(spark, store)
    assert tables(spark, store) == tables(spark, str(tmp_path / "whole"))


def test_working_files_go_with_the_innermost_scope(spark):
    before = working(spark)
    with working_files(spark):
        kept = materialize(spark.range(3), "outer")
        with pytest.raises(ValueError), working_files(spark):
            materialize(spark.range(3), "inner")
            raise ValueError
        assert kept.count() == 3 and not any(name.startswith("inner") for name in working(spark) - before)
    assert working(spark) == before
