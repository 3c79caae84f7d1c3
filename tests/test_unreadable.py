"""One unreadable file of a directory fails alone: as a batch, and in a watch."""

from foliomill.operators.providers import HashingProvider
from foliomill.plans.documents import DocumentPipeline
from foliomill.sources import files
from foliomill.streaming import ingest

PAGE = b" is a page of text that is long enough to be read as it is and not from its image."


def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, body in (("a.pdf", b"one"), ("b.pdf", b"two"), ("bad.pdf", b"three"), ("c.pdf", b"one"), ("d.txt", b"four")):
        (folder / name).write_bytes(body + PAGE)
    # a checksum that the content does not have: reading the file raises an input/output error
    (folder / ".bad.pdf.crc").write_bytes(b"crc\0\0\0\x02\0" + b"\x01\x02\x03\x04" * 4)
    return str(folder)


def test_directory_with_an_unreadable_file(spark, tmp_path):
    found = files.document_files(spark, inbox(tmp_path))
    known = spark.createDataFrame([], "file_hash string")
    results = {r.file_name: (r.duplicate, r.failed, r.document_id is None) for r in files.ingest_results(found, known).collect()}
    assert results == {"a.pdf": (False, False, False), "b.pdf": (False, False, False), "c.pdf": (True, False, False), "bad.pdf": (False, True, True)}
    rows, tally = files.ingest(found, known)
    assert sorted(r.file_name for r in rows.collect()) == ["a.pdf", "b.pdf"] and tuple(tally.first()) == (2, 1, 1, 4)


def test_watch_with_an_unreadable_file(spark, tmp_path):
    store = str(tmp_path / "store")
    stream = ingest.listing(spark, inbox(tmp_path))
    ingest.process_stream(stream, store, DocumentPipeline(HashingProvider(8)), lambda c: [c.decode()], str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in ingest.processed(spark, store, "commits").collect()] == [(2, 1, 1)]
    assert {r.file_name: r.status for r in ingest.processed(spark, store, "documents").collect()} == {"a.pdf": "review", "b.pdf": "review"}
    assert ingest.processed(spark, store, "results").where("failed").first().file_name == "bad.pdf"


def test_paths_of_a_batch_are_opened(spark, tmp_path):
    folder = inbox(tmp_path)
    batch = spark.createDataFrame([(f"file:{folder}/{n}", n) for n in ("a.pdf", "gone.pdf")], "path string, file_name string")
    assert {r.file_name: r.content for r in ingest.opened(batch).collect()} == {"a.pdf": b"one" + PAGE, "gone.pdf": None}
    assert [r.content for r in ingest.opened(batch.where("file_name = 'gone.pdf'")).collect()] == [None]
