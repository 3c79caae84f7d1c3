import os

import pytest
from pyspark.sql import functions as F

from foliomill.operators.providers import HashingProvider
from foliomill.plans.documents import DocumentPipeline
from foliomill.streaming import ingest
from foliomill.streaming.batches import BatchTables, HashStore

PROSE = "A page of text that is long enough to be read as it is and not from its image."


def drop(inbox, files):
    inbox.mkdir(exist_ok=True)
    for name, body in files.items():
        (inbox / name).write_bytes(body)


def store_of(tmp_path):
    return str(tmp_path / "store"), str(tmp_path / "state")


def files_below(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names}


def test_a_watch_that_is_killed_between_stages_goes_on(spark, tmp_path, monkeypatch):
    store, state = store_of(tmp_path)
    opened = str(tmp_path / "opened")

    def extractor(content):
        with open(opened, "ab") as f:
            f.write(content[:5] + b"\n")
        if content.startswith(b"bad"):
            raise ValueError("broken")
        return content.decode().split("\f")

    def run():
        pipeline = DocumentPipeline(HashingProvider(8))
        ingest.process_stream(ingest.watch(spark, str(tmp_path / "in")), store, pipeline, extractor, state).awaitTermination()

    def states():
        return {r.file_name: (r.status, r.error_message) for r in ingest.processed(spark, store, "documents").collect()}

    assert ingest.processed(spark, store, "documents") is None
    one, two, three = (f"{n} {PROSE}".encode() for n in ("one", "two", "three"))
    drop(tmp_path / "in", {"a.pdf": one, "b.pdf": one, "c.pdf": two + b"\f" + two, "d.pdf": b"bad file", "e.txt": b"no"})
    run()
    first = {"a.pdf": ("review", None), "c.pdf": ("review", None), "d.pdf": ("failed", "ValueError: broken")}
    assert states() == first
    before = files_below(store)

    # the second batch ends after its chunks are written and before its documents are
    stage = BatchTables.stage

    def dying(self, table, make):
        if table == "pages_clean":
            raise RuntimeError("lost driver")
        return stage(self, table, make)

    drop(tmp_path / "in", {"f.pdf": three, "g.pdf": two + b"\f" + two, "h.pdf": three})
    monkeypatch.setattr(BatchTables, "stage", dying)
    with pytest.raises(Exception, match="lost driver"):
        run()
    assert states() == first and ingest.processed(spark, store, "chunks").select("document_id").distinct().count() == 2
    half = files_below(f"{store}/pages") | files_below(f"{store}/chunks")
    monkeypatch.setattr(BatchTables, "stage", stage)
    run()
    assert states() == first | {"f.pdf": ("review", None)}
    # what was written before the end was not made again, nor was what the first batch had written
    after = files_below(store)
    assert all(after[f] == t for f, t in {**before, **half}.items())
    with open(opened, "rb") as f:
        assert f.read().count(b"three") == 1
    assert [tuple(r) for r in ingest.processed(spark, store, "commits").orderBy(F.desc("ingested")).collect()] == [(3, 1, 0), (1, 2, 0)]
    chunks = ingest.processed(spark, store, "chunks").collect()
    assert len(chunks) == len({r.chunk_id for r in chunks}) == 3 and all(len(r.embedding) == 8 for r in chunks)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store, _ = store_of(tmp_path)
    rows = [("/x/a.pdf", "a.pdf", "00aa", b"text"), ("/x/b.pdf", "b.pdf", None, None), ("/x/c.pdf", "c.pdf", "00aa", b"text")]
    batch = spark.createDataFrame(rows, "path string, file_name string, file_hash string, content binary")
    run = lambda n: ingest.process_batch(batch, n, store, DocumentPipeline(HashingProvider(4)), lambda c: [c.decode()])
    run(0)
    before = files_below(store)
    run(0)
    assert files_below(store) == before
    assert [tuple(r) for r in ingest.processed(spark, store, "commits").collect()] == [(1, 1, 1)]
    run(1)
    assert sorted(tuple(r) for r in ingest.processed(spark, store, "commits").collect()) == [(0, 2, 1), (1, 1, 1)]
    assert ingest.processed(spark, store, "documents").count() == 1


def test_hash_store_reads_only_what_can_hold_the_hash(spark, tmp_path):
    known = HashStore(spark, str(tmp_path / "hashes"))
    frame = lambda *h: spark.createDataFrame([(x,) for x in h], "file_hash string")
    known.add(frame("aa1", "ab2"), 0)
    known.add(frame("aa3"), 1)
    assert sorted(r[0] for r in known.unknown(frame("aa1", "aa3", "aa9", "zz1"), 2).collect()) == ["aa9", "zz1"]
    # a batch that runs again does not meet its own hashes
    assert sorted(r[0] for r in known.unknown(frame("aa1", "aa3"), 1).collect()) == ["aa3"]
    known.add(frame("aa3"), 1)
    assert spark.read.parquet(known.path).count() == 3


def test_ingested_rows_are_those_of_committed_batches(spark, tmp_path):
    table, state = str(tmp_path / "documents"), str(tmp_path / "state")
    assert ingest.ingested(spark, table) is None
    drop(tmp_path / "in", {"a.pdf": b"one", "b.pdf": b"one"})
    watch = lambda: ingest.watch(spark, str(tmp_path / "in"), files_a_batch=1)
    ingest.ingest_stream(watch(), table, state).awaitTermination()
    drop(tmp_path / "in", {"c.pdf": b"one", "d.pdf": b"two"})
    ingest.ingest_stream(watch(), table, state).awaitTermination()
    assert len(ingest.ingested(spark, table).collect()) == 2
    os.remove(f"{table}_commits/batch=3/_SUCCESS")
    assert len(ingest.ingested(spark, table).collect()) <= 2


def test_state_of_deduplication_stays_level(spark, tmp_path):
    """Ten batches of new texts, an hour each: the state holds what is younger than the horizon."""
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    os.mkdir(source)
    stream = spark.readStream.schema("text string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    fresh = ingest.deduplicate_texts(stream, "at", "90 minutes").select("text", "at")

    def put(hour, texts):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.timestamp_seconds(F.lit(3600 * hour)).alias("at"))
        rows.coalesce(1).write.mode("append").parquet(source)

    def run():
        query = fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return max(o["numRowsTotal"] for p in query.recentProgress[-1:] for o in p["stateOperators"])

    sizes = []
    for hour in range(1, 11):
        put(hour, [f"text {hour} {i}" for i in range(20)] * 2 + [f"text {hour - 1} 0"])
        sizes.append(run())
    assert max(sizes[3:]) <= 70 and sizes[-1] <= sizes[4]
    got = [r.text for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) == 201  # each once, the copies of the hour before included
    # later than the horizon: behind the watermark a row is dropped, a new row of old content passes again
    put(11, ["text 1 5"])
    run()
    assert [r.text for r in spark.read.parquet(out).collect()].count("text 1 5") == 2
