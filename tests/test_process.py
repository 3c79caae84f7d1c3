"""Runs with states, failures and repeats; rows that used to come out wrong."""

import pytest
from pyspark.sql import functions as F

from foliomill.operators import graph, store, triage, vectors
from foliomill.operators.providers import HashingProvider, PatientProvider, is_transient, with_timeout
from foliomill.plans.documents import DocumentPipeline
from foliomill.plans.ordering import running
from foliomill.plans.workspace import delete_working_files, materialize, shared_dir, spread
from foliomill.queries import CountingProvider
from foliomill.sources import files

BODY = ["alpha", "bravo", "carbon", "delta", "echo", "fox", "golf", "hotel", "india", "julia"]


def pages(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "document_id string, page int, text string")


def documents(spark, *ids):
    rows = [(i, "queued", "old", None, None, {}) for i in ids]
    return spark.createDataFrame(rows, "document_id string, status string, error_message string, doc_type string, revision string, metadata map<string,string>")


class Failing(CountingProvider):
    def embed(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError("no vector")
        return super().embed(texts)


def states(done):
    return {r.document_id: (r.status, r.error_message) for r in done.documents.collect()}


def test_failures_stay_apart_and_no_error_text_becomes_a_page(spark):
    data = spark.createDataFrame([("h1", b"one\ntwo\nthree"), ("h2", b"bad"), ("h3", b"x\ny")], "file_hash string, content binary")

    def extractor(content):
        if content == b"bad":
            raise ValueError("broken pdf")
        return content.decode().split("\n")

    done = spark.createDataFrame([("h1", 2), ("h3", 1), ("h3", 2)], "document_id string, page int")
    counts = spark.createDataFrame([("h3", 2), ("h1", 3)], "document_id string, page_count int")
    got, failures = files.extract_pages(data, done, extractor, counts)
    assert sorted((r.document_id, r.page, r.text) for r in got.collect()) == [("h1", 1, "one"), ("h1", 3, "three")]
    assert [tuple(r) for r in failures.collect()] == [("h2", "ValueError: broken pdf")]


def test_prompt_takes_the_first_pages_there_are(spark):
    p = spark.createDataFrame([("d", n, f"p{n}") for n in (11, 5, 9, 7)] + [("e", 2, None)], "document_id string, page int, text string")
    assert {r.document_id: r.prompt_text for r in files.prompt_text(p).collect()} == {"d": "p5\n\np7\n\np9", "e": ""}
    assert files.metadata_prompt(p).where("document_id = 'd'").first().prompt.endswith("p5\n\np7\n\np9")


def test_edges_leave_out_unusable_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.1, 0.0]), (7, None), (8, [])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").withColumn("section_type", F.lit(None).cast("string")).withColumn("retrieval_override", F.lit(None).cast("string"))
    assert sorted((r.chunk_id, r.neighbor_id) for r in vectors.knn_edges(chunks, threshold=0.0).collect()) == [(1, 2), (2, 1), (5, 6), (6, 5)]
    assert vectors.search(chunks, vectors.query_vector("  ", CountingProvider())).count() == 0
    assert [r.chunk_id for r in vectors.search(chunks, [1.0, 0.0]).collect()] == [1, 2]


def test_embedding_keeps_repeated_ids_and_reports_errors(spark):
    chunks = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "c", [9.0])], "chunk_id long, content string, embedding array<float>")
    got = vectors.embed_pending(chunks, CountingProvider())
    assert sorted((r.chunk_id, r.content, r.embedding[0]) for r in got.collect()) == [(1, "a", 1.0), (1, "b", 1.0), (2, "c", 9.0)]
    bad = chunks.unionByName(spark.createDataFrame([(3, "poison", None)], chunks.schema))
    errors = {r.chunk_id for r in vectors.embed(bad, Failing(), batch=1).where("embed_error is not null").collect()}
    assert errors == {3}
    with pytest.raises(Exception, match="no vector"):
        vectors.embed_pending(bad, Failing(), batch=1).collect()


def test_process_states_rail_and_retry(spark):
    prose = [f"Body {b} " + "and more of it " * 6 + "here." for b in BODY]
    p = pages(spark, prose, "good").unionByName(pages(spark, [f"Body {b}.\n\nFoot" for b in BODY], "stopped")).unionByName(pages(spark, ["poison here " * 10], "sick"))
    docs = documents(spark, "good", "stopped", "sick", "lost", "waiting")
    lost = spark.createDataFrame([("lost", "OSError: gone")], "document_id string, error_message string")
    pipeline = DocumentPipeline(Failing(), patient=False)
    done = pipeline.process(docs, p, failures=lost)
    assert states(done) == {"good": ("review", None), "stopped": ("review", None), "sick": ("failed", "ValueError: no vector"), "lost": ("failed", "OSError: gone"), "waiting": ("queued", "old")}
    rows = {r.document_id: r for r in done.documents.collect()}
    assert "cleaning_warning" in rows["stopped"].metadata and not rows["good"].metadata
    assert {r.document_id for r in done.chunks.collect()} == {"good", "sick"}
    # again with a sound provider: only what is missing is made
    again = DocumentPipeline(CountingProvider(), patient=False).retry(done.documents, docs.where("document_id = 'sick'"), p, done.chunks, ask=False)
    assert states(again)["sick"] == ("review", None) and again.chunks.count() == done.chunks.count() and again.chunks.where("embedding is null").count() == 0
    with pytest.raises(KeyError):
        pipeline.retry(docs, spark.createDataFrame([("nobody",)], "document_id string"), p)


def test_stopped_documents_keep_their_chunks_and_restored_lines_come_back(spark):
    p = pages(spark, [f"Body {b}.\n\nFoot" for b in BODY])
    pipeline = DocumentPipeline(CountingProvider(), patient=False)
    proceed = spark.createDataFrame([("d",)], "document_id string")
    first = pipeline.process(documents(spark, "d"), p, proceed=proceed, ask=False)
    content = first.chunks.first().content
    assert "Foot" not in content
    tables = {"documents": first.documents, "pages": p, "pages_clean": first.cleaned.pages, "clean_report": first.cleaned.report, "chunks": first.chunks}
    stopped = pipeline.reprocess(tables, proceed, "clean")
    assert stopped.chunks.collect() == first.chunks.collect() and "cleaning_warning" in stopped.documents.first().metadata
    for stage in ("chunk", "embed"):
        anew = pipeline.reprocess(tables, proceed, stage, proceed=proceed)
        assert anew.chunks.first().content == content and anew.chunks.where("embedding is null").count() == 0
    none = spark.createDataFrame([], "document_id string, normalized string")
    line = spark.createDataFrame([("d", "Foot")], "document_id string, normalized string")
    restored, overrides = pipeline.restore_furniture(first.documents, p, first.chunks, none, line)
    assert [tuple(r) for r in overrides.collect()] == [("d", "Foot")] and restored.chunks.first().content.count("Foot") == 10


def test_earlier_clean_pages_are_used_again(spark):
    p = pages(spark, [f"Body {b}.\n\nFoot" for b in BODY])
    pipeline = DocumentPipeline(CountingProvider(), patient=False)
    first = pipeline.clean(p)
    changed = first.pages.withColumn("text", F.lit("kept"))
    assert {r.text for r in pipeline.clean(p, earlier=(changed, first.report)).pages.collect()} == {"kept"}
    assert pipeline.clean(p.where("page < 9"), earlier=(changed, first.report)).pages.where("text = 'kept'").count() == 0


def test_patches_write_nulls_and_repeated_keys_stay_one_row(spark):
    docs = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "document_id string, v string, n int")
    patches = spark.createDataFrame([("a", None), ("b", "p"), ("b", "q"), ("z", "r")], "document_id string, v string")
    assert sorted(map(tuple, store.patch(docs, patches, "document_id").collect())) == [("a", None, 1), ("b", "q", 2)]
    settings = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, value string, version int")
    assert store.get_setting(settings, "k") == "new" and store.get_setting(settings, "none") is None
    assert store.by_key(docs, "document_id", "b").first().n == 2 and store.by_key(docs, "document_id", "c").count() == 0 and store.reachable(docs)


def test_transcription_cuts_loops_and_blank_pages(spark):
    rows = [("d", 1, "kept", b"", "text"), ("d", 2, "t", b"123", "vision"), ("d", 3, "t", b"1234", "vision"), ("d", 4, "t", b"12345", "vision"), ("d", 5, "t", None, "vision")]
    p = spark.createDataFrame(rows, "document_id string, page int, text string, image binary, extraction_path string")
    got = {r.page: (r.text, r.error) for r in triage.transcribe(p, CountingProvider()).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "kept", 2: "again", 3: "", 4: "5 bytes", 5: "t"} and got[5][1].startswith("TypeError")


def test_patience():
    calls = []

    class Flaky(HashingProvider):
        def complete(self, prompt):
            calls.append(prompt)
            raise (ConnectionError("lost") if len(calls) < 3 else KeyError("final"))

    with pytest.raises(KeyError):
        PatientProvider(Flaky(), sleep=lambda s: None).complete("x")
    assert len(calls) == 3 and is_transient(TimeoutError()) and not is_transient(ValueError())
    with pytest.raises(TimeoutError):
        with_timeout(__import__("time").sleep, 0.05)(1)


def test_positions_sums_and_dense_clusters(spark):
    table = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = running(table, [F.col("v")], ("id",)).orderBy("v").collect()
    assert [r.position for r in got] == list(range(1000))
    assert [r.before_id for r in got] == [sum(x.id for x in got[:n]) for n in range(1000)]
    assert running(table.limit(0), [F.col("v")], ("id",)).count() == 0
    comp = spark.createDataFrame([(4, 2), (2, 2), (1, 1), (9, 9)], "node long, component long")
    assert {(r.node, r.cluster) for r in graph.dense_clusters(comp).collect()} == {(1, 0), (2, 1), (4, 1), (9, 2)}


def test_working_files_and_partitions(spark):
    import os

    table = materialize(spark.range(10))
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and table.count() == 10
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    assert os.listdir(folder)
    delete_working_files(spark)
    assert not os.path.exists(folder)
