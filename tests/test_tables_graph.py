import pytest
from pyspark.sql import functions as F

from foliomill.operators import flags, graph, store, triage, vectors
from foliomill.operators.providers import HashingProvider, with_retries
from foliomill.sources import files
from foliomill.streaming import ingest


def edges(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, neighbor_id long, similarity double")


def test_components_of_chains_pairs_and_singles(spark):
    chain = [(i, i + 1, 0.9) for i in range(1, 200)] + [(500, 501, 0.9), (501, 500, 0.8), (900, 900, 1.0), (7, 9999, 0.9)]
    e = graph.undirected(edges(spark, chain))
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 201), 500, 501, 900]], "node long")
    got = {r.node: r.component for r in graph.components_of(nodes, e).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {500: 500, 501: 500, 900: 900}
    assert {(r.component, r.members) for r in graph.cluster_sizes(graph.components_of(nodes, e)).collect()} == {(1, 200), (500, 2)}
    assert graph.connected_components(edges(spark, []), "chunk_id", "neighbor_id").count() == 0


def test_components_equal_union_find_on_random_graphs(spark):
    import random

    rng = random.Random(1)
    pairs = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(220)]
    parent = {i: i for i in range(1, 301)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {i: root(i) for a, b in pairs if a != b for i in (a, b)}


def test_degrees_neighbours_documents_and_highlight(spark):
    e = graph.undirected(edges(spark, [(2, 1, 0.8), (1, 2, 0.9), (1, 3, 0.7), (3, 3, 1.0)]))
    assert {tuple(r) for r in e.collect()} == {(1, 2, 0.9), (1, 3, 0.7)}
    assert {tuple(r) for r in graph.degrees(e).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert [tuple(r) for r in graph.neighbours(e, 1).collect()] == [(2, 0.9), (3, 0.7)]
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "node long, document string")
    assert [tuple(r) for r in graph.document_graph(e, owners).collect()] == [("a", "b", 1, 0.9)]
    nodes, none = owners.select("node"), spark.createDataFrame([], "chunk_id long")
    assert {r.node: r.value for r in graph.highlight(nodes, e, none).collect()} == {1: 2.0, 2: 1.0, 3: 1.0}
    got = {r.node: r.value for r in graph.highlight(nodes, e, spark.createDataFrame([(1,)], "chunk_id long")).collect()}
    assert got == {1: 5.0, 2: 0.5, 3: 0.5}


def test_vectors_rank_before_threshold_and_skip_zero_and_null(spark):
    rows = [(i, [1.0, 0.1 * i], None, None) for i in range(5)] + [(7, [0.0, 0.0], None, None), (8, None, None, None), (9, [1.0, 0.0], "runt", None), (10, [1.0, 0.0], "runt", "true")]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, section_type string, retrieval_override string")
    got = vectors.knn_edges(chunks, k=2, threshold=0.0, block=2)
    assert {r.chunk_id for r in got.collect()} == {0, 1, 2, 3, 4, 10} and got.count() == 12
    assert vectors.knn_edges(chunks, k=1, threshold=0.9999).where("chunk_id = 4").count() == 0
    assert [r.chunk_id for r in vectors.search(chunks, [1.0, 0.0], 3).collect()] == [0, 10, 1]
    tables = {b: sorted(map(tuple, vectors.knn_edges(chunks, 3, 0.5, b).select("chunk_id", "neighbor_id").collect())) for b in (2, 4096)}
    assert tables[2] == tables[4096]


def test_each_flag_fires_and_a_clean_document_has_none(spark):
    docs = [("ok", "done", 1, None, "Acme", "B", "other"), ("rail", "review", 1, "x", None, None, "other"), ("none", "done", 2, None, None, None, "other"), ("thin", "done", 9, None, None, None, "other"), ("vis", "done", 1, None, "Acme (see cover)", "r" * 41, None)]
    documents = spark.createDataFrame(docs, "document_id string, status string, page_count int, cleaning_warning string, manufacturer string, revision string, doc_type string")
    rows = [("ok", 80, "text", None, None), ("rail", 80, "text", None, "true"), ("thin", 14, "text", None, None), ("thin", 9, "text", "runt", None), ("vis", 80, "vision", None, None)]
    chunks = spark.createDataFrame(rows, "document_id string, token_count int, extraction_path string, section_type string, retrieval_override string")
    got = {r.document_id: ([f.key for f in r.flags], r.worst) for r in flags.document_flags(documents, chunks).collect()}
    assert got == {
        "ok": ([], None), "rail": (["cleaning-safety-rail"], "critical"), "none": (["no-chunks"], "critical"), "thin": (["low-content-density", "short-chunks"], "warning"),
        "vis": (["heavily-vision", "manufacturer-prose", "revision-prose", "no-doc-type"], "warning"),
    }
    assert {r.document_id for r in flags.chunk_stats(chunks).where("has_override").collect()} == {"rail"}


def test_pixels_blank_flat_textured(spark):
    import random

    rng = random.Random(0)
    rows = [("blank", x, y, 255) for x in range(40) for y in range(40)] + [("bands", x, y, 40 if y // 8 % 2 else 200) for x in range(40) for y in range(40)]
    rows += [("text", x, y, rng.choice([0, 255])) for x in range(40) for y in range(40)] + [("tiny", 0, 0, 0)]
    figures = triage.pixel_figures(spark.createDataFrame(rows, "page_id string, x int, y int, gray int"))
    got = {r.page_id: (r.blank, r.flat) for r in figures.collect()}
    assert got == {"blank": (True, True), "bands": (False, True), "text": (False, False), "tiny": (False, False)}
    pages = spark.createDataFrame([(p, "") for p in got], "page_id string, text string")
    assert {r.page_id: r.extraction_path for r in triage.triage(pages, figures).collect()} == {"blank": "text", "bands": "text", "text": "vision", "tiny": "vision"}


def test_store_mutations(spark):
    docs = spark.createDataFrame([("a", "done", None, "h1"), ("b", "failed", "late", "h2")], "document_id string, status string, error_message string, file_hash string")
    chunks = spark.createDataFrame([("a", 1, [1.0], {"k": "v"}), ("b", 2, [1.0], None)], "document_id string, chunk_id int, embedding array<float>, metadata map<string,string>")
    clean = spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, page int")
    tables, ids = {"documents": docs, "chunks": chunks, "pages_clean": clean}, docs.where("document_id = 'b'")
    assert [t.count() for t in store.delete_documents(tables, ids).values()] == [1, 1, 1]
    for stage, left in (("clean", [2, 2, 1]), ("chunk", [2, 1, 2]), ("embed", [2, 2, 2])):
        out = store.reprocess(tables, ids, stage)
        assert [out[k].count() for k in ("documents", "chunks", "pages_clean")] == left
        assert tuple(out["documents"].where("document_id = 'b'").first()) == ("b", "queued", None, "h2")
    assert out["chunks"].where("embedding is null").first().document_id == "b"
    with pytest.raises(ValueError):
        store.reprocess(tables, ids, "extract")
    assert store.patch(docs, spark.createDataFrame([("a", "review")], "document_id string, status string"), "document_id").where("status = 'review'").count() == 1
    assert store.update_where(docs, F.col("document_id") == "a", {"status": F.lit("x")}).where("status = 'x'").count() == 1
    assert store.insert(docs, spark.createDataFrame([("c", "h3")], "document_id string, file_hash string")).where("status is null").count() == 1
    on = store.retrieval_override(chunks, F.lit(True), True)
    assert [r.metadata["retrieval_override"] for r in on.collect()] == ["true", "true"]
    assert all("retrieval_override" not in r.metadata for r in store.retrieval_override(on, F.lit(True), False).collect())


def test_files_ingest_upload_and_pages(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, body in (("b.pdf", b"one"), ("a.pdf", b"one"), ("c.pdf", b"two"), ("d.txt", b"three")):
        (inbox / name).write_bytes(body)
    documents = spark.createDataFrame([], "document_id string, file_name string, file_hash string, status string")
    found = files.document_files(spark, str(inbox))
    rows, tally = files.ingest(found, documents)
    assert sorted(r.file_name for r in rows.collect()) == ["a.pdf", "c.pdf"] and tuple(tally.first()) == (2, 1, 0, 3)
    rows2, tally = files.ingest(found, rows)
    assert rows2.count() == 0 and tuple(tally.first()) == (0, 3, 0, 3)
    for names in ([], ["a.pdf", "b.txt"]):
        with pytest.raises(ValueError):
            files.check_upload_names(names)
    files.check_upload_names(["A.PDF"])
    done = spark.createDataFrame([], "document_id string, page int")

    def extractor(content):
        if content == b"two":
            raise OSError("broken")
        return ["p1", "p2"]

    pages, failures = files.extract_pages(found.dropDuplicates(["file_hash"]), done, extractor)
    assert {(r.page, r.text) for r in pages.collect()} == {(1, "p1"), (2, "p2")} and [r.error_message for r in failures.collect()] == ["OSError: broken"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.page_files(spark, str(tmp_path / "empty"))
    (tmp_path / "w" / "doc1").mkdir(parents=True)
    for i in (2, 1000):
        (tmp_path / "w" / "doc1" / f"{i:03d}.md").write_text("<!-- path: vision -->\n<!-- structural: true -->\nhello")
    got = files.page_files(spark, str(tmp_path / "w")).orderBy("page").collect()
    assert [tuple(r) for r in got] == [("doc1", 2, "vision", True, "hello"), ("doc1", 1000, "vision", True, "hello")]
    table = spark.createDataFrame([("d", '["b", "a"]'), ("e", "broken")], "document_id string, json string")
    assert files.read_overrides(table).count() == 2
    added = spark.createDataFrame([("d", "0"), ("d", "a")], "document_id string, normalized string")
    assert files.write_overrides(table, added).first().json == '["0","a","b"]'
    p = spark.createDataFrame([("d", i, f"t{i}") for i in (3, 1, 2, 4)], "document_id string, page int, text string")
    assert files.prompt_text(p).first().prompt_text == "t1\n\nt2\n\nt3"


def test_stream_ingests_each_content_once(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    inbox.mkdir()
    for name, body in (("a.pdf", b"one"), ("b.pdf", b"one"), ("c.pdf", b"two")):
        (inbox / name).write_bytes(body)
    ingest.ingest_stream(ingest.watch(spark, str(inbox)), table, state).awaitTermination()
    assert sorted(r.file_name for r in spark.read.parquet(table).collect()) == ["a.pdf", "c.pdf"]
    (inbox / "d.pdf").write_bytes(b"two")
    (inbox / "e.pdf").write_bytes(b"three")
    ingest.ingest_stream(ingest.watch(spark, str(inbox)), table, state).awaitTermination()
    assert sorted(r.file_name for r in spark.read.parquet(table).collect()) == ["a.pdf", "c.pdf", "e.pdf"]


def test_providers_and_retries():
    assert HashingProvider(8).embed(["a b", ""])[1] == [0.0] * 8 and HashingProvider(8).embed(["x"]) == HashingProvider(8).embed(["x"])
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError
        return "ok"

    assert with_retries(flaky, sleep=waits.append)() == "ok" and waits == [2.0, 4.0, 8.0]
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), retry=lambda e: False, sleep=waits.append)()
