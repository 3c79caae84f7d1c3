from foliomill.operators import views


def test_states_guards_and_forms(spark):
    rows = [(1, None, None, 80, "a", 1, "x"), (2, "runt", None, 3, "a", 0, None), (3, "runt", "true", 3, "b", 0, "z"), (4, None, None, 14, "b", 1, "w")]
    chunks = spark.createDataFrame(rows, "chunk_id long, section_type string, retrieval_override string, token_count int, document_id string, chunk_index int, content string")
    assert {tuple(r) for r in views.chunk_states(chunks).collect()} == {(1, "normal", False), (2, "excluded", False), (3, "flagged", True), (4, "flagged", True)}
    assert [r.chunk_id for r in views.excluded(chunks).collect()] == [2] and views.set_aside(chunks).count() == 2
    assert [r.chunk_id for r in views.document_chunks(chunks, "a").collect()] == [2, 1]
    assert [views.chunk_content(chunks, i) for i in (1, 2, 99)] == ["x", "", ""]
    docs = spark.createDataFrame([("a", "done", "f.pdf", 1, " old ", False), ("b", "chunking", None, 2, "m", False)], "document_id string, status string, file_name string, created_at int, manufacturer string, metadata_confirmed boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    assert {tuple(r) for r in views.may_reprocess(docs, asked).collect()} == {("a", "ok"), ("b", "busy"), ("c", "missing")}
    assert [r.line.split() for r in views.status_lines(docs).collect()] == [["b", "chunking", "?"], ["a", "done", "f.pdf"]]
    assert [tuple(r) for r in views.document_colours(docs).collect()] == [("a", 0, 0), ("b", 1, 138)]
    forms = spark.createDataFrame([("a", "  ")], "document_id string, manufacturer string")
    got = {r.document_id: (r.manufacturer, r.metadata_confirmed) for r in views.confirm_metadata(docs, forms).collect()}
    assert got == {"a": (None, True), "b": ("m", False)}
    assert {r.status for r in views.approve(docs, asked).collect()} == {"done"}
    vec = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "chunk_id long, embedding array<float>")
    assert [tuple(r) for r in views.check_vectors(vec, 2).collect()] == [(1, 1)]


def test_reports_round_trip(spark):
    report = spark.createDataFrame([("d", 3, 10, 2, 20.0, True)], "document_id string, total_pages long, total_lines long, stripped_lines long, stripped_pct double, safety_rail_triggered boolean")
    lines = spark.createDataFrame([("d", "x", 5), ("d", "y", 9)], "document_id string, normalized string, page_count long")
    made = views.report_json(report, lines)
    assert made.first().json.index('"y"') < made.first().json.index('"x"')
    assert views.read_report(made).collect() == report.collect()
    broken = spark.createDataFrame([("e", "{nope"), ("f", None)], "document_id string, json string")
    assert [r.total_pages for r in views.read_report(broken).collect()] == [None, None]


def test_links(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.71)], "source long, target long, similarity double")
    got = {(r.source, round(r.width, 3), r.lit) for r in views.lit_links(edges, spark.createDataFrame([(1,)], "chunk_id long")).collect()}
    assert got == {(1, 1.6, True), (2, 0.5, False)}
