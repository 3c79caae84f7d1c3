import datetime

from pyspark.sql import functions as F

from foliomill.operators import store, views
from foliomill.plans.documents import DocumentPipeline
from foliomill.plans.ordering import positions
from foliomill.queries import CountingProvider

BODY = ["alpha", "bravo", "carbon", "delta", "echo", "fox", "golf", "hotel", "india", "julia"]


def test_an_override_is_written_and_later_runs_see_it(spark):
    pages = spark.createDataFrame([(d, i + 1, f"Body {b}.\n\nFoot") for d in "ab" for i, b in enumerate(BODY)], "document_id string, page int, text string")
    documents = spark.createDataFrame([(d, "queued", None, {"kept": "yes"}) for d in "ab"], "document_id string, status string, error_message string, metadata map<string,string>")
    pipeline = DocumentPipeline(CountingProvider())
    stopped = pipeline.process(documents, pages)
    assert stopped.chunks.count() == 0 and {r.metadata["kept"] for r in stopped.documents.collect()} == {"yes"}
    ids = spark.createDataFrame([("a",)], "document_id string")
    told = pipeline.proceed_anyway(stopped.documents, ids, pages)
    found = {r.document_id: r.metadata for r in told.documents.collect()}
    assert found["a"][store.PROCEED] == "true" and found["a"]["kept"] == "yes" and store.PROCEED not in found["b"]
    assert [r.document_id for r in told.chunks.select("document_id").distinct().collect()] == ["a"]
    again = pipeline.process(told.documents, pages)
    assert [r.document_id for r in again.chunks.select("document_id").distinct().collect()] == ["a"]
    nothing = store.set_proceed(documents.withColumn("metadata", F.lit(None).cast("map<string,string>")), ids)
    assert {r.document_id: r.metadata for r in nothing.collect()} == {"a": {store.PROCEED: "true"}, "b": None}


def test_documents_by_arrival(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    table = spark.createDataFrame([("b", at(2)), ("a", at(2)), ("c", at(1)), ("d", None)], "document_id string, created_at timestamp")
    for newest, expected in ((True, ["a", "b", "c", "d"]), (False, ["c", "a", "b", "d"])):
        placed = positions(views.documents_in_order(table, newest)).orderBy("position").collect()
        assert [r.document_id for r in placed] == expected and [r.position for r in placed] == [0, 1, 2, 3]


def test_tables_and_settings_are_checked(spark):
    tables = {"documents": spark.createDataFrame([], "document_id string, status int")}
    wanted = {"documents": {"document_id": "string", "status": "string", "metadata": "map<string,string>"}, "chunks": {"chunk_id": "string"}}
    assert views.check_tables(tables, wanted) == [("documents", "status", "is int, not string"), ("documents", "metadata", "missing column"), ("chunks", None, "missing table")]
    assert views.check_tables(tables, {"documents": {"document_id": "string"}}) == []
    assert views.check_settings({"A": "x", "B": " ", "C": None}, ("A", "B", "C", "D")) == ["B", "C", "D"]
