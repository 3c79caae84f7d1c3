from pyspark.sql import functions as F

from foliomill.operators.providers import HashingProvider
from foliomill.plans.documents import DocumentPipeline
from foliomill.queries import DOCUMENT_SPAN, QUERIES, bounded_documents

BODY = ["alpha", "bravo", "carbon", "delta", "echo", "fox", "golf", "hotel", "india", "julia"]


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_furniture_of_the_given_tables_is_stripped(spark):
    pages = bounded_documents(spark, "/root/testdata/sf0.01")
    report = DocumentPipeline(HashingProvider(8), min_ratio=0.1).clean(pages).report
    assert report.where("stripped_lines > 0").count() > 0 and report.agg(F.max("total_pages")).first()[0] > 1


def test_query_strips_furniture_across_pages(spark, tmp_path):
    body = [f"Body {b} " + "goes on and on over the line " * 8 + "here." for b in BODY]
    lines = [f"{x}\nMore {b} text, all of its own.\nStill more {b}.\nAnd {b} again.\nOnce {b} too.\nThen {b} too.\nLast {b} too." for x, b in zip(body, BODY)]
    rows = [(i, f"{x}\nRev 2 page {i} of 10", "s") for i, x in enumerate(lines)]
    got = QUERIES["document_pipeline"](spark, folder(spark, tmp_path, rows)).collect()
    content = "\n\n".join("\n\n".join(x.split("\n")) for x in lines)
    assert [(r.document_id, r.chunk_index, r.token_count) for r in got] == [("s/0", 0, len(content) // 4)]


def test_chunks_cross_pages_and_repeated_headings_are_text(spark, tmp_path):
    rows = [(i, f"Notice\nPart {b}\nText {b} is here.", "s") for i, b in enumerate(BODY[:4])] + [(4, "Notice\nIt ends.", "other")]
    got = QUERIES["document_chunks"](spark, folder(spark, tmp_path, rows)).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.section, r.page_start, r.page_end) for r in got] == [("other/0", "Notice", 4, 4), ("s/0", None, 0, 3)]
    assert got[1].content == "\n\n".join(f"Notice\n\nPart {b}\n\nText {b} is here." for b in BODY[:4])


def test_a_hot_source_makes_bounded_documents(spark, tmp_path):
    rows = [(i, f"line {i}", "hot") for i in range(0, 2 * DOCUMENT_SPAN + 5)]
    sizes = bounded_documents(spark, folder(spark, tmp_path, rows)).groupBy("document_id").count().collect()
    assert sorted(tuple(r) for r in sizes) == [("hot/0", DOCUMENT_SPAN), ("hot/1", DOCUMENT_SPAN), ("hot/2", 5)]
