"""File sources: directories of documents, page files, JSON side files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.functions.text import DOC_TYPES, read_page_file
from foliomill.operators.triage import raster_judged, raster_of
from foliomill.plans.workspace import materialize


#: a file that can't be read costs its content and not the whole job; its path can still be listed
UNREADABLE_LEFT_OUT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def document_files(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, file_name, file_hash, content) of the files of a directory, not of those below it.

    Rows with their hash or content are those of readable files; path and file_name alone
    are read from the listing, of all files (``ingest_results`` tells the difference).
    """
    return binary_files(spark, directory, pathGlobFilter=pattern, recursiveFileLookup="false")


def binary_files(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(path, file_name, file_hash, content) of files or of a directory's."""
    files = spark.read.format("binaryFile").options(**UNREADABLE_LEFT_OUT, **options).load(paths)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_hash"), "content")


def ingest_results(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, file_name, document_id, duplicate, failed) of every file, in path order if sorted by path.

    The first file by path of a hash that ``documents`` lacks is new; others of known or
    repeated content are duplicates; a file without content could not be read and failed, as
    have files that are listed and have no row once contents are read.
    Only names and hashes are kept, and they are written once, so contents are read once.
    """
    read = materialize(files.select("path", "file_name", "file_hash"), "ingest-files")
    lost = files.select("path", "file_name").join(read.select("path"), "path", "left_anti")
    named = read.unionByName(materialize(lost.withColumn("file_hash", F.lit(None).cast("string")), "ingest-lost"))
    first = named.where("file_hash is not null").groupBy("file_hash").agg(F.min("path").alias("first_path"))
    known = documents.select("file_hash", F.lit(True).alias("known")).distinct()
    judged = named.join(first, "file_hash", "left").join(known, "file_hash", "left")
    failed = F.col("file_hash").isNull()
    duplicate = ~failed & (F.coalesce("known", F.lit(False)) | (F.col("path") != F.col("first_path")))
    return judged.select("path", "file_name", F.col("file_hash").alias("document_id"), duplicate.alias("duplicate"), failed.alias("failed"))


def ingest(files: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, tallies): the first file by path of each hash that ``documents`` lacks is queued."""
    results = materialize(ingest_results(files, documents), "ingest-results")
    fresh = results.where("not duplicate and not failed")
    rows = fresh.select("document_id", "file_name", F.col("document_id").alias("file_hash"), F.lit("queued").alias("status"))
    tally = results.agg(F.count_if(~F.col("duplicate") & ~F.col("failed")).alias("ingested"), F.count_if("duplicate").alias("duplicates"), F.count_if("failed").alias("failed"), F.count(F.lit(1)).alias("total"))
    return rows, tally


def store_files(files: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(file_hash, content) that a content-addressed store lacks: each content once."""
    fresh = files.where("file_hash is not null").groupBy("file_hash").agg(F.first("content").alias("content"))
    return fresh if store is None else fresh.join(store.select("file_hash"), "file_hash", "left_anti")


def check_upload_names(names: list[str]) -> None:
    """All names of an upload must end in .pdf, in either case, and there must be one."""
    wrong = [n for n in names if not n.lower().endswith(".pdf")]
    if not names or wrong:
        raise ValueError(f"not PDF files: {wrong}" if wrong else "no files")


def page_files(spark: SparkSession, directory: str) -> DataFrame:
    """(document_id, page, extraction_path, structural, text) of ``<directory>/<document>/<page>.md``; pages are numbers."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(directory, wholetext=True).withColumn("path", F.input_file_name())
    if files.isEmpty():
        raise FileNotFoundError(f"no pages in {directory}")
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.md$", 1).alias("document_id"), F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int").alias("page"), read_page_file(F.col("value")).alias("x"))
    return named.select("document_id", "page", "x.extraction_path", "x.structural", "x.text")


def extract_pages(files: DataFrame, done: DataFrame, extractor: Callable[[bytes], list], page_counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages that ``done`` (document_id, page) lacks; failures).

    Pages are document_id, page, text, nothing (blank or flat), image; failures are
    document_id, error_message. ``extractor`` turns a file's bytes into pages, each a text or a
    (text, nothing, image) triple; in place of ``nothing`` there may be the rendered page as
    (gray samples, width, height, stride), from which it is judged here. Pages are numbered from 1; those done already are left
    out before anything is kept of them, and files whose ``page_counts`` (document_id,
    page_count) are all done are not opened. A file that fails gives a failure and no page,
    and the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, known in zip(*(batch.column(i).to_pylist() for i in range(3))):
                known = set(known or ())
                try:
                    found = [(n, *(x if isinstance(x, tuple) else (x, False, None))) for n, x in enumerate(extractor(content), 1) if n not in known]
                    rows = [(key, n, text, _shows_nothing(page), image, None) for n, text, page, image in found]
                except Exception as error:  # one unreadable file must not fail its whole task
                    rows = [(key, None, None, None, None, f"{type(error).__name__}: {error}")]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["document_id", "page", "text", "nothing", "image", "error_message"])

    kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
    known = done.groupBy("document_id").agg(F.collect_set("page").alias("known"))
    todo = files.select(F.col("file_hash").alias("document_id"), "content").join(known, "document_id", "left")
    if page_counts is not None:
        todo = todo.join(page_counts.select("document_id", "page_count"), "document_id", "left").where("page_count is null or size(known) < page_count or known is null").drop("page_count")
    shape = "document_id string, page int, text string, nothing boolean, image binary, error_message string"
    found = materialize(todo.select("document_id", "content", "known").mapInArrow(run, shape), "extracted")
    return found.where("error_message is null").drop("error_message"), found.where("error_message is not null").select("document_id", "error_message")


def _shows_nothing(page: bool | tuple | None) -> bool:
    """As the extractor says, or as the rendered page shows."""
    if isinstance(page, tuple):
        _, blank, flat = raster_judged(raster_of(*page))
        return blank or flat
    return bool(page)


def read_overrides(table: DataFrame) -> DataFrame:
    """(document_id, normalized) from rows (document_id, json) with arrays of lines; broken JSON counts as none."""
    return table.select("document_id", F.explode(F.array_distinct(F.from_json("json", "array<string>"))).alias("normalized"))


def write_overrides(old: DataFrame, added: DataFrame) -> DataFrame:
    """(document_id, json): sorted arrays of the old and the added lines."""
    both = read_overrides(old).unionByName(added.select("document_id", "normalized"))
    return both.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_set("normalized"))).alias("json"))


def prompt_text(pages: DataFrame, first: int = 3) -> DataFrame:
    """(document_id, prompt_text): the first pages that there are, in order, joined by blank lines."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page"))
    low = pages.select("document_id", "page", "text").withColumn("place", place).where(F.col("place") <= first)
    texts = low.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    return texts.select("document_id", F.array_join(F.col("x.text"), "\n\n").alias("prompt_text"))


METADATA_QUESTION = """Below are the first pages of a technical document. Answer with one JSON object and nothing else, with the keys
manufacturer, panel_model, doc_type (one of {kinds}) and revision; use null for what the pages don't say.

"""


def metadata_prompt(pages: DataFrame, first: int = 3) -> DataFrame:
    """(document_id, prompt): the question about a document's metadata with its first pages."""
    question = METADATA_QUESTION.format(kinds=", ".join(DOC_TYPES))
    return prompt_text(pages, first).select("document_id", F.concat(F.lit(question), "prompt_text").alias("prompt"))
