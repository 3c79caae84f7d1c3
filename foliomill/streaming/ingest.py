"""Streaming ingest: a watched directory whose new files join the documents once and run through all stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomill.plans.workspace import materialize, path_exists, settings, working_files
from foliomill.sources.files import UNREADABLE_LEFT_OUT, binary_files, ingest_results
from foliomill.streaming.batches import BatchTables, HashStore, committed

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
DOCUMENT_FIELDS = ("doc_type", "manufacturer", "panel_model", "revision")
#: tables of a store that ``process_stream`` fills
PROCESSED = ("results", "pages", "failures", "documents", "pages_clean", "clean_report", "chunks")
#: a batch's pages are cleaned, chunked and embedded in slices of documents of about so many bytes of Parquet, and in so many slices at most
SLICE_BYTES, SLICES = 24 << 20, 6
#: while a batch runs, texts are written densely and the shuffle files of each write go with it
SPARING = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def watch(spark: SparkSession, inbox: str, pattern: str = "*.pdf", files_a_batch: int | None = None) -> DataFrame:
    """Stream of (path, file_name, file_hash, modificationTime, content) of files as they appear."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).options(**UNREADABLE_LEFT_OUT).option("pathGlobFilter", pattern)
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    files = reader.load(inbox)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_hash"), "modificationTime", "content")


def listing(spark: SparkSession, inbox: str, pattern: str = "*.pdf", files_a_batch: int = 1000) -> DataFrame:
    """Stream of (path, file_name) of files as they appear, at most so many a batch; ``process_stream`` opens them.

    In this form a file that can't be read has a row in the results, as failed; in ``watch``,
    which has the contents in the stream, it has none.
    """
    files = watch(spark, inbox, pattern, files_a_batch)
    return files.select("path", "file_name")


def opened(batch: DataFrame) -> DataFrame:
    """(path, file_name, file_hash, content) of a bounded batch of paths; those that are gone have neither hash nor content."""
    spark = batch.sparkSession
    paths = [r.path for r in batch.select("path").distinct().collect()]  # at most files_a_batch of ``listing``
    there = [p for p in paths if path_exists(spark, p)]
    gone = spark.createDataFrame([(p, p.rsplit("/", 1)[-1]) for p in paths if p not in set(there)], "path string, file_name string")
    gone = gone.withColumns({"file_hash": F.lit(None).cast("string"), "content": F.lit(None).cast("binary")})
    return binary_files(spark, there).unionByName(gone) if there else gone


def _start(files: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def ingest_stream(files: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Files of unknown content, queued, in the table at the path ``table``; ``ingested`` reads what is committed of it.

    Within a batch the first path of each hash wins; against earlier batches a store of
    hashes, read by their beginnings, decides, so no state grows with the stream. A batch
    that is run again writes the same rows to the same place.
    """
    spark, (folder, name) = files.sparkSession, table.rstrip("/").rsplit("/", 1)

    def add(batch: DataFrame, number: int) -> None:
        tables, known = BatchTables(spark, folder, number, f"{name}_commits"), HashStore(spark, f"{folder}/{name}_hashes")
        if tables.is_committed():
            return
        first = batch.where("file_hash is not null").groupBy("file_hash").agg(F.min_by("file_name", "path").alias("file_name"))
        row = [F.col("file_hash").alias("document_id"), "file_name", "file_hash", F.lit("queued").alias("status")]
        fresh = tables.stage(name, lambda: known.unknown(materialize(first, "stream-files"), number).select(*row))
        known.add(fresh, number)
        tables.commit(fresh.agg(F.count(F.lit(1)).alias("ingested")))

    return _start(files, add, checkpoint, once)


def ingested(spark: SparkSession, table: str) -> DataFrame | None:
    """The documents of ``ingest_stream`` so far."""
    folder, name = table.rstrip("/").rsplit("/", 1)
    found = committed(spark, folder, name, f"{name}_commits")
    return None if found is None else found.drop("batch")


def process_batch(batch: DataFrame, number: int, store: str, pipeline, extractor: Callable[[bytes], list], ask: bool = True) -> None:
    """One batch of files (path, file_name, file_hash, content) through intake and all stages into the tables of ``store``.

    Every stage's rows are written before the next one reads them. A batch that was ended
    between stages goes on, when it is run again, with the first stage that had not been
    written; a committed one changes nothing. A file that can't be read or embedded fails
    alone, as in ``DocumentPipeline.process``. What lies on disk beside the tables is the
    working files of one stage, and from the pages on those of one slice of the documents.
    """
    spark = batch.sparkSession
    tables, known = BatchTables(spark, store, number), HashStore(spark, f"{store}/hashes")
    if tables.is_committed():
        return

    def judged() -> DataFrame:
        # alone in the batch first; what is new there may be known from earlier batches
        found = materialize(ingest_results(batch, spark.createDataFrame([], "file_hash string")), "stream-files")
        new = found.where("not duplicate and not failed").select(F.col("document_id").alias("file_hash"))
        fresh = known.unknown(new, number).select(F.col("file_hash").alias("document_id"), F.lit(True).alias("fresh"))
        known_before = ~F.col("failed") & F.col("fresh").isNull()
        return found.join(fresh, "document_id", "left").select("path", "file_name", "document_id", (F.col("duplicate") | known_before).alias("duplicate"), "failed")

    with settings(spark, SPARING):
        with working_files(spark):
            results = tables.stage("results", judged)
        fresh = results.where("not duplicate and not failed").select("path", "file_name", "document_id")
        known.add(fresh.select(F.col("document_id").alias("file_hash")), number)

        if not (tables.whole("pages") and tables.whole("failures")):
            with working_files(spark):
                files = batch.join(fresh.select("path"), "path", "left_semi")
                none = spark.createDataFrame([], "document_id string, page int")
                pages, failures = pipeline.extract(files, none, extractor)
                tables.stage("failures", lambda: failures.groupBy("document_id").agg(F.min("error_message").alias("error_message")))
                tables.stage("pages", lambda: pages)
        pages, failures = tables.stage("pages", lambda: pages), tables.stage("failures", lambda: failures)

        # texts and vectors first: the documents' states tell what has come of them
        missing = [t for t in ("chunks", "pages_clean", "clean_report", "documents") if not tables.whole(t)]
        if missing:
            text = lambda c: F.lit(None).cast("string").alias(c)
            queued = fresh.select("document_id", "file_name", F.col("document_id").alias("file_hash"), F.lit("queued").alias("status"), text("error_message"), F.create_map().cast("map<string,string>").alias("metadata"), *map(text, DOCUMENT_FIELDS))
            slices = min(SLICES, max(1, -(-tables.bytes_of("pages") // SLICE_BYTES)))
            for n in range(slices):
                mine = F.pmod(F.xxhash64("document_id"), F.lit(slices)) == n
                with working_files(spark):
                    done = pipeline.process(queued.where(mine), pages.where(mine), failures=failures.where(mine), ask=ask)
                    made = {"chunks": done.chunks, "pages_clean": done.cleaned.pages, "clean_report": done.cleaned.report, "documents": done.documents}
                    for table in missing:
                        tables.add(table, lambda rows=made[table]: rows, n, slices)
        tally = [F.count_if(~F.col("duplicate") & ~F.col("failed")).alias("ingested"), F.count_if("duplicate").alias("duplicates"), F.count_if("failed").alias("failed")]
        tables.commit(results.agg(*tally))


def process_stream(files: DataFrame, store: str, pipeline, extractor: Callable[[bytes], list], checkpoint: str, once: bool = True, ask: bool = True) -> StreamingQuery:
    """A stream of files into documents with states, pages and chunks; ``processed`` reads the tables."""
    open_first = (lambda batch: batch) if "content" in files.columns else opened
    return _start(files, lambda batch, number: process_batch(open_first(batch), number, store, pipeline, extractor, ask), checkpoint, once)


def processed(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    """Committed rows of one of the tables PROCESSED, or of ``commits``; None before the first batch."""
    found = committed(spark, store, table)
    return None if found is None else found.drop("batch")


def deduplicate_texts(stream: DataFrame, time: str, horizon: str) -> DataFrame:
    """A stream of texts without those whose content came within ``horizon`` before, by the column ``time``.

    The state holds a hash only until the watermark, ``horizon`` behind the latest time
    seen, has passed it, so it doesn't grow with the stream. A copy that comes later than that
    is let through once more; ``ingest_stream`` is the form that knows all hashes.
    """
    return stream.withColumn("file_hash", F.sha2("text", 256)).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["file_hash"])
