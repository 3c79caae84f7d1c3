"""The document pipeline: files or pages to cleaned, chunked and embedded rows, for all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import chunking, cleaning, store, triage, vectors
from foliomill.operators.cleaning import Cleaned
from foliomill.operators.providers import PatientProvider
from foliomill.plans.workspace import materialize
from foliomill.sources.files import extract_pages, metadata_prompt

WARNING = "over {pct} % of the lines would be stripped as page furniture"


@dataclass
class Processed:
    """What a run leaves: documents with their states, clean pages, the cleaning report, chunks."""

    documents: DataFrame
    cleaned: Cleaned
    chunks: DataFrame


@dataclass
class DocumentPipeline:
    """Stages as functions from tables to tables; what is done already is left out by anti joins.

    Provider calls have a time limit and are tried again on passing errors. With a
    ``vector_store`` (a folder) vectors are kept there as they come and never asked for twice.
    """

    provider: object
    min_ratio: float = 0.3
    min_pages: int = 5
    rail_pct: float = 15.0
    chunk_tokens: int = 1000
    overlap: int = 100
    patient: bool = True
    vector_store: str | None = None

    def __post_init__(self) -> None:
        self.asked = PatientProvider(self.provider) if self.patient else self.provider

    def extract(self, files: DataFrame, done: DataFrame, extractor, page_counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(pages: document_id, page, text, extraction_path; failures: document_id, error_message).

        Pages whose text layer won't do are read from their images; a page that can't be
        read fails its document.
        """
        pages, failures = extract_pages(files, done, extractor, page_counts)
        judged = pages.withColumn("extraction_path", F.when(T.needs_vision(F.col("text"), F.col("nothing")), "vision").otherwise("text"))
        read = materialize(triage.transcribe(judged, self.asked), "pages-read")
        unread = read.where("error is not null").groupBy("document_id").agg(F.min("error").alias("error_message"))
        failures = failures.unionByName(unread)
        return read.drop("error").join(failures.select("document_id"), "document_id", "left_anti"), failures

    def clean(self, pages: DataFrame, overrides: DataFrame | None = None, proceed: DataFrame | None = None, earlier: tuple[DataFrame, DataFrame] | None = None) -> Cleaned:
        """Clean pages and report; ``proceed`` (document_id) lists documents that pass the safety rail anyway.

        ``earlier`` (clean pages, report) is used again for documents whose number of pages
        is still that of the report; the rail is judged anew for them too.
        """
        kept = None
        if earlier is not None:
            counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
            same = counts.join(earlier[1].select("document_id", "total_pages"), "document_id").where("n = total_pages").select("document_id")
            kept = materialize(same, "clean-kept")
            pages = pages.join(kept, "document_id", "left_anti")
        done = cleaning.clean(pages, self.min_ratio, self.min_pages, self.rail_pct, overrides)
        if kept is not None:
            old = [x.join(kept, "document_id", "left_semi") for x in earlier]
            old_report = old[1].withColumn("safety_rail_triggered", F.col("stripped_pct") > self.rail_pct)
            done = Cleaned(done.pages.unionByName(old[0].select(*done.pages.columns)), done.report.unionByName(old_report.select(*done.report.columns)), done.furniture, done.candidates)
        if proceed is not None:
            passed = proceed.select("document_id", F.lit(True).alias("passed")).distinct()
            report = done.report.join(passed, "document_id", "left").withColumn("safety_rail_triggered", F.col("safety_rail_triggered") & F.col("passed").isNull()).drop("passed")
            done = Cleaned(done.pages, report, done.furniture, done.candidates)
        return done

    def chunk(self, clean: DataFrame, done: DataFrame | None = None) -> DataFrame:
        """Chunks of the documents that have none yet."""
        if done is not None:
            clean = clean.join(done.select("document_id").distinct(), "document_id", "left_anti")
        chunks = chunking.chunk_documents(clean, self.chunk_tokens, self.overlap)
        key = F.sha2(F.concat_ws("|", "document_id", F.col("chunk_index").cast("string")), 256)
        return chunks.select(key.alias("chunk_id"), *chunks.columns, F.lit(None).cast("string").alias("retrieval_override"), F.lit(None).cast("array<float>").alias("embedding"))

    def embed(self, chunks: DataFrame) -> DataFrame:
        return vectors.embed_pending(chunks, self.asked)

    def metadata(self, documents: DataFrame, pages: DataFrame) -> DataFrame:
        """document_id and the four fields; documents with a doc_type are not asked about again.

        A reply without an object, or a failed call, gives no row: metadata is a best effort.
        """
        todo = pages.join(documents.where("doc_type is null").select("document_id"), "document_id", "left_semi")
        provider = self.asked

        def ask(batches):
            for batch in batches:
                replies = []
                for prompt in batch.column(1).to_pylist():
                    try:
                        replies.append(provider.complete(prompt))
                    except Exception:  # asked again by the next run, as doc_type stays null
                        replies.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], names=["document_id", "reply"])

        kind = pages.schema["document_id"].dataType.simpleString()
        replies = metadata_prompt(todo).mapInArrow(ask, f"document_id {kind}, reply string")
        parsed = replies.withColumn("x", T.parse_metadata(F.col("reply"))).where("x is not null")
        return parsed.select("document_id", "x.manufacturer", "x.panel_model", "x.doc_type", "x.revision")

    def run(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks with vectors, report) of all pages."""
        done = self.clean(pages)
        return self.embed(self.chunk(done.passed())), done.report

    def process(self, documents: DataFrame, pages: DataFrame, chunks: DataFrame | None = None, failures: DataFrame | None = None, overrides: DataFrame | None = None, proceed: DataFrame | None = None, earlier: tuple[DataFrame, DataFrame] | None = None, replace: bool = False, ask: bool = True) -> Processed:
        """All stages over ``pages``, with the states of ``documents`` (at least document_id, status, error_message).

        A document in ``failures`` (document_id, error_message), or one whose embedding
        fails, is ``failed`` with the message, and the others go on. One that the safety
        rail stops goes to ``review`` with a warning in its metadata and keeps the chunks it
        has, unless it is in ``proceed`` or its metadata holds the override to proceed. All others end in ``review`` without an error. Chunks and vectors in ``chunks``
        are not made again, unless ``replace`` (documents that pass the rail get new ones).
        """
        if "metadata" in documents.columns:
            written = store.proceeding(documents)
            proceed = written if proceed is None else written.unionByName(proceed.select("document_id"))
        if failures is not None:
            pages = pages.join(failures.select("document_id"), "document_id", "left_anti")
        fields = None
        if ask and "doc_type" in documents.columns:
            fields = materialize(self.metadata(documents, pages), "document-fields")
        done = self.clean(pages, overrides, proceed, earlier)
        report = materialize(done.report, "document-report")
        done = Cleaned(done.pages, report, done.furniture, done.candidates)
        passed = done.passed()
        old = chunks
        if chunks is not None and replace:
            old = chunks.join(passed.select("document_id").distinct(), "document_id", "left_anti").select(*chunks.columns)
        fresh = self.chunk(passed, old)
        every = fresh if old is None else old.unionByName(fresh)
        asked = vectors.embed(every, self.asked) if self.vector_store is None else vectors.embed_resumable(every, self.asked, self.vector_store)
        embedded = materialize(asked, "document-chunks")
        failed = embedded.where("embed_error is not null").groupBy("document_id").agg(F.min("embed_error").alias("error_message"))
        failed = failed if failures is None else failed.unionByName(failures.select("document_id", "error_message"))
        return Processed(self._states(documents, report, failed, fields), done, embedded.drop("embed_error"))

    def _states(self, documents: DataFrame, report: DataFrame, failed: DataFrame, fields: DataFrame | None) -> DataFrame:
        failed = failed.groupBy("document_id").agg(F.min("error_message").alias("_failed"))
        seen = report.select("document_id", F.col("safety_rail_triggered").alias("_stopped"))
        joined = documents.join(failed, "document_id", "left").join(seen, "document_id", "left")
        changed = {
            "status": F.when(F.col("_failed").isNotNull(), "failed").when(F.col("_stopped").isNotNull(), "review").otherwise(F.col("status")),
            "error_message": F.when(F.col("_failed").isNotNull(), F.col("_failed")).when(F.col("_stopped").isNull(), F.col("error_message")),
        }
        if "metadata" in documents.columns:
            warned = store.set_key(F.col("metadata"), "cleaning_warning", WARNING.format(pct=self.rail_pct))
            changed["metadata"] = F.when(F.col("_stopped"), warned).otherwise(F.col("metadata"))
        out = joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns])
        return out if fields is None else store.patch(out, fields.select("document_id", *[c for c in fields.columns if c in documents.columns and c != "document_id"]), "document_id")

    def retry(self, documents: DataFrame, ids: DataFrame, pages: DataFrame, chunks: DataFrame | None = None, **options) -> Processed:
        """``process`` for the documents in ``ids``, which must be known; finished stages are skipped. Other rows are left as they are."""
        store.require_known(documents, ids)
        mine = pages.join(ids.select("document_id").distinct(), "document_id", "left_semi")
        return self.process(documents, mine, chunks, **options)

    def proceed_anyway(self, documents: DataFrame, ids: DataFrame, pages: DataFrame, chunks: DataFrame | None = None, **options) -> Processed:
        """The override to proceed written to the metadata of the documents in ``ids``, and these tried again: this and every later run lets them pass."""
        return self.retry(store.set_proceed(documents, ids), ids, pages, chunks, **options)

    def restore_furniture(self, documents: DataFrame, pages: DataFrame, chunks: DataFrame, overrides: DataFrame, added: DataFrame, **options) -> tuple[Processed, DataFrame]:
        """(outcome, overrides with ``added`` (document_id, normalized)): the documents of the added lines are cleaned, chunked and embedded anew."""
        together = overrides.select("document_id", "normalized").unionByName(added.select("document_id", "normalized")).distinct()
        return self.retry(documents, added.select("document_id").distinct(), pages, chunks, overrides=together, replace=True, ask=False, **options), together

    def reprocess(self, tables: dict[str, DataFrame], ids: DataFrame, from_stage: str, **options) -> Processed:
        """Run documents again from a stage. ``tables``: documents, pages, pages_clean, clean_report, chunks.

        From ``clean`` old chunks go only once the safety rail has been passed.
        """
        left = store.reprocess(tables, ids, from_stage)
        earlier = None if from_stage == "clean" else (left["pages_clean"], left["clean_report"])
        return self.retry(left["documents"], ids, tables["pages"], left["chunks"], earlier=earlier, replace=from_stage == "clean", ask=False, **options)
