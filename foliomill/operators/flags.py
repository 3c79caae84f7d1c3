"""Data-quality flags of documents, and the queue page's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import looks_like_prose

SHORT_CHUNK = 15


def is_short(tokens: Column) -> Column:
    return F.coalesce(tokens.between(1, SHORT_CHUNK - 1), F.lit(False))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, tokens, short and vision chunks, and whether any retrieval override is set."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.coalesce("token_count", F.lit(0)).cast("long")).alias("tokens"),
        F.count_if(is_short(F.col("token_count")) & F.col("section_type").isNull()).alias("short_chunks"),
        F.count_if(F.col("extraction_path") == "vision").alias("vision_chunks"),
        F.coalesce(F.bool_or(F.coalesce("retrieval_override", F.lit("")) != ""), F.lit(False)).alias("has_override"),
    )


def document_flags(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, flags (array of (key, severity, label) in fixed order), n_flags, worst."""
    stats = chunk_stats(chunks)
    d = documents.join(stats, "document_id", "left").fillna(0, ["n_chunks", "tokens", "short_chunks", "vision_chunks"])
    processed = F.col("status").isin("review", "done")
    pages = F.coalesce("page_count", F.lit(0))
    has_chunks = F.col("n_chunks") > 0
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        ("cleaning-safety-rail", "critical", ~empty("cleaning_warning")),
        ("no-chunks", "critical", processed & (pages > 0) & ~has_chunks),
        ("low-content-density", "warning", processed & has_chunks & (pages > 0) & (F.col("tokens") < 40 * pages)),
        ("short-chunks", "warning", F.col("short_chunks") > 0),
        ("heavily-vision", "warning", has_chunks & (2 * F.col("vision_chunks") > F.col("n_chunks"))),
        ("manufacturer-prose", "warning", looks_like_prose(F.col("manufacturer"))),
        ("revision-prose", "warning", looks_like_prose(F.col("revision"))),
        ("no-doc-type", "warning", processed & empty("doc_type")),
    ]
    number = lambda c: F.col(c).cast("string")
    labels = {
        "cleaning-safety-rail": F.concat(F.lit("Cleaning stopped: "), "cleaning_warning"),
        "no-chunks": F.concat(F.lit("No chunks from "), number("page_count"), F.lit(" pages")),
        "low-content-density": F.concat(F.lit("Little text: "), F.round(F.col("tokens") / F.nullif(pages, F.lit(0)), 0).cast("int").cast("string"), F.lit(" tokens a page")),
        "short-chunks": F.concat(number("short_chunks"), F.lit(" very short chunks")),
        "heavily-vision": F.concat(number("vision_chunks"), F.lit(" of "), number("n_chunks"), F.lit(" chunks were read from images")),
        "manufacturer-prose": F.lit("Manufacturer reads like a sentence"),
        "revision-prose": F.lit("Revision reads like a sentence"),
        "no-doc-type": F.lit("Document type is not known"),
    }
    each = [F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity"), labels[key].alias("label"))) for key, severity, rule in rules]
    flags = F.filter(F.array(*each), lambda x: x.isNotNull())
    worst = F.when(F.exists("flags", lambda x: x["severity"] == "critical"), "critical").when(F.size("flags") > 0, "warning")
    return d.withColumn("flags", flags).select("document_id", "flags", F.size("flags").alias("n_flags"), worst.alias("worst"))


def status_overlay(documents: DataFrame, live: DataFrame) -> DataFrame:
    """Status and error of documents, replaced by the live ones where those are not null."""
    fresh = live.select("document_id", F.col("status").alias("live_status"), F.col("error_message").alias("live_error"))
    return documents.join(fresh, "document_id", "left").select("document_id", F.coalesce("live_status", "status").alias("status"), F.coalesce("live_error", "error_message").alias("error_message"))


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """(document_id, n_chunks, stats): the figures of each document's chunks as a list, in order of chunk_id."""
    row = F.struct("chunk_id", "token_count", "section_type", "extraction_path")
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(row)).alias("stats"))


def headline_counts(documents: DataFrame, chunks: DataFrame, components: DataFrame) -> DataFrame:
    """One row: documents, embedded chunks, and clusters of at least two (``components`` is (node, component))."""
    clusters = components.groupBy("component").count().where("count >= 2").agg(F.count(F.lit(1)).alias("n"))
    counts = [documents.agg(F.count(F.lit(1)).alias("n")), chunks.agg(F.count("embedding").alias("n")), clusters]
    named = [c.select(F.lit(k).alias("k"), "n") for k, c in zip(("documents", "embedded_chunks", "clusters"), counts)]
    rows = named[0].unionByName(named[1]).unionByName(named[2])
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("n"))).alias(k)
    return rows.agg(pick("documents"), pick("embedded_chunks"), pick("clusters"))
