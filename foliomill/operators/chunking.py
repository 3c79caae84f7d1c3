"""From clean pages to chunks: block kinds, sections, packing with overlap, runts.

Order-dependent steps are windows over one document's blocks where a block's neighbour
decides, and pointers over running sums for packing. These see numbers and token counts only;
texts stay in rows of their own and are joined by span, so no row ever holds a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.functions import text as T
from foliomill.operators import packing
from foliomill.operators.cleaning import page_blocks
from foliomill.plans.workspace import materialize


def _in_order():
    return Window.partitionBy("document_id").orderBy("page", "pos")


def repeated_headings(blocks: DataFrame, least_pages: int = 3) -> DataFrame:
    """document_id, heading, pages of heading-shaped paragraphs on several pages."""
    if "heading" not in blocks.columns:
        blocks = blocks.withColumn("heading", F.when(T.is_heading_shaped(F.col("block")), T.normalize_heading(F.col("block"))))
    shaped = blocks.where("heading is not null").select("document_id", "heading", "page").distinct()
    return shaped.groupBy("document_id", "heading").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)


def typed_blocks(pages: DataFrame) -> DataFrame:
    """Blocks with kind, tokens, and the page's extraction_path and structural flag (``text`` and false where it has none)."""
    blocks = page_blocks(pages).withColumn("heading", F.when(T.is_heading_shaped(F.col("block")), T.normalize_heading(F.col("block"))))
    repeated = repeated_headings(blocks).select("document_id", "heading", F.lit(True).alias("again"))
    typed = blocks.join(repeated, ["document_id", "heading"], "left")
    kind = T.block_kind(F.col("block"), F.col("heading").isNotNull() & F.col("again").isNull())
    for name, default in (("extraction_path", F.lit("text")), ("structural", F.lit(False))):
        typed = typed.withColumn(name, F.coalesce(name, default) if name in typed.columns else default)
    return typed.select("document_id", "page", "pos", "block", "extraction_path", "structural", kind.alias("kind"), T.estimate_tokens(F.col("block")).alias("tokens"))


def merge_atomic(blocks: DataFrame) -> DataFrame:
    """Neighbouring tables, or procedures, become one block, across pages too."""
    atomic = F.col("kind").isin("table", "procedure")
    fresh = ~(atomic & F.coalesce(F.lag("kind").over(_in_order()) == F.col("kind"), F.lit(False)))
    groups = blocks.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    part = F.array_sort(F.collect_list(F.struct("page", "pos", "block")))
    merged = groups.groupBy("document_id", "island").agg(
        part.alias("x"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.first("kind").alias("kind"),
        F.when(F.bool_and(F.col("extraction_path") == "text"), "text").otherwise("vision").alias("extraction_path"), F.bool_or("structural").alias("structural"),
    )
    merged = merged.withColumn("block", F.array_join(F.col("x.block"), "\n")).withColumn("pos", F.element_at("x.pos", 1))
    return merged.select("document_id", "page", "pos", "page_end", "kind", "block", "extraction_path", "structural", T.estimate_tokens(F.col("block")).alias("tokens"))


def with_sections(blocks: DataFrame) -> DataFrame:
    """``section``: the last heading so far, the block itself included."""
    heading = F.when(F.col("kind") == "heading", F.col("block"))
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))


def pack(blocks: DataFrame, most: int = 1000, overlap: int = 100) -> DataFrame:
    """Greedy packing; chunks may share ``overlap`` tokens of whole blocks, tables and procedures are never split.

    A block that does not fit closes the open chunk; the next one begins with the shortest
    tail of whole blocks that holds ``overlap`` tokens. A table or procedure of over ``most``
    tokens is a chunk of its own. A chunk's section is the one at the block that opened it.
    Result: document_id, chunk_index, content, page_start, page_end, section,
    extraction_path, structural, token_count.
    """
    placed = blocks.withColumn("i", F.row_number().over(_in_order()))
    if "page_end" not in blocks.columns:
        placed = placed.withColumn("page_end", F.col("page"))
    placed = materialize(placed, "pack-blocks")
    atomic = F.col("kind").isin("table", "procedure")
    spans = packing.spans(placed.select("document_id", "i", "tokens", atomic.alias("atomic")), most, overlap)
    members = spans.select("document_id", "chunk_index", "opener", F.explode(F.sequence("first", "last")).alias("i"))
    parts = members.join(placed.select("document_id", "i", "block", "page", "page_end", "section", "extraction_path", "structural"), ["document_id", "i"])
    chunks = parts.groupBy("document_id", "chunk_index").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("i", "block")))["block"], "\n\n").alias("content"), F.min("page").alias("page_start"), F.max("page_end").alias("page_end"),
        F.max(F.when(F.col("i") == F.col("opener"), F.col("section"))).alias("section"),
        F.when(F.bool_and(F.col("extraction_path") == "text"), "text").otherwise("vision").alias("extraction_path"), F.bool_or("structural").alias("structural"),
    )
    return chunks.withColumn("token_count", T.estimate_tokens(F.col("content")))


def merge_runts(chunks: DataFrame, least: int = 50) -> DataFrame:
    """Short chunks join the chunk before them if it has their section and is not structural; else they are tagged.

    A chunk that has taken others in keeps its section and is structural or not as before,
    so whether a chunk joins depends on its neighbour alone: islands in a window. An island
    of under ``least`` tokens is a runt. Result: document_id, chunk_index (anew), content,
    page_start, page_end, section, extraction_path, token_count, section_type (null,
    ``structural`` or ``runt``).
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    before = F.lag(F.struct("section", "structural")).over(order)
    joins = F.col("before").isNotNull() & ~F.col("structural") & (F.col("token_count") < least) & ~F.col("before")["structural"] & F.col("before")["section"].eqNullSafe(F.col("section"))
    fresh = F.when(joins, 0).otherwise(1)
    islands = chunks.withColumn("before", before).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = lambda c: F.min_by(c, "chunk_index").alias(c)
    merged = islands.groupBy("document_id", "island").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", "content")))["content"], "\n\n").alias("content"), in_order("page_start"), F.max("page_end").alias("page_end"), in_order("section"),
        F.when(F.bool_and(F.col("extraction_path") == "text"), "text").otherwise("vision").alias("extraction_path"), F.bool_or("structural").alias("structural"),
    )
    merged = merged.withColumn("token_count", T.estimate_tokens(F.col("content")))
    kind = F.when(F.col("structural"), "structural").when(F.col("token_count") < least, "runt")
    return merged.select("document_id", (F.col("island") - 1).cast("int").alias("chunk_index"), "content", "page_start", "page_end", "section", "extraction_path", "token_count", kind.alias("section_type"))


def chunk_documents(pages: DataFrame, most: int = 1000, overlap: int = 100, least: int = 50) -> DataFrame:
    """Pages to final chunks, all steps."""
    return merge_runts(pack(with_sections(merge_atomic(typed_blocks(pages))), most, overlap), least)
