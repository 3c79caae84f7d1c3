"""Cleaning of page texts: repeated page furniture out, tables and safety notices untouched.

Input rows are pages: document_id, page, text. All stages work on all documents at once;
furniture is a distinct count per (document, normalized line), so documents shuffle by
short lines and never gather in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.functions import text as T
from foliomill.plans.workspace import materialize


def page_blocks(pages: DataFrame) -> DataFrame:
    """One row per paragraph: document_id, page, pos, block, and the page's extraction_path and structural flag where it has them."""
    extra = [c for c in ("extraction_path", "structural") if c in pages.columns]
    return pages.select("document_id", "page", *extra, F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "block"))


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per non-blank line: document_id, page, pos, line_no, line, normalized, candidate."""
    blocks = page_blocks(pages.select("document_id", "page", "text")).withColumn("in_table", T.is_table(F.col("block")))
    lines = blocks.select("document_id", "page", "pos", "in_table", F.posexplode(T.text_lines(F.col("block"))).alias("line_no", "raw"))
    lines = lines.withColumn("line", T.strip(F.col("raw")))
    return lines.select("document_id", "page", "pos", "line_no", "line", T.normalize_line(F.col("line")).alias("normalized"), (~F.col("in_table") & ~T.is_protected(F.col("line"))).alias("candidate"))


def candidate_lines(pages: DataFrame) -> DataFrame:
    """The lines of ``page_lines`` that may be furniture: document_id, page, pos, line_no, line, normalized.

    Most text is in lines too long for that, so these rows are few and short.
    """
    return page_lines(pages).where("candidate").drop("candidate")


def furniture(pages: DataFrame, candidates: DataFrame | None = None, min_ratio: float = 0.3, min_pages: int = 5, overrides: DataFrame | None = None) -> DataFrame:
    """document_id, normalized, page_count of lines on at least max(min_pages, ceil(ratio * pages)) pages.

    ``overrides`` (document_id, normalized) are lines that people restored; they are never furniture.
    """
    candidates = candidate_lines(pages) if candidates is None else candidates
    need = pages.groupBy("document_id").agg(F.greatest(F.lit(min_pages), F.ceil(F.count(F.lit(1)) * F.lit(float(min_ratio))).cast("int")).alias("need"))
    each = candidates.select("document_id", "normalized", "page").distinct()
    counted = each.groupBy("document_id", "normalized").agg(F.count(F.lit(1)).alias("page_count")).where(F.col("page_count") >= min_pages)
    found = counted.join(need, "document_id").where("page_count >= need").select("document_id", "normalized", "page_count")
    return found if overrides is None else found.join(overrides, ["document_id", "normalized"], "left_anti")


def furniture_examples(candidates: DataFrame, found: DataFrame, n: int = 2) -> DataFrame:
    """``found`` with the first pages and lines, one per page, that show each furniture line, and its rank.

    ``rank`` orders a document's lines by page count, most first, then by first occurrence.
    """
    each = candidates.join(found, ["document_id", "normalized"])
    per_page = each.groupBy("document_id", "normalized", "page_count", "page").agg(F.min(F.struct("pos", "line_no", "line")).alias("at"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("page", "at"))), 1, n)
    rows = per_page.groupBy("document_id", "normalized", "page_count").agg(first.alias("first"))
    order = Window.partitionBy("document_id").orderBy(F.desc("page_count"), F.element_at("first", 1))
    return rows.select("document_id", "normalized", "page_count", F.col("first.page").alias("example_pages"), F.col("first.at.line").alias("example_lines"), F.row_number().over(order).alias("rank"))


def _lines_of_blocks(text: Column) -> Column:
    return F.transform(T.paragraphs(text), T.text_lines)


def _without(blocks: Column, gone: Column) -> Column:
    """The text of blocks of lines, without the lines in ``gone`` (structs of pos and line_no; null: none)."""
    left = F.transform(blocks, lambda lines, pos: F.filter(lines, lambda _, i: ~F.array_contains(gone, F.struct(pos.alias("pos"), i.alias("line_no")))))
    kept = F.when(gone.isNull(), blocks).otherwise(F.filter(left, lambda lines: F.size(lines) > 0))
    return F.array_join(F.transform(kept, lambda lines: F.array_join(lines, "\n")), "\n\n")


@dataclass
class Cleaned:
    """What cleaning gives: clean ``pages``, one ``report`` row a document, its ``furniture``, and the lines it was found in."""

    pages: DataFrame
    report: DataFrame
    furniture: DataFrame
    candidates: DataFrame

    def passed(self) -> DataFrame:
        """The clean pages of documents that the safety rail lets through."""
        return self.pages.join(self.report.where("safety_rail_triggered").select("document_id"), "document_id", "left_anti")


def clean(pages: DataFrame, min_ratio: float = 0.3, min_pages: int = 5, rail_pct: float = 15.0, overrides: DataFrame | None = None) -> Cleaned:
    """Clean pages: furniture out, texts rebuilt.

    The pages are read twice: once for the short lines that may be furniture, which are
    written, and once to rebuild every page in place, which is written too; nothing else
    looks at texts, and no line of text is shuffled. ``pages`` may have extraction_path.
    """
    candidates = materialize(candidate_lines(pages), "clean-candidates")
    found = materialize(furniture(pages, candidates, min_ratio, min_pages, overrides), "clean-furniture")
    hits = candidates.join(found.select("document_id", "normalized"), ["document_id", "normalized"], "left_semi")
    gone = hits.groupBy("document_id", "page").agg(F.collect_list(F.struct("pos", "line_no")).alias("gone"))
    path = F.coalesce("extraction_path", F.lit("text")) if "extraction_path" in pages.columns else F.lit("text")
    blocks = pages.select("document_id", "page", path.alias("extraction_path"), _lines_of_blocks(F.col("text")).alias("blocks")).join(gone, ["document_id", "page"], "left")
    rebuilt = blocks.select(
        "document_id", "page", "extraction_path", _structural(F.col("blocks")).alias("structural"), _without(F.col("blocks"), F.col("gone")).alias("text"),
        F.aggregate("blocks", F.lit(0), lambda n, lines: n + F.size(lines)).alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("stripped"),
    )
    rebuilt = materialize(rebuilt, "clean-pages")
    return Cleaned(rebuilt.drop("lines", "stripped"), clean_report(rebuilt, rail_pct), found, candidates)


def clean_report(rebuilt: DataFrame, rail_pct: float = 15.0) -> DataFrame:
    """Per document: pages, lines, stripped lines, share, and whether the safety rail stops it."""
    out = rebuilt.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("lines").alias("total_lines"), F.sum("stripped").alias("stripped_lines"))
    pct = F.when(F.col("total_lines") == 0, F.lit(0.0)).otherwise(F.round(F.col("stripped_lines") * 100.0 / F.col("total_lines"), 2))
    return out.withColumn("stripped_pct", pct).withColumn("safety_rail_triggered", F.col("stripped_pct") > rail_pct)


def _structural(blocks: Column, toc_ratio: float = 0.5) -> Column:
    headed = F.exists(blocks, lambda lines: (F.size(lines) == 1) & F.get(lines, F.lit(0)).rlike(T.STRUCTURAL_HEADING))
    lines = F.flatten(blocks)
    return headed | ((F.size(lines) > 0) & (F.size(F.filter(lines, T.is_toc_line)) >= F.lit(toc_ratio) * F.size(lines)))


def structural_pages(pages: DataFrame, toc_ratio: float = 0.5) -> DataFrame:
    """document_id, page, structural: a contents-like heading, or at least half of the lines look like contents lines."""
    blocks = pages.select("document_id", "page", _lines_of_blocks(F.col("text")).alias("blocks"))
    return blocks.select("document_id", "page", _structural(F.col("blocks"), toc_ratio).alias("structural"))
