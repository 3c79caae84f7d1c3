"""What review pages show: small projections, filters and guards over documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import form_text, hue
from foliomill.operators.flags import is_short
from foliomill.plans.ordering import running

IN_PROGRESS = ("extracting", "chunking", "embedding")
KNOWN_STATUSES = ("queued", *IN_PROGRESS, "review", "done", "failed")


def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def set_aside(chunks: DataFrame) -> DataFrame:
    """Chunks with a section type, that is, structural ones and runts."""
    return chunks.where(truthy(F.col("section_type")))


def excluded(chunks: DataFrame) -> DataFrame:
    """Set-aside chunks that nobody has put back."""
    return set_aside(chunks).where(~truthy(F.col("retrieval_override")))


def chunk_states(chunks: DataFrame) -> DataFrame:
    """(chunk_id, state, short_badge): excluded before flagged before normal."""
    out = truthy(F.col("section_type")) & ~truthy(F.col("retrieval_override"))
    short = is_short(F.col("token_count"))
    return chunks.select("chunk_id", F.when(out, "excluded").when(short, "flagged").otherwise("normal").alias("state"), (short & ~out).alias("short_badge"))


def graph_chunks(chunks: DataFrame) -> DataFrame:
    """What a similarity graph shows: embedded chunks, structural ones and runts among them, without their texts."""
    names = ["chunk_id", "document_id", "chunk_index", "section", "page_start", "page_end", "token_count", "section_type"]
    return chunks.where(F.col("embedding").isNotNull()).select(*[c for c in names if c in chunks.columns])


def status_poll(documents: DataFrame) -> DataFrame:
    """document_id, status, error_message of all documents."""
    return documents.select("document_id", "status", "error_message")


def with_document_names(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunks`` with ``document_name``, ``?`` where the document or its name is not known."""
    names = documents.select("document_id", F.col("file_name").alias("document_name"))
    return chunks.join(names, "document_id", "left").withColumn("document_name", F.coalesce("document_name", F.lit("?")))


def document_chunks(chunks: DataFrame, document_id) -> DataFrame:
    return chunks.where(F.col("document_id") == F.lit(document_id)).orderBy("chunk_index")


def chunk_content(chunks: DataFrame, chunk_id) -> str:
    """A chunk's content, the empty text where there is none."""
    row = chunks.where(F.col("chunk_id") == F.lit(chunk_id)).select(F.coalesce("content", F.lit("")).alias("content")).limit(1).first()
    return row.content if row else ""


def may_reprocess(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(document_id, verdict) for asked ids: ok, busy or missing."""
    found = ids.select("document_id").distinct().join(documents.select("document_id", "status"), "document_id", "left")
    return found.select("document_id", F.when(F.col("status").isNull(), "missing").when(F.col("status").isin(*IN_PROGRESS), "busy").otherwise("ok").alias("verdict"))


def status_lines(documents: DataFrame) -> DataFrame:
    """One line of text per document, newest first."""
    line = F.concat_ws("  ", F.rpad("document_id", 12, " "), F.rpad("status", 10, " "), F.coalesce("file_name", F.lit("?")))
    return documents.orderBy(F.desc("created_at"), "document_id").select(line.alias("line"))


def documents_in_order(documents: DataFrame, newest_first: bool = True) -> DataFrame:
    """Documents by arrival; of one moment by id, and those without a moment last."""
    moment = F.col("created_at")
    return documents.orderBy(moment.desc_nulls_last() if newest_first else moment.asc_nulls_last(), "document_id")


def document_colours(documents: DataFrame) -> DataFrame:
    """(document_id, position, hue): a colour by order of arrival."""
    placed = running(documents.select("document_id", "created_at"), [F.col("created_at"), F.col("document_id")])
    return placed.select("document_id", F.col("position").cast("int").alias("position"), hue(F.col("position")).alias("hue"))


def lit_links(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges with their drawn width and whether either end matches a search."""
    hit = lambda c: matches.select(F.col("chunk_id").alias(c), F.lit(True).alias(f"hit_{c}"))
    both = edges.join(hit("source"), "source", "left").join(hit("target"), "target", "left")
    return both.select("source", "target", F.greatest(F.lit(0.5), 8 * (F.col("similarity") - 0.7)).alias("width"), (F.coalesce("hit_source", F.lit(False)) | F.coalesce("hit_target", F.lit(False))).alias("lit"))


def confirm_metadata(documents: DataFrame, forms: DataFrame) -> DataFrame:
    """Fields of a review form (document_id and any of the document's text columns) trimmed and taken over, blank as null."""
    names = [c for c in forms.columns if c != "document_id"]
    fresh = forms.select("document_id", *[form_text(F.col(c)).alias(f"_form_{c}") for c in names], F.lit(True).alias("_confirmed"))
    joined = documents.join(fresh, "document_id", "left")
    changed = {c: F.when(F.col("_confirmed"), F.col(f"_form_{c}")).otherwise(F.col(c)) for c in names}
    if "metadata_confirmed" in documents.columns:
        changed["metadata_confirmed"] = F.coalesce("_confirmed", "metadata_confirmed")
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns])


def approve(documents: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("document_id", F.lit(True).alias("_hit")).distinct()
    return documents.join(hit, "document_id", "left").withColumn("status", F.when(F.col("_hit"), "done").otherwise(F.col("status"))).select(*documents.columns)


def report_json(report: DataFrame, furniture: DataFrame) -> DataFrame:
    """(document_id, json): the cleaning report with its furniture lines, most pages first."""
    columns = [c for c in furniture.columns if c != "document_id"]
    lines = furniture.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*(["rank"] if "rank" in columns else []), (-F.col("page_count")).alias("order"), *[c for c in columns if c != "rank"]))).alias("furniture"))
    lines = lines.withColumn("furniture", F.transform("furniture", lambda x: F.struct(*[x[c].alias(c) for c in columns if c != "rank"])))
    both = report.join(lines, "document_id", "left")
    return both.select("document_id", F.to_json(F.struct(*[c for c in both.columns if c != "document_id"])).alias("json"))


def read_report(table: DataFrame) -> DataFrame:
    """Totals from (document_id, json); null where the JSON is missing or broken."""
    shape = "total_pages long, total_lines long, stripped_lines long, stripped_pct double, safety_rail_triggered boolean"
    return table.select("document_id", F.from_json("json", shape).alias("x")).select("document_id", "x.*")


def check_tables(tables: dict[str, DataFrame], wanted: dict[str, dict[str, str]]) -> list[tuple[str, str | None, str]]:
    """(table, column, what is wrong) of tables that are missing or lack columns of a type, as ``wanted`` (table -> column -> type) has them; none if all is well."""
    wrong: list[tuple[str, str | None, str]] = []
    for name, columns in wanted.items():
        if name not in tables:
            wrong.append((name, None, "missing table"))
            continue
        have = {f.name: f.dataType.simpleString() for f in tables[name].schema.fields}
        wrong += [(name, c, "missing column" if c not in have else f"is {have[c]}, not {kind}") for c, kind in columns.items() if have.get(c) != kind]
    return wrong


def check_settings(found: dict[str, str | None], needed: tuple[str, ...]) -> list[str]:
    """Names of settings (of the environment, or of a table of them) that a run needs and that are missing or blank."""
    return [name for name in needed if not (found.get(name) or "").strip()]


def check_vectors(chunks: DataFrame, width: int) -> DataFrame:
    """(chunk_id, found_width) of vectors that have not ``width`` components."""
    return chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") != width)).select("chunk_id", F.size("embedding").alias("found_width"))
