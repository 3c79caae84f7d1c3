"""Tables as copy-on-write: every mutation is a function from the old rows to the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with ``rows`` added; columns they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def insert_documents(documents: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with ``rows``, the rows with defaults applied): status queued, not confirmed, no metadata, times of now."""
    defaults = {"status": F.lit("queued"), "metadata_confirmed": F.lit(False), "metadata": F.create_map().cast("map<string,string>"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    for name, value in defaults.items():
        if name in documents.columns:
            kind = documents.schema[name].dataType
            rows = rows.withColumn(name, F.coalesce(F.col(name), value.cast(kind)) if name in rows.columns else value.cast(kind))
    return insert(documents, rows), rows


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, at most one: no row where there is none."""
    return table.where(F.col(key) == F.lit(value)).limit(1)


def reachable(table: DataFrame) -> bool:
    """Whether a table can be read at all: one row of one column is asked for."""
    table.select(table.columns[0]).limit(1).collect()
    return True


def require_known(documents: DataFrame, ids: DataFrame) -> None:
    """An error that names some of the ids which are no documents."""
    unknown = ids.select("document_id").distinct().join(documents.select("document_id"), "document_id", "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"unknown documents: {[r.document_id for r in unknown]}")


def update_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def patch(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Columns of ``patches`` replace those of the rows with the same key, nulls included.

    Of patches that repeat a key the one with the largest values, column by column from
    the left, holds; keys that ``table`` lacks are ignored.
    """
    names = [c for c in patches.columns if c != key]
    one = patches.groupBy(key).agg(F.max(F.struct(*names)).alias("_new"))
    joined = table.join(one, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the documents in ``ids`` (document_id): a cascading delete."""
    gone = ids.select("document_id").distinct()
    return {name: table.join(gone, "document_id", "left_anti").select(*table.columns) for name, table in tables.items()}


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value, version): the value with the highest version of each key stays."""
    both = settings.unionByName(changes)
    return both.groupBy("key").agg(F.max_by("value", F.struct("version", "value")).alias("value"), F.max("version").alias("version"))


def get_setting(settings: DataFrame, key: str) -> str | None:
    """A setting's value; null where there is none."""
    row = settings.where(F.col("key") == F.lit(key)).agg(F.max_by("value", "version").alias("value")).first()
    return row.value


def set_key(metadata: Column, key: str, value: str) -> Column:
    """A map with one entry set, an earlier one replaced."""
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))


def drop_key(metadata: Column, key: str) -> Column:
    return F.map_filter(metadata, lambda k, _: k != key)


#: the entry of a document's metadata that lets it pass the safety rail
PROCEED = "proceed_override"


def set_proceed(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` with the override to proceed merged into the metadata of those in ``ids``."""
    chosen = ids.select("document_id", F.lit(True).alias("_chosen")).distinct()
    joined = documents.join(chosen, "document_id", "left")
    merged = F.when(F.col("_chosen"), set_key(F.col("metadata"), PROCEED, "true")).otherwise(F.col("metadata"))
    return joined.select(*[merged.alias(c) if c == "metadata" else F.col(c) for c in documents.columns])


def proceeding(documents: DataFrame) -> DataFrame:
    """(document_id) of the documents whose metadata says that they proceed past the safety rail."""
    return documents.where(F.try_element_at("metadata", F.lit(PROCEED)) == "true").select("document_id")


def retrieval_override(chunks: DataFrame, condition: Column, include: bool) -> DataFrame:
    changed = set_key(F.col("metadata"), "retrieval_override", "true") if include else drop_key(F.col("metadata"), "retrieval_override")
    return update_where(chunks, condition, {"metadata": changed})


#: What each stage of a document's life may be restarted from, and what that clears at once. Chunks outlive a restart
#: from cleaning until the safety rail has been passed; ``DocumentPipeline.reprocess`` replaces them then.
RESTARTS = {"clean": ("pages_clean", "clean_report"), "chunk": ("chunks",), "embed": ()}


def reprocess(tables: dict[str, DataFrame], ids: DataFrame, from_stage: str) -> dict[str, DataFrame]:
    """Tables with the documents in ``ids`` set back to ``queued``, errors cleared, and what the stage makes anew cleared."""
    if from_stage not in RESTARTS:
        raise ValueError(f"unknown stage {from_stage!r}")
    require_known(tables["documents"], ids)
    out = dict(tables)
    gone = ids.select("document_id").distinct()
    for name in RESTARTS[from_stage]:
        if name in out:
            out[name] = out[name].join(gone, "document_id", "left_anti").select(*out[name].columns)
    hit = gone.withColumn("_hit", F.lit(True))
    if from_stage == "embed" and "chunks" in out:
        cleared = out["chunks"].join(hit, "document_id", "left")
        out["chunks"] = cleared.withColumn("embedding", F.when(F.col("_hit").isNull(), F.col("embedding"))).select(*out["chunks"].columns)
    out["documents"] = set_status(tables["documents"], ids, "queued")
    return out


def set_status(documents: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The documents in ``ids`` with a new status and no error."""
    hit = ids.select("document_id").distinct().withColumn("_hit", F.lit(True))
    joined = documents.join(hit, "document_id", "left")
    changed = joined.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).withColumn("error_message", F.when(F.col("_hit").isNull(), F.col("error_message")))
    return changed.select(*documents.columns)


def hard_reset(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents in ``ids``, which must be known."""
    require_known(tables["documents"], ids)
    return delete_documents(tables, ids)
