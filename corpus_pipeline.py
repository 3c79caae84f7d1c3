"""From raw documents to encoded training text: five stages, each one operator over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import bpe, mixing, near_dups, quality, secrets
from foliomill.plans.workspace import ensure_code, materialize, spread


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; all others stay unchanged.

    The model learns from the labels of ``sf_dir``. Rows without a doc_id can't be told
    apart from each other and stay; null and empty texts are scored like others; of labels that
    contradict each other none is used, and without labels of both kinds nothing is learned.
    """
    ensure_code(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out()))
    rejected = materialize(quality.score_quality(docs, model).where("score < 0.3").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8).

    That is the one with the smallest doc_id, with all rows of that id; null, empty and
    wordless texts and rows without a doc_id have no copies and stay.
    """
    ensure_code(spark)
    return near_dups.keep_first(docs, shingle=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the texts; n_chars follows the new text.

    No row goes. Null and empty texts stay as they are (n_chars of a null text is null);
    repeated rows are masked alike; a null source is an owner of its own.
    """
    masked = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: not at all, once or twice.

    Rows alike in doc_id, source and text are taken together; null and empty texts have
    size 0 and take part; a null source is a source; other columns are kept as they are,
    whatever their names.
    """
    return mixing.repeat_by_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row that is left.

    A null text is encoded as the empty one, without ids; repeated rows give repeated rows.
    """
    ensure_code(spark)
    return bpe.bpe_encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding", encoding_stage),
]

#: The classifier, the MinHash groups and the encoder are not expressible in SQL; the tests check by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
