"""Exact vector search and nearest-neighbour edges by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StringType, StructField, StructType
from pyspark.sql.window import Window

from foliomill.operators.nearest import nearest
from foliomill.operators.providers import Breaker, embed_as
from foliomill.plans.ordering import running
from foliomill.plans.workspace import materialize, names_in


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def usable(vector: str = "embedding") -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def retrievable(chunks: DataFrame) -> DataFrame:
    """Chunks that retrieval may use: embedded, and not set aside unless overridden."""
    overridden = F.coalesce(F.col("retrieval_override") == "true", F.lit(False))
    return chunks.where(F.col("embedding").isNotNull() & (F.col("section_type").isNull() | overridden))


def search(chunks: DataFrame, query: list[float], k: int = 40) -> DataFrame:
    """(chunk_id, similarity) of the k retrievable chunks nearest to one query; ties by id. A bounded top-k plan."""
    if not query:  # a blank query finds nothing
        return chunks.select("chunk_id", F.lit(None).cast("double").alias("similarity")).limit(0)
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = retrievable(chunks).where(usable() & (F.size("embedding") == len(query))).select("chunk_id", cosine(F.col("embedding"), vector).alias("similarity")).where("similarity is not null")
    return scored.orderBy(F.desc("similarity"), "chunk_id").limit(k)


#: bytes of a block's vectors, at most
BLOCK_BYTES = 1 << 24
#: a table is cut into so many blocks, unless these would be over the limits or of under 1,024 rows
BLOCKS = 12


def knn_edges(chunks: DataFrame, k: int = 5, threshold: float = 0.75, block: int = 1 << 16) -> DataFrame:
    """(chunk_id, neighbor_id, similarity): each chunk's k nearest others, of equally near ones those of the smallest ids, then only those at the threshold or above.

    Exact. Equal vectors are one class; only classes are compared, and what they find is given
    to their members. Classes are cut into blocks of at most ``block`` rows and BLOCK_BYTES,
    and every two blocks meet once, so a task's memory does not grow with the table; a
    meeting gives at most k rows per class and never a row per pair. The work grows
    with the square of the distinct vectors; very large tables are for an approximate index.
    Vectors that are null, zero or hold a null or non-finite component take no part, nor do
    rows without an id; vectors of unlike dimensions are never compared.
    """
    single = isinstance(chunks.schema["embedding"].dataType.elementType, FloatType)
    vector = F.col("embedding") if single else F.transform("embedding", lambda x: x.cast("double"))
    rows = retrievable(chunks).where(usable() & F.col("chunk_id").isNotNull()).groupBy("chunk_id", vector.alias("v")).agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "knn-rows")
    classes = materialize(running(rows.groupBy("v").agg(F.min("chunk_id").alias("low")), [F.size("v"), F.col("low")]), "knn-classes")
    members = materialize(rows.join(classes.select("v", "position"), "v").select("position", "chunk_id", "copies"), "knn-members")
    # so many classes may hold a row's own id, which is no neighbour of it
    own = rows.groupBy("chunk_id").count().agg(F.max("count")).first()[0] or 1
    near = _near_classes(classes.select("position", "v"), k + own - 1, threshold, min(block, max(1, (1 << 23) // (k + own))), "<f4" if single else "<f8")
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("position").orderBy("chunk_id"))).where(F.col("n") <= k + 1)
    alike = first.where("n = 2").select("position", F.col("position").alias("other"), F.lit(1.0).alias("similarity")).where(F.col("similarity") >= threshold)
    theirs = first.select(F.col("position").alias("other"), F.col("chunk_id").alias("neighbor_id"), F.col("copies").alias("theirs"))
    best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbor_id"))
    lists = near.unionByName(alike).join(theirs, "other").withColumn("rank", best("position")).where(F.col("rank") <= k + own).drop("rank", "other")
    found = members.join(lists, "position").where("chunk_id <> neighbor_id")
    found = found.select("chunk_id", "neighbor_id", "similarity", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("copies") * F.col("theirs")).cast("int"))))
    return found.withColumn("rank", best("chunk_id")).where(F.col("rank") <= k).select("chunk_id", "neighbor_id", "similarity")


def _near_classes(classes: DataFrame, k: int, threshold: float, block: int, number: str) -> DataFrame:
    """(position, other, similarity): the k nearest others of each row of ``classes`` (position, v) at the threshold or above, of equally near ones those of the lowest position.

    Positions count up and vectors of one dimension follow each other; ``number`` is the type that blocks are written in.
    """
    per_block = F.least(F.lit(block), F.lit(max(1024, -(-classes.count() // BLOCKS))), F.greatest(F.lit(1), F.lit(BLOCK_BYTES // int(number[-1])) / F.size("v"))).cast("long")

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        data = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(number).tobytes()
        return pa.table({"width": rows["width"][:1], "number": rows["number"][:1], "start": rows["position"][:1], "data": pa.array([data], pa.binary())})

    cut = classes.select("position", "v", F.size("v").alias("width"), F.floor(F.col("position") / per_block).alias("number"))
    blocks = materialize(cut.groupBy("width", "number").applyInArrow(packed, "width int, number long, start long, data binary"), "knn-blocks")
    names = blocks.select("width", F.col("number").alias("i"))
    meetings = materialize(names.join(names.withColumnRenamed("i", "j"), "width").where("i <= j"), "knn-meetings")
    # more partitions than meetings, so that few get several
    count = max(1, meetings.count())
    parts = min(4 * count, max(count, 1000))
    both = [meetings.join(blocks.withColumnRenamed("number", c), ["width", c]).select(*[F.col(n).alias(n) for n in ("width", "i", "j", "start", "data")]) for c in "ij"]
    left, right = (side.repartition(parts, "width", "i", "j").groupBy("width", "i", "j") for side in both)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            x, y = (np.frombuffer(t["data"][0].as_buffer(), number).reshape(-1, t["width"][0].as_py()) for t in (a, b))
            found = nearest(x, y, a["start"][0].as_py(), b["start"][0].as_py(), k, threshold)
        columns = [np.concatenate(c) for c in zip(*found)] or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["position", "other", "similarity"])

    found = left.cogroup(right).applyInArrow(meet, "position long, other long, similarity double")
    rank = F.row_number().over(Window.partitionBy("position").orderBy(F.desc("similarity"), "other"))
    return materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "knn-near")


def embed(chunks: DataFrame, provider, key: str = "chunk_id", content: str = "content", batch: int = 16, give_up: int | None = None) -> DataFrame:
    """``chunks`` with the vectors that are null filled in, and ``embed_error`` (null where all went well).

    A provider has ``embed(list[str]) -> list[list[float]]`` and is asked for ``batch`` texts
    a call, rows that have a vector already aside. If a call fails, its texts are asked for
    one by one; those that fail again stay without a vector and with the error. After ``give_up``
    failed calls in a row a task asks for nothing more. The provider is sent to the executors once; a
    repeated task asks again for the same texts (``embed_resumable`` keeps what it has got).
    """
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker = Breaker(give_up)
        for rows in batches:
            vectors, texts = rows.column(names.index("embedding")).to_pylist(), rows.column(names.index(content)).to_pylist()
            errors = [None] * len(vectors)
            waiting = [range(at, min(at + batch, len(texts))) for at in range(0, len(texts), batch)][::-1]
            while waiting:
                part = waiting.pop()
                try:
                    fresh = breaker.call(embed_as, provider, [texts[i] or "" for i in part], "passage")
                    if len(fresh) != len(part):
                        raise ValueError(f"{len(fresh)} vectors for {len(part)} texts")
                    vectors[part.start : part.stop] = fresh
                except Exception as error:  # one text's failure must not undo the others: they are asked for singly
                    if len(part) > 1:
                        waiting += [range(i, i + 1) for i in reversed(part)]
                    else:
                        errors[part.start] = f"{type(error).__name__}: {error}"
            columns = [pa.array(vectors, pa.list_(pa.float32())) if n == "embedding" else c for n, c in zip(names, rows.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], names=[*names, "embed_error"])

    fresh = chunks.where(F.col("embedding").isNull()).mapInArrow(run, StructType([*chunks.schema.fields, StructField("embed_error", StringType())]))
    return chunks.where(F.col("embedding").isNotNull()).withColumn("embed_error", F.lit(None).cast("string")).unionByName(fresh)


def embed_pending(chunks: DataFrame, provider, **options) -> DataFrame:
    """``chunks`` with the vectors that are null filled in; others are left alone. A failed call raises."""
    done = embed(chunks, provider, **options)
    error = F.concat(F.lit("embedding failed: "), F.col("embed_error"))
    return done.withColumn("embedding", F.when(F.col("embed_error").isNotNull(), F.raise_error(error).cast("array<float>")).otherwise(F.col("embedding"))).select(*chunks.columns)


def embed_resumable(chunks: DataFrame, provider, store: str, key: str = "chunk_id", content: str = "content", batch: int = 16, round_rows: int = 100_000, give_up: int | None = 3) -> DataFrame:
    """As ``embed``, with every vector that was got once kept in ``store`` and never asked for again.

    Rows without a vector, less those whose key and text the store knows, are embedded in
    rounds of about ``round_rows``; each round's vectors are added to the store by Spark's
    writer when it ends, the vectors of a round with failures too. A run after one that
    was cut short, or whose provider has died, asks for what is missing only. A text that
    changes is asked for anew; rows that share key and text share their vector.
    """
    spark = chunks.sparkSession
    kind = chunks.schema[key].dataType.simpleString()
    hashed = chunks.withColumn("_text", F.xxhash64(content))
    shape = f"{key} {kind}, _text long, embedding array<float>"
    stored = lambda: spark.read.schema(shape).parquet(store) if names_in(spark, store) else spark.createDataFrame([], shape)
    waiting = hashed.where(F.col("embedding").isNull()).groupBy(key, "_text").agg(F.first(content).alias(content))
    waiting = waiting.join(stored().select(key, "_text"), [key, "_text"], "left_anti").withColumn("_round", F.xxhash64(key, "_text"))
    waiting = materialize(waiting, "embed-waiting")
    rounds, errors = max(1, -(-waiting.count() // round_rows)), []
    for n in range(rounds):
        part = waiting.where(F.pmod("_round", F.lit(rounds)) == n).drop("_round").withColumn("embedding", F.lit(None).cast("array<float>"))
        done = materialize(embed(part, provider, key, content, batch, give_up), "embed-round")
        done.where("embedding is not null").select(key, "_text", "embedding").write.mode("append").parquet(store)
        errors.append(done.where("embedding is null").select(key, "_text", "embed_error"))
    known = stored().groupBy(key, "_text").agg(F.first("embedding").alias("_found"))
    failed = materialize(reduce(DataFrame.unionByName, errors), "embed-errors")
    out = hashed.join(known, [key, "_text"], "left").join(failed, [key, "_text"], "left")
    filled = F.coalesce("embedding", "_found").cast(chunks.schema["embedding"].dataType)
    error = F.when(filled.isNull(), F.coalesce("embed_error", F.lit("no key")))
    return out.select(*[filled.alias(c) if c == "embedding" else F.col(c) for c in chunks.columns], error.alias("embed_error"))


def query_vector(text: str | None, provider) -> list[float]:
    """The vector of a search text; none for a blank one."""
    return list(map(float, embed_as(provider, [text.strip()], "query")[0])) if text and text.strip() else []


def missing_vectors(chunks: DataFrame, document_id) -> DataFrame:
    """One document's chunks that have no vector yet."""
    return chunks.where((F.col("document_id") == F.lit(document_id)) & F.col("embedding").isNull())
