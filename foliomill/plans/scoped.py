"""Stored tables of documents of which a change rewrites only the part that holds its documents.

Every table is a folder of Parquet files by bucket of document_id. A change is one operation
over several tables, with a log: what the touched buckets shall hold is written aside for all tables,
a marker says that this is whole, and only then are the buckets written over. So a run that
is cut short before the marker has changed nothing, and one that is cut short after it is
finished from what was set aside, by the same call or by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegerType

from foliomill.plans.workspace import delete_folder, names_in, path_exists

BUCKET = "_bucket"


class DocumentStore:
    """Tables with a document_id in the folder ``path``, cut into ``buckets`` parts.

    Rows without a document_id have a bucket as well. One writer at a time; a reader that
    reads a bucket while it is being written over may have to read again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        # by text, so that an id's bucket does not hang on the width of its type
        return F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(self.buckets)).cast("int")

    def names(self) -> list[str]:
        return sorted(names_in(self.spark, f"{self.path}/shapes"))

    def _stored(self, name: str) -> DataFrame:
        shape = self.spark.read.parquet(f"{self.path}/shapes/{name}").schema
        folder = f"{self.path}/tables/{name}"
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], shape.add(BUCKET, IntegerType()))
        return self.spark.read.schema(shape.add(BUCKET, IntegerType())).parquet(folder)

    def table(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self._stored(name).drop(BUCKET)

    def create(self, tables: dict[str, DataFrame]) -> None:
        """Write tables whole, over what stood there under their names."""
        for name, rows in tables.items():
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/shapes/{name}")
            self._by_bucket(rows).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/tables/{name}")

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        # a hot document fills one bucket, so a bucket is dealt to several tasks, by values that a repeated task finds again
        values = [F.col(f"`{c.name}`") for c in rows.schema if isinstance(c.dataType, AtomicType)]
        return rows.withColumn(BUCKET, self._bucket()).repartition(F.col(BUCKET), F.pmod(F.xxhash64(*values), F.lit(4)))

    def _log(self, operation: str) -> str:
        return f"{self.path}/log/{operation}"

    def change(self, operation: str, ids: DataFrame, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
        """Change the tables for the documents in ``ids`` (document_id); an operation of a name that has been done changes nothing.

        ``make`` gets all tables, cut to the buckets of ``ids``, and returns those that it
        changes; what it returns for other documents of these buckets is written back, and a row
        of any other bucket is an error. The functions of ``operators.store`` fit as they are.
        """
        self.recover()
        log = self._log(operation)
        touched = sorted(r[0] for r in ids.select(self._bucket()).distinct().collect())  # at most one number a bucket
        if self._whole(f"{log}/done") or not touched:
            return
        before = {name: self._stored(name).where(F.col(BUCKET).isin(touched)).drop(BUCKET) for name in self.names()}
        made = make(before)
        if set(made) - set(before):
            raise KeyError(f"no such tables: {sorted(set(made) - set(before))}")
        changed = sorted(name for name in made if made[name] is not before[name])
        delete_folder(self.spark, log)
        for name in changed:
            rows = made[name].select(*[F.col(f"`{c.name}`").cast(c.dataType) for c in before[name].schema])
            outside = F.raise_error(F.lit(f"{name}: a row of a document that is not in the change"))
            rows.where(F.when(self._bucket().isin(touched), True).otherwise(outside)).write.parquet(f"{log}/rows/{name}")
        plan = self.spark.createDataFrame([(changed, touched)], "tables array<string>, buckets array<int>")
        self._mark(plan, f"{log}/prepared")
        self._finish(operation)

    def recover(self) -> list[str]:
        """Finish the operations that were cut short after they had been prepared; their names."""
        logs = sorted(names_in(self.spark, f"{self.path}/log"))
        cut = [o for o in logs if self._whole(f"{self._log(o)}/prepared") and not self._whole(f"{self._log(o)}/done")]
        for operation in cut:
            self._finish(operation)
        return cut

    def _whole(self, folder: str) -> bool:
        return path_exists(self.spark, f"{folder}/_SUCCESS")

    def _mark(self, row: DataFrame, folder: str) -> None:
        row.coalesce(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)

    def _finish(self, operation: str) -> None:
        log = self._log(operation)
        plan = self.spark.read.parquet(f"{log}/prepared").first()
        for name in plan.tables:
            self._write_over(name, plan.buckets, f"{log}/rows/{name}")
        self._mark(self.spark.createDataFrame([(operation,)], "operation string"), f"{log}/done")
        delete_folder(self.spark, f"{log}/rows")

    def _write_over(self, name: str, buckets: list[int], rows: str) -> None:
        new = self.spark.read.schema(self.table(name).schema).parquet(rows)
        folder = f"{self.path}/tables/{name}"
        self._by_bucket(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)
        filled = {r[0] for r in new.select(self._bucket()).distinct().collect()}  # at most one number a bucket
        for bucket in set(buckets) - filled:
            delete_folder(self.spark, f"{folder}/{BUCKET}={bucket}")
