"""Tables that a stream fills batch by batch, so that a batch that runs again changes nothing.

A table is a folder with one folder of Parquet files for each batch. A batch writes its part of
each table once; the part counts as whole from the moment Spark's writer has marked it, and a batch
that is run again reads whole parts back instead of making them anew, and writes the others over. The batch
counts from the moment its row stands in the ``commits`` table. Batches run in order,
so readers take all parts up to the last committed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.plans.workspace import bytes_in, names_in, path_exists

COMMITS = "commits"


class BatchTables:
    """The tables below the folder ``store``, as batch ``number`` writes them."""

    def __init__(self, spark: SparkSession, store: str, number: int, commits: str = COMMITS) -> None:
        self.spark, self.store, self.number, self.commits = spark, store.rstrip("/"), number, commits

    def _part(self, table: str) -> str:
        return f"{self.store}/{table}/batch={self.number}"

    def whole(self, table: str) -> bool:
        return path_exists(self.spark, f"{self._part(table)}/_SUCCESS")

    def stage(self, table: str, make: Callable[[], DataFrame]) -> DataFrame:
        """This batch's part of a table: written from ``make()`` unless an earlier try has done so."""
        if not self.whole(table):
            make().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._part(table))
        return self.spark.read.parquet(self._part(table))

    def add(self, table: str, make: Callable[[], DataFrame], n: int, of: int) -> None:
        """Slice ``n`` of ``of`` of this batch's part of a table: ``stage`` in several writes, of which the first replaces what is there and the last makes the part whole."""
        if of == 1:
            self.stage(table, make)
            return
        rows = make().write.mode("append" if n else "overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(n == of - 1).lower())
        rows.parquet(self._part(table))

    def bytes_of(self, table: str) -> int:
        return bytes_in(self.spark, self._part(table))

    def is_committed(self) -> bool:
        return self.whole(self.commits)

    def commit(self, row: DataFrame) -> None:
        """The batch counts from here on; ``row`` tells about it."""
        self.stage(self.commits, lambda: row)


def committed(spark: SparkSession, store: str, table: str, commits: str = COMMITS) -> DataFrame | None:
    """All committed rows of a table, with their ``batch``; None before the first batch is committed."""
    store = store.rstrip("/")
    batches = sorted(int(name.split("=")[1]) for name in names_in(spark, f"{store}/{commits}") if name.startswith("batch="))
    # the last one may be in the making; those before it are whole
    if batches and not path_exists(spark, f"{store}/{commits}/batch={batches[-1]}/_SUCCESS"):
        batches.pop()
    if not batches:
        return None
    return spark.read.option("basePath", f"{store}/{table}").parquet(f"{store}/{table}").where(F.col("batch") <= max(batches))


class HashStore:
    """All content hashes that a stream has let through, in folders by the hash's first two characters and by batch.

    A batch reads only the folders of its own hashes' beginnings, and of these only earlier
    batches' files: so no state is held between batches, and one that runs again doesn't
    meet its own hashes.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def unknown(self, hashes: DataFrame, number: int, column: str = "file_hash") -> DataFrame:
        """Rows of ``hashes`` whose hash no batch before ``number`` has added."""
        if not path_exists(self.spark, self.path):
            return hashes
        starts = [r[0] for r in hashes.select(F.substring(column, 1, 2)).distinct().collect()]  # 256 at most
        known = self.spark.read.schema(f"{column} string, start string, batch long").parquet(self.path)
        known = known.where(F.col("start").isin(starts) & (F.col("batch") < number)).select(column)
        return hashes.join(known, column, "left_anti").select(*hashes.columns)

    def add(self, hashes: DataFrame, number: int, column: str = "file_hash") -> None:
        """Hashes of batch ``number``; adding them again writes the same files over."""
        rows = hashes.select(column, F.substring(column, 1, 2).alias("start"), F.lit(number).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("start", "batch").parquet(self.path)
