"""A Parquet table by key that micro-batches are merged into.

Rows lie in partitions by a hash of their key.  A batch is reduced to one row a key, read
together with the partitions it touches, and these alone are replaced, by dynamic partition
overwrite: other partitions are neither read nor written.  Rows say which batch wrote them;
of equal versions the later batch wins, and a batch that is run again, also after it was cut
off in the middle, finds its own rows and leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

BUCKETS = 64


class KeyedTable:
    """A table in ``folder`` with the columns of ``schema`` (name to type), one row for each value of ``keys``; ``version`` orders its rows.

    Columns of ``keep`` keep their last value that isn't null or empty, by its own version: an
    older row that comes late doesn't replace a newer value, and isn't hidden by a newer blank."""

    def __init__(self, spark: SparkSession, folder: str, schema: dict[str, str], keys: list[str], version: str, keep: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.version, self.keep, self.buckets = spark, folder, schema, keys, version, keep, buckets
        order = f"struct<version: {schema[version]}, batch: bigint>"
        self.stored = schema | {"deleted_at": "timestamp", "_batch": "bigint"} | {f"_at_{c}": order for c in keep} | {"bucket": "int"}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _stored(self) -> DataFrame:
        """All rows as they lie, deleted ones too; none before the first batch."""
        columns = ", ".join(f"{c} {t}" for c, t in self.stored.items())
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(self.folder)

    def read(self, deleted: bool = False) -> DataFrame:
        rows = self._stored()
        return (rows if deleted else rows.filter("deleted_at IS NULL")).select(*self.schema, *(["deleted_at"] if deleted else []))

    def _touched(self, batch: DataFrame) -> DataFrame:
        """The stored rows of the partitions that a batch touches; their numbers are at most ``buckets``."""
        found = [r["bucket"] for r in batch.select(self._bucket()).distinct().collect()]
        return self._stored().filter(F.col("bucket").isin(found))

    def _replace(self, rows: DataFrame) -> None:
        rows = cut(rows.withColumn("bucket", self._bucket()))  # read through before anything is replaced
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Writes a batch's rows over older versions.  A row that comes back after its deletion, with a later version, lives again."""
        order = F.struct(F.col(self.version).alias("version"), F.col("_batch").alias("batch"))
        new = batch.select(*self.schema).withColumns({"deleted_at": F.lit(None).cast("timestamp"), "_batch": F.lit(number).cast("long")})
        new = new.withColumns({f"_at_{c}": F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), order) for c in self.keep})
        old = self._touched(batch).drop("bucket")
        last = [F.max_by(c, f"_at_{c}" if c in self.keep else "_order").alias(c) for c in [*self.schema, "deleted_at", "_batch"] if c not in self.keys]
        both = old.unionByName(new).withColumn("_order", order)
        self._replace(both.groupBy(*self.keys).agg(*last, *(F.max(f"_at_{c}").alias(f"_at_{c}") for c in self.keep)))

    def delete(self, ids: DataFrame, number: int, at: Column) -> None:
        """Marks the rows of some keys as deleted at a time; rows deleted before keep theirs.  Keys that the table doesn't have are ignored."""
        gone = ids.select(*self.keys).distinct().withColumn("_gone", F.lit(True))
        rows = self._touched(ids).drop("bucket").join(gone, self.keys, "left")
        first = F.col("_gone") & F.col("deleted_at").isNull()
        rows = rows.withColumn("_batch", F.when(first, F.lit(number).cast("long")).otherwise(F.col("_batch")))
        self._replace(rows.withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at"))).drop("_gone"))
