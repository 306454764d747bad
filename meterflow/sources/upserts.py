"""A table of unique keys that takes new values in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.session import stored
from meterflow.sources.results import upserted

BUCKETS = 64


class KeyedTable:
    """A parquet folder with one row per key, dealt to buckets by a hash of the key.

    An upsert reads and rewrites the buckets of its keys alone: they are merged, the result is written
    to the shared folder, and a dynamic partition overwrite puts it in the place of these buckets when
    the job commits. Files of other buckets stay as they are. A bucket should fit a few tasks, so their
    number belongs to the size of the table; it must not change later.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)

    def _rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows; columns that came later are null in rows not written since."""
        return self._rows().drop("_bucket")

    def upsert(self, rows: DataFrame) -> list[int]:
        """Set the columns of ``rows`` for their keys, adding keys and columns that are new.

        Other columns of a known key keep their values. Returns the buckets written. A key that
        ``rows`` holds twice or that is null has no one value and is refused.
        """
        new = stored(rows.withColumn("_bucket", self._bucket()))
        odd = new.groupBy(*self.keys).count().where(
            (F.col("count") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in self.keys), F.lit(0)).cast("boolean")
        ).limit(1).collect()
        if odd:
            raise ValueError(f"keys must be unique and not null: {odd[0].asDict()}")
        touched = sorted(row[0] for row in new.select("_bucket").distinct().collect())  # at most ``buckets``
        merged = new
        if self.exists():
            old = self._rows().where(F.col("_bucket").isin(touched))
            merged = upserted(old.withColumn("_bucket", F.col("_bucket").cast("int")), new, [*self.keys, "_bucket"])
            merged = stored(merged)  # a table cannot be overwritten while it is read
        merged.repartition(F.col("_bucket")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        return touched
