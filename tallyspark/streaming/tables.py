"""Tables of one row a key in plain Parquet, for streams in update mode.

Each batch is a folder of its own, named by the batch's number: a batch that is
written again, after a failure, replaces what it wrote, so nothing counts twice.
A key's row is that of the latest batch that has one. `compact` puts the rows of
all batches so far into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], schema: str, order: str | None = None):
        """schema: of the rows, with the keys. order: of rows of one key in one batch the one with the largest stays; else they must be equal."""
        self.spark, self.path, self.keys, self.schema, self.order = spark, path, keys, schema, order

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Writes the batch's rows."""
        row = F.struct(*(f.name for f in self.spark.createDataFrame([], self.schema).schema))
        last = F.max_by(row, self.order) if self.order else F.max(row)
        rows.groupBy(*self.keys).agg(last.alias("row")).select("row.*").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def batches(self) -> DataFrame:
        """All batches' rows with their batch, also of an empty table."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        exists = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        schema = f"{self.schema}, batch bigint"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path) if exists else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """One row a key, by partial aggregation."""
        rows = self.batches()
        names = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), "batch").alias("row")).select("row.*")

    def compact(self, upto: int, into: str) -> KeyedTable:
        """A new table at another path that holds this one's rows up to a batch as that batch, later batches as they are."""
        rows, new = self.batches(), KeyedTable(self.spark, into, self.keys, self.schema, self.order)
        names = [c for c in rows.columns if c != "batch"]
        old = rows.where(F.col("batch") <= upto).groupBy(*self.keys).agg(F.max_by(F.struct(*names), "batch").alias("row")).select("row.*", F.lit(upto).alias("batch"))
        old.unionByName(rows.where(F.col("batch") > upto)).write.partitionBy("batch").mode("overwrite").parquet(into)
        return new
