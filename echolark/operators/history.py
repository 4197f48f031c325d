"""Versioned rows with validity intervals, merged into a stored table by partition.

A family has versions, of which one is active. Building a version again keeps its id, opens a new interval
and closes the one that was open; so does building another version. The table is partitioned by a
hash of the family, and a build rewrites the partitions of its families only, in one commit each, from rows
that were written beforehand.

Builds are told by a number that grows. A build that comes again, after a failure half way or later, first
takes back what it did before: its intervals go, and those that it closed are open again. Of equal
families in one build the last by version and order counts; null families are left out; versions may be null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import hold, read_table, scratch, shared_dir, staged

PARTITIONS = 32


def version_id(family: list[str], version: str) -> Column:
    """An id that depends on family and version alone, so that it is stable however often they are built."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in (*family, version)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


class History:
    """A table of families `family`, versions and columns `values` under `path`."""

    def __init__(self, spark: SparkSession, path: str, family: list[str], version: str, values: list[str], schema: str):
        self.spark, self.path, self.family, self.version, self.values = spark, path, family, version, values
        self.schema = f"{schema}, id string, valid_from long, valid_to long, part int"

    @property
    def columns(self) -> list[str]:
        return [*self.family, self.version, *self.values, "id", "valid_from", "valid_to"]

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def active(self) -> DataFrame:
        return self.read().where("valid_to is null").drop("part", "valid_to")

    def build(self, rows: DataFrame, order: str, number: int) -> None:
        """Activates the versions of rows (families, version, values and the column `order`)."""
        part = F.pmod(F.xxhash64(*self.family), F.lit(PARTITIONS)).cast("int").alias("part")
        known = rows.where(" and ".join(f"`{c}` is not null" for c in self.family))
        last = F.row_number().over(Window.partitionBy(*self.family).orderBy(F.desc_nulls_last(self.version), F.desc(order)))
        new = known.withColumn("last", last).where("last = 1").select(*self.family, self.version, *self.values, version_id(self.family, self.version).alias("id"), F.lit(number).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), part)
        with scratch(self.spark):
            new = staged(new)
            stored = self.read()
            # rows of an earlier run of this build, and what it closed, are taken back
            undone = stored.where(F.col("valid_from") != number).withColumn("valid_to", F.when(F.col("valid_to") != number, F.col("valid_to")))
            touched = stored.where((F.col("valid_from") == number) | (F.col("valid_to") == number)).select("part").union(new.select("part")).distinct()
            families = new.select(*self.family, F.lit(True).alias("built"))
            kept = undone.join(F.broadcast(touched), "part", "left_semi").join(families, self.family, "left")
            closed = F.when(F.col("valid_to").isNull() & F.col("built"), F.lit(number).cast("long")).otherwise(F.col("valid_to"))
            merged = staged(kept.select(*self.family, self.version, *self.values, "id", "valid_from", closed.alias("valid_to"), "part").unionByName(new))
            merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)


def benchmark_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three builds of the parts, a third of them each, the second run twice: all intervals of each brand and size."""
    p = read_table(spark, sf_dir, "part")
    path = hold(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    kept = History(spark, f"{path}/table", ["p_brand", "p_size"], "p_type", ["p_retailprice"], "p_brand string, p_size int, p_type string, p_retailprice double")
    for number in (1, 2, 2, 3):
        kept.build(p.where(F.col("p_partkey") % 3 == number - 1), "p_partkey", number)
    return kept.read().select(*kept.columns, F.col("valid_to").isNull().alias("active"))


QUERIES = {"benchmark_history": benchmark_history}
ORACLE_SQL = {
    "benchmark_history": """WITH b AS (SELECT *, p_partkey % 3 + 1 AS k FROM part),
      l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY p_brand, p_size, k ORDER BY p_type DESC, p_partkey DESC) = 1),
      h AS (SELECT *, lead(k) OVER (PARTITION BY p_brand, p_size ORDER BY k) AS valid_to FROM l)
      SELECT p_brand, p_size, p_type, p_retailprice, substr(sha256(strlen(p_brand) || ':' || p_brand || length(p_size::VARCHAR) || ':' || p_size || strlen(p_type) || ':' || p_type), 1, 16) AS id,
        CAST(k AS BIGINT) AS valid_from, CAST(valid_to AS BIGINT) AS valid_to, valid_to IS NULL AS active FROM h""",
}
