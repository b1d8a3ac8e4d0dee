"""Sinks that appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, order: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write to a staging folder, rename it into place, and read it with the known schema.

    Hadoop's file system does both, so any store that Spark knows will do.
    """
    spark = df.sparkSession
    staging = f"{path}._staging"
    writer = (df.sortWithinPartitions(*order) if order else df).write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(staging)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(source, jvm.org.apache.hadoop.fs.Path(path)):
        fs.delete(source, True)
        raise OSError(f"{path} could not be published")
    return spark.read.schema(df.schema).parquet(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: its rows and a digest that does not depend on their order."""
    from ..operators.quality import unordered_digest

    out = None
    for name in sorted(tables):
        row = unordered_digest(tables[name], *tables[name].columns).select(F.lit(name).alias("table_name"), "n", "digest")
        out = row if out is None else out.unionByName(row)
    return out
