"""Source snapshots and article batches as JSON, and the sinks that write tables back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from aeroflow.functions.text import content_hash

ITEM = StructType(
    [StructField(n, StringType()) for n in ("title", "url", "publishedUtc", "summary", "image")] + [StructField("dateInferred", BooleanType())]
)
SNAPSHOT = StructType(
    [StructField("source", StringType()), StructField("fetchedUtc", StringType()), StructField("ok", BooleanType()), StructField("error", StringType()), StructField("items", ArrayType(ITEM)), StructField("_corrupt_record", StringType())]
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per snapshot file with its path; a file that is no JSON has ``_corrupt_record``."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def items(snapshots: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of registered sources with the source's key; failed snapshots' items stay in.

    ``sources``: key, name; a small dimension.
    """
    exploded = snapshots.select("source", "fetchedUtc", "ok", F.posexplode("items").alias("place", "item"))
    named = exploded.join(sources, exploded["source"] == sources["name"])
    return named.select("key", "source", "fetchedUtc", "ok", "place", "item.*")


def warnings(snapshots: DataFrame) -> DataFrame:
    """Files that could not be read."""
    return snapshots.where("_corrupt_record is not null").select("file", F.lit("unreadable").alias("warning"))


def write_if_changed(new: DataFrame, path: str, keys: list[str], ignore: list[str] | None = None) -> bool:
    """Replace the Parquet table at ``path`` if its content differs outside ``ignore`` columns.

    Contents are compared as counted hashes of rows, on the executors. The new table is written
    beside the old one, which is renamed away for it and goes last; a job that is lost on the way
    leaves a whole table under one of the names.
    """
    spark = new.sparkSession
    columns = [c for c in new.columns if c not in (ignore or [])]
    counted = lambda df: df.groupBy(content_hash(*columns).alias("h")).agg(F.count("*").alias("n"))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        old = counted(spark.read.parquet(path)).withColumnRenamed("n", "was")
        if old.join(counted(new), "h", "full").where("not (was <=> n)").isEmpty():
            return False
    beside = [spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}-{kind}") for kind in ("new", "old")]
    new.orderBy(*keys).write.parquet(str(beside[0]))
    if fs.exists(fs_path):
        fs.rename(fs_path, beside[1])
    fs.rename(beside[0], fs_path)
    fs.delete(beside[1], True)
    return True


def append_by_hour(rows: DataFrame, path: str, stamp: str) -> None:
    """Append rows to hour partitions, which later reads can prune."""
    rows.withColumn("hour", F.date_format(stamp, "yyyy-MM-dd-HH")).write.mode("append").partitionBy("hour").parquet(path)


def sitemap(records: DataFrame, path: str, loc: str = "loc", lastmod: str = "lastmod") -> None:
    """Write distinct locations with their newest change as XML."""
    records.groupBy(loc).agg(F.max(lastmod).alias(lastmod)).write.mode("overwrite").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
