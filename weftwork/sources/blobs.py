"""Content-addressed blobs: writing, reading, checking and pruning a store of files by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(df: DataFrame, content: str) -> DataFrame:
    """hash, size, content: one row per distinct content."""
    h = df.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.octet_length(content).alias("size"), F.col(content).alias("content"))
    return h.dropDuplicates(["hash"])


def get(blobs: DataFrame, key: str) -> DataFrame:
    """The blob under a hash, if its content still has it."""
    return blobs.filter((F.col("hash") == key) & (F.sha2(F.col("content").cast("binary"), 256) == F.col("hash")))


def corrupt(blobs: DataFrame) -> DataFrame:
    """Hashes whose content differs."""
    return blobs.filter(F.col("content").isNull() | (F.sha2(F.col("content").cast("binary"), 256) != F.col("hash"))).select("hash")


def prune(blobs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by a set of hashes to keep."""
    k = keep.select("hash").distinct()
    return blobs.join(k, "hash", "left_semi"), blobs.join(k, "hash", "left_anti")


def write_store(blobs: DataFrame, path: str) -> None:
    """A Parquet store partitioned by the hash's first two digits; one file per shard and task of that shard only."""
    out = blobs.withColumn("shard", F.substring("hash", 1, 2))
    out.repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def read_store(spark: SparkSession, path: str, key: str = "") -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter((F.col("shard") == key[:2]) & (F.col("hash") == key)) if key else df


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """hash, size, path of a directory of files <2 hex>/<62 hex>.bin; other names are passed over."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(path).select("path", "length")
    m = F.regexp_extract("path", r"/([0-9a-f]{2})/([0-9a-f]{62})\.bin$", 0)
    return df.filter(m != "").select(F.concat(F.regexp_extract("path", r"/([0-9a-f]{2})/([0-9a-f]{62})\.bin$", 1), F.regexp_extract("path", r"/([0-9a-f]{2})/([0-9a-f]{62})\.bin$", 2)).alias("hash"), F.col("length").alias("size"), "path")
