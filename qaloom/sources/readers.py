"""Readers: tables, blobs, event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, source: str, schema: StructType | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A table by path (file formats) or by name (fmt='table'); fmt='jdbc' takes url and driver as options."""
    if fmt == "table":
        return spark.read.table(source)
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.option("dbtable", source).load()
    return (reader.schema(schema) if schema else reader).load(source)


def read_blobs(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files under root: key (path below root), name, size, modified, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    key = F.regexp_replace(F.split_part(F.col("path"), F.lit(base), F.lit(-1)), "^/", "")
    return files.select(
        key.alias("key"), F.split_part(key, F.lit("/"), F.lit(-1)).alias("name"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content",
    )


def stream_lines(spark: SparkSession, source: str, fmt: str = "text", **options) -> DataFrame:
    """Event lines as a stream with one `value` column, from the earliest position.

    fmt='text' watches a folder of JSON lines; fmt='kafka' needs the connector on the cluster, with the topic as source.
    """
    if fmt == "kafka":
        src = (
            spark.readStream.format("kafka").option("subscribe", source)
            .option("startingOffsets", "earliest").options(**options).load()
        )
        return src.select(F.col("value").cast("string").alias("value"))
    return spark.readStream.format(fmt).options(**options).load(source).select("value")
