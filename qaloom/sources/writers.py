"""Writers: partitioned tables, keyed updates, event sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.operators.vectors import merge_documents, upsert_points
from qaloom.session import ensure_checkpoint_dir


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a partitioned table. Rows are rebalanced on the partition columns: Spark splits a hot value by its bytes
    over as many tasks as that takes, and a small one does not leave a file per task."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def overwrite_touched(spark: SparkSession, updated: DataFrame, touched: DataFrame, path: str, partition_by: str) -> None:
    """Replace only the partitions that hold updated rows.

    updated: the whole new table (lazily built); touched: the partition values with changes.
    """
    rows = updated.join(touched.select(partition_by).distinct(), partition_by, "left_semi")
    _replace_partitions(spark, rows, path, partition_by)


def upsert_table(
    spark: SparkSession, incoming: DataFrame, path: str, key: str = "id", version: str = "version", partition_by: str = "collection"
) -> None:
    """Upsert into a partitioned table: only partitions named by the incoming rows are read, merged and replaced, so the
    cost follows the batch and not the table. A key belongs to one partition for good, as a point does to its collection.
    """
    table = _opened(spark, path, incoming)
    touched = incoming.select(partition_by).distinct()
    existing = table.join(touched, partition_by, "left_semi").select(*incoming.columns)
    _replace_partitions(spark, upsert_points(existing, incoming, key, version), path, partition_by)


def _opened(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at `path` with the columns of `like`; no rows where there is none yet."""
    try:
        table = spark.read.schema(like.schema).parquet(path)
        table.schema  # noqa: B018
        return table.select(*like.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


BUCKETS = 64


def merge_points(spark: SparkSession, incoming: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Merge the versioned points of one batch into the table at `path`, see `vectors.merge_documents`.

    The table is cut by collection and by bucket of the document, so a batch reads and rewrites the buckets of its own documents
    only, also in a collection that holds most points. The merged buckets are written beside the table first and take their places
    then: a batch that failed in between is repeated from that copy, one that failed earlier finds the table as it was, and
    one that is delivered again changes nothing.
    """
    ready, done = f"{path}_merged/batch={batch_id}/points", f"{path}_merged/batch={batch_id}/done"
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    new = incoming.withColumn("bucket", bucket)
    if not _opened(spark, done, spark.createDataFrame([], "batch bigint")).count():
        table = _opened(spark, path, new)
        touched = new.select("collection", "bucket").distinct()
        existing = table.join(touched, ["collection", "bucket"], "left_semi").select(*new.columns)
        merge_documents(existing, new).write.mode("overwrite").parquet(ready)
        spark.createDataFrame([(batch_id,)], "batch bigint").write.mode("overwrite").parquet(done)
    rows = spark.read.schema(new.schema).parquet(ready)
    (
        rows.hint("rebalance", "collection", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection", "bucket").parquet(path)
    )
    _remove(spark, f"{path}_merged/batch={batch_id - 1}")


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _replace_partitions(spark: SparkSession, rows: DataFrame, path: str, partition_by: str) -> None:
    """Dynamic partition overwrite from a checkpoint, since the rows come from the files they replace."""
    ensure_checkpoint_dir(spark)
    (
        rows.checkpoint().hint("rebalance", partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by).parquet(path)
    )


def write_events(events: DataFrame, target: str, fmt: str = "text", **options) -> None:
    """Write a `value` column: text files of JSON lines, or a topic when fmt='kafka'."""
    w = events.select("value").write.format(fmt).options(**options)
    if fmt == "kafka":
        w.option("topic", target).save()
    else:
        w.mode("append").save(target)
