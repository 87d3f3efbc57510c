"""Session settings and the table loader."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "qaloom", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster only the SQL settings matter; `master` and `shuffle` are for local use.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle)).config("qaloom.spread", str(shuffle))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (`spark.checkpoint.dir`). A temporary one is used only in local mode, as in
    tests: on a cluster every executor must see the folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="qaloom-ckpt-")
    sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet into the shared checkpoint folder and read back, for results that several steps read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession) -> int | None:
    """Tasks that heavy work on a test table in few splits is spread over (`qaloom.spread`); unset on a cluster."""
    n = spark.conf.get("qaloom.spread", None)
    return int(n) if n else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
