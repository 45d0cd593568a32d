"""Session helpers: one builder for tests and benchmarks, one way to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "stockloom", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder.  A local session may lack it; on a
    cluster, where a temporary folder would be another one on every machine, it must be set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; columns that nobody reads are not read back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stockloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="stockloom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own
