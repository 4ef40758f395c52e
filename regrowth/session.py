"""Session construction and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "regrowth", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; sizes such as partition counts are left to the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one below a warehouse that is not a machine's own disk.

    A local master (tests) has one machine, so there a fresh folder is used and removed when Python ends. A cluster without
    either setting is an error: files on one machine's disk would be missing on the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "") or ""
        if "://" in warehouse and not warehouse.startswith("file:"):
            root = f"{warehouse.rstrip('/')}/_work"
        elif spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_work_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str, path: str | None = None):
    """Write a result that several branches read to the shared folder, once, and read it back.

    Keeps retries and later branches from deriving it again from the source. A caller that knows when the result is no longer
    read passes its own ``path`` and discards it then.
    """
    path = path or new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work path that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
