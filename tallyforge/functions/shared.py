"""Tables in the folder that the driver and all executors share, by which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a session within one process (master local[...]) gets a
    temporary folder; on a cluster, whose machines don't share one, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master!r})")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/tallyforge/{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            to = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
            to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
        except Exception:  # the JVM has gone: a shared mount can still be cleaned, else the store's own rules do it
            if path.startswith("file:"):
                shutil.rmtree(os.path.dirname(urlsplit(path).path), ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. Survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
