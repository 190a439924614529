"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vigilflow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local master without that setting may use a temporary folder of its
    machine, removed when Python ends: on a cluster the executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    root = tempfile.mkdtemp(prefix="vigilflow-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def _local_root(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


def settle(df, name: str, compression: str | None = None):
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a re-run.
    ``compression`` is for tables of digests, which the default codec leaves at full size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
