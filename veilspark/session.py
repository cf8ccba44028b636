"""Session settings and the shared folder for intermediate data."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; partition counts follow the data on a cluster."""
    builder = (
        SparkSession.builder.master(master)
        .appName("veilspark")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the folder the cluster names in ``spark.checkpoint.dir``.

    Where it names none, a temporary folder serves a session whose driver and tasks are one process; on a
    cluster this is an error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        return tempfile.mkdtemp(prefix=f"veilspark-{name}-")
    return f"{base.rstrip('/')}/veilspark-{name}-{os.urandom(6).hex()}"
