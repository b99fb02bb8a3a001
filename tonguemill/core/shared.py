"""The folder that the driver and all executors share, and writing to it from tasks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from tonguemill.core.config import open_folder

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the cluster sets it. Where it is unset, a temporary folder on one machine (tests), an error on a cluster."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _own.get(context.applicationId) or tempfile.mkdtemp(prefix="spark-")
        _own[context.applicationId] = at
    return at.rstrip("/")


def hadoop_path(spark: SparkSession, at: str):
    """Spark's file system and path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends, as results may read it until then."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = hadoop_path(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def put(uri: str, write) -> None:
    """Writes a file by write(stream) under a hidden name and moves it, so nobody sees half of it; an equal name is replaced."""
    fs, path = open_folder(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, path)
