"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``.

    Where that is unset a single process (tests, a laptop) takes a scratch folder
    that goes with it; a cluster is told to set one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="pixelseries-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The list gets the scratch paths that are made inside."""
    _scopes.append(made := [])
    try:
        yield made
    finally:
        _scopes.remove(made)


def delete_scratch(spark: SparkSession, paths: list[str], still_read: list[str] = ()) -> list[str]:
    """Delete scratch tables but for those that hold one of the files ``still_read``; returns what is left."""
    left = [p for p in paths if any(p.rsplit("/", 1)[-1] in f for f in still_read)]  # names are unique; schemes are spelt differently
    for path in set(paths) - set(left):
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
    return left


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the checkpoint folder and go on from there.

    The shared folder outlives executors, and later steps read only the
    columns they use. Shuffle files of the write go when it ends: nothing reads
    them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
