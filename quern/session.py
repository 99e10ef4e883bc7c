"""Session helpers: table loading, lineage cutting and shared scratch space."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    It is the one named in ``spark.checkpoint.dir``; only where nothing is set (as in local tests) a
    temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"quern-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)
    return named


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder; what is written there vanishes as cut tables do."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quern-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    A written table is compressed and columnar, is computed once, and later reads take only the columns they
    need. Any executor can read it, so the loss of one costs nothing. Tables vanish when the driver ends, or with
    the ``released`` block they were made in.
    """
    spark = df.sparkSession
    at = scratch(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def released():
    """Tables cut inside the block are removed at its end: for services, whose driver lives on."""
    kept = len(_written)
    try:
        yield
    finally:
        _remove(_written[kept:])
        del _written[kept:]


@atexit.register
def _clear() -> None:
    _remove(_written)


def _remove(written: list[tuple[SparkSession, str]]) -> None:
    for spark, at in written:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; its owner clears the folder
            return


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
