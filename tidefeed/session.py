"""Session defaults and the one place that decides where cut lineage is written."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidefeed", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; a cluster's own settings win for the rest."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        root = "file://" + tempfile.mkdtemp(prefix="tidefeed-", dir=_local_root())
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared checkpoint folder, for results that several branches of a plan use."""
    return read_back(df, scratch(df.sparkSession, "cut"))


def read_back(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the process ends."""
    if not _scratch:
        atexit.register(_remove)
    path = f"{checkpoint_root(spark)}/tidefeed-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables that are written inside go when it ends, not with the process: results are to be written or collected inside."""
    mark = len(_scratch)
    try:
        yield
    finally:
        _remove(mark)


def _remove(mark: int = 0) -> None:
    while len(_scratch) > mark:
        spark, path = _scratch.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # its session has ended: the folder goes with the cluster's own cleaning, the others are still tried
            continue


def _local_root() -> str:
    path = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(path, exist_ok=True)
    return path
