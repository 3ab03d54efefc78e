"""What operators 12 and 13 share: vectors packed in blocks that tasks hold as numpy arrays, read again in each pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROWS = 4096
#: Scaled components stay below this in size, so that squares over a vector fit 64 bits (2**30.5 over the root of the dimensions).
_ROOM = 2.0**30.5


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `embeddings` as vec_id, vector, label."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"), "label")


def usable(rows: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, vector, ...) with a whole, finite vector of the most frequent length (of ties the greater), and that length.

    Left out besides: vectors with a component whose scaled value is too great for 64-bit squares. 0 means that nothing is left.
    """
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale * F.sqrt(F.size(v)) < _ROOM))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & fine)
    top = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = int(top.d) if top else 0
    return rows.where(F.size(v) == d), d


def scaled(batch: pa.RecordBatch, d: int, scale: int, plus: int) -> np.ndarray:
    """floor(scale * component) + plus of a batch's vectors, as 64-bit integers."""
    v = batch.column("vector")
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(batch.num_rows, d) + plus


def packed(rows: DataFrame, d: int, scale: int, plus: int, columns: dict[str, str], name: str) -> DataFrame:
    """Blocks of up to ROWS vectors: n, x (integers, row by row), and the other columns as arrays. Written to the shared folder once."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = scaled(part, d, scale, plus).tobytes()
                lists = [pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([x], pa.binary()), *lists], names=["n", "x", *columns])

    schema = "n int, x binary, " + ", ".join(f"{c} array<{t}>" for c, t in columns.items())
    return common.written(rows.select("vector", *[F.col(c).cast(t).alias(c) for c, t in columns.items()]).mapInArrow(run, schema), name)


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, dict]]:
    """The packed blocks of a task: x and the row's other columns."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names if c != "x"}
            yield np.frombuffer(batch.column("x")[i].as_py(), np.int64).reshape(-1, d), row


def summed(packs: DataFrame, d: int, shape: tuple[int, ...], kind: type, add: Callable[[np.ndarray, np.ndarray], None], fan: int = 64) -> np.ndarray:
    """add(total, x) over all blocks, from zeros of `shape`. A task sends its total once, as rows (place, value); groups of tasks
    are summed first, so no reducer meets all tasks, and only the one total reaches the driver."""
    sql = "long" if kind is np.int64 else "double"

    def run(batches: Iterator[pa.RecordBatch]):
        total, any_block = np.zeros(shape, kind), False
        for x, _ in blocks(batches, d):
            add(total, x)
            any_block = True
        if any_block:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["place", "value"])

    parts = packs.select("n", "x").mapInArrow(run, f"place int, value {sql}").withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(fan)))
    rows = parts.groupBy("place", "_group").agg(F.sum("value").alias("value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(int(np.prod(shape)), kind)
    for r in rows:
        out[r.place] = r.value
    return out.reshape(shape)
