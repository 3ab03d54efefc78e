"""What the training-data operators share: written tables, skew-safe joins, white space and stable folds."""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.session import checkpoint_root

#: The white space of all operators here: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str, str | None]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _place(spark: SparkSession, name: str, table: str | None = None) -> str:
    if not _written:
        atexit.unregister(_remove)
        atexit.register(_remove)
    path = f"{checkpoint_root(spark)}/tidefeed-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, table))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared checkpoint folder and read again: lineage ends there and lost executors cost nothing."""
    path = _place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, compression: str = "uncompressed") -> DataFrame:
    """Like written, but bucketed by key as it lies, without a shuffle: joins on key deal out the other side only.

    There are as many buckets as shuffle partitions. df's tasks should hold few keys each (a file is written for each
    of a task's buckets), so key is a number that the task itself has given out.
    """
    spark, table = df.sparkSession, f"tidefeed_{name}_{uuid.uuid4().hex}"
    path = _place(spark, name, table)
    n = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").option("compression", compression).option("path", path).bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Intermediate tables that are written inside go when it ends, not with the process, but for those given to what it yields
    (which takes what written() has just returned). Results are to be written or collected inside."""
    mark, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_written.pop())
        return df

    try:
        yield keep
    finally:
        _remove(mark)
        _written.extend(kept)


def _remove(mark: int = 0) -> None:
    while len(_written) > mark:
        spark, path, table = _written.pop()
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # its session has ended: the folder goes with the cluster's own cleaning, the others are still tried
            continue


def narrowed(rows: DataFrame, keys: DataFrame, key: str, n: int, most_blocks: int = 16384) -> DataFrame:
    """rows plus `_in`: false only where key is surely not among the n keys. The filter, 32 bits a key, is broadcast: at most 64 MB."""
    blocks = int(min(most_blocks, max(1, -(-n * 32 // 32768))))

    def place(c: Column) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(c, F.lit(1)), F.lit(32768))

    block, bit = place(F.col(key))
    bitmaps = keys.select(block.alias("_block"), bit.alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    probed = rows.withColumn("_block", block).withColumn("_bit", bit).join(F.broadcast(bitmaps), "_block", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return probed.withColumn("_in", F.coalesce(is_set, F.lit(False))).drop("_block", "_bit", "_bitmap")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """rows ⋈ groups, where groups has one row per key with the number of its rows.

    Keys with over 1/share of all rows are fewer than share, so their rows of groups are broadcast with a proven bound
    and the hot rows are never shuffled; the rest joins by shuffle and has no hot key left.
    """
    heavy = F.col(size) * share > F.lit(total)
    hot = rows.join(F.broadcast(groups.where(heavy)), key)
    cold = rows.join(F.broadcast(groups.where(heavy).select(key)), key, "left_anti").join(groups.where(~heavy), key)
    return hot.unionByName(cold)


def fold(column: str, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo mod (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def fold_of(doc_id: int | None, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
