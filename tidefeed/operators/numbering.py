"""Row numbers and pages in a global order, by counts of ranges: no task sees more than its own range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.session import cut

_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with each row's number (from 1) in `order`, which must tell all rows apart.

    Rows are dealt out by ranges and sorted where they lie, and written with their place in their range; the ranges' counts, one row
    a range, give where each range begins. Numbers don't depend on where ranges are cut, so a repeated run agrees.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    counts = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = ranged.select("*", part).join(F.broadcast(starts), "_part")  # as many rows as partitions
    return rows.withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit(_LOCAL)) + 1).drop("_part", "_place", "_start")


def _bucket(key: Column, bounds: list, low: int = 0, high: int | None = None) -> Column:
    """How many of the ascending bounds are at most key, by bisection."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < bounds[mid], _bucket(key, bounds, low, mid)).otherwise(_bucket(key, bounds, mid + 1, high))


def rows_between(df: DataFrame, key: Column, first: int, size: int, buckets: int = 256, sample: int = 20_000, shallow: int = 10_000) -> DataFrame:
    """The rows number first + 1 to first + size of df in ascending order of key, a struct that tells all rows apart, with `row_no`.

    Up to `shallow` the top rows are taken. Beyond, a sample of keys cuts the order into buckets, one pass over the keys counts
    them, and only buckets that reach into the page are read and sorted. Where buckets are cut doesn't change the page.
    """
    keyed = df.select("*", key.alias("_key"))
    start, kept = 0, keyed
    if first + size > shallow:
        share = min(1.0, sample / max(1, df.count()))
        seen = sorted(keyed.select("_key").sample(share, seed=7).limit(2 * sample).collect(), key=lambda r: _ascending(r._key))
        bounds = [seen[i * len(seen) // buckets]._key for i in range(1, buckets) if seen]
        fields = keyed.schema["_key"].dataType.fields
        literals = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, fields)]) for b in dict.fromkeys(bounds)]
        placed = keyed.withColumn("_bucket", _bucket(F.col("_key"), literals))
        counts = sorted((r._bucket, r["count"]) for r in placed.groupBy("_bucket").count().collect())
        wanted, end = [], 0
        for b, n in counts:
            if end < first + size and end + n > first:
                start = end if not wanted else start
                wanted.append(b)
            end += n
        kept = placed.where(F.col("_bucket").isin(wanted)).drop("_bucket")
    page = kept.orderBy("_key").offset(first - start).limit(size)
    return page.withColumn("row_no", (F.row_number().over(Window.orderBy("_key")) + first).cast("long")).drop("_key")


def _ascending(key) -> tuple:
    """A struct's place in Spark's order: nulls come first."""
    return tuple((v is not None, v) for v in key)


def descending(column: str, kind: str = "timestamp") -> Column:
    """A long that ascends as a time or number descends, nulls first."""
    value = F.unix_micros(column) if kind == "timestamp" else F.col(column).cast("long")
    return F.coalesce(-value, F.lit(-(1 << 63)))
