"""A plan of fetches: what robots rules allow, and when each address of a host may be asked for. Fetching itself is done elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.session import cut

EVERYTHING = "*"


def path_of(url: Column) -> Column:
    """Path and query, which rules are held against; an address without one asks for /."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def allowed(urls: DataFrame, rules: DataFrame, key: str = "page_id", longest: bool = False) -> DataFrame:
    """urls (key, url) with `allowed`; rules: host, ord (place in the host's file), allow, path.

    A rule holds for addresses whose path begins with its own (`*`: for all); forbidding nothing allows all. The first rule that
    holds decides, or the longest if so asked (of ties one that allows). Hosts without rules allow everything. Addresses meet rules
    by equality of prefixes, of the lengths that the host's rules have; where a host or prefix is hot, adaptive joins split it.
    """
    path = F.when(F.col("path") == EVERYTHING, "").otherwise(F.coalesce("path", F.lit("")))
    forbids = ~F.col("allow") & (F.coalesce("path", F.lit("")) != "")
    plain = rules.select("host", "ord", path.alias("prefix"), (~forbids).alias("allow"))
    rank = F.struct((-F.char_length("prefix")).alias("n"), (~F.col("allow")).alias("f")) if longest else F.struct(F.col("ord").alias("n"), F.lit(False).alias("f"))
    best = plain.withColumn("rank", rank).groupBy("host", "prefix").agg(F.min("rank").alias("rank"), F.min_by("allow", "rank").alias("allow"))
    lengths = best.groupBy("host").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    asked = urls.select(key, X.host(F.col("url")).alias("host"), path_of(F.col("url")).alias("_path")).join(lengths, "host")
    asked = asked.select(key, "host", "_path", F.explode("lengths").alias("n")).where(F.col("n") <= F.char_length("_path"))
    met = asked.select(key, "host", F.substring("_path", F.lit(1), F.col("n")).alias("prefix")).join(best, ["host", "prefix"])
    verdict = met.groupBy(key).agg(F.min_by("allow", "rank").alias("_allow"))
    return urls.join(verdict, key, "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


def start_times(urls: DataFrame, gap: Column, key: str = "page_id") -> DataFrame:
    """urls (key, url) with `start`: the sum of gaps before it among its host's addresses, in order of key.

    Addresses are cut into ranges of (host, key), so a hot host spreads over ranges; sums within a range are added to what the ranges
    before it hold of the host, one row for each range and host.
    """
    rows = urls.withColumn("_host", X.host(F.col("url"))).withColumn("_gap", gap)
    ranged = cut(rows.repartitionByRange("_host", key).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part", "_host").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("_host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("_host", "_part").agg(F.sum("_gap").alias("_sum"))
    before = held.select("_host", "_part", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_own", F.coalesce(F.sum("_gap").over(inner), F.lit(0)))
    return local.join(before, ["_host", "_part"]).withColumn("start", F.col("_before") + F.col("_own")).drop("_host", "_part", "_gap", "_own", "_before")
