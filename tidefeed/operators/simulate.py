"""Simulated readers: seeded, one row per event, without a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.operators.numbering import numbered


def simulate(articles: DataFrame, n_users: int = 200, asof: str = "2024-01-31 00:00:00", days: int = 30, seed: int = 1) -> DataFrame:
    """pseudonym, article_id, event_type, created_at.

    40 % of readers are active (15-40 clicks), the others click 5-14 times; 70 % of clicks come from preferred categories,
    20 % from a fifth of the articles, the rest from all; an article is clicked once by a reader; 35 % of clicks are read
    30 to 300 s later, 5 % of those shared 5 to 60 s after that.
    """
    def u(*salt):  # uniform in [0, 1), a function of the row alone
        return F.pmod(F.xxhash64(*[F.lit(x) if isinstance(x, (int, str)) else x for x in (seed, *salt)]), F.lit(1 << 40)) / float(1 << 40)

    spark = articles.sparkSession
    user = F.col("user")
    users = spark.range(n_users).select(F.col("id").alias("user"), X.pseudonym(F.concat(F.lit(f"sim{seed}_"), F.col("id").cast("string"))).alias("pseudonym"))
    clicks = F.when(u(user, "active") < 0.4, 15 + F.floor(u(user, "n") * 26)).otherwise(5 + F.floor(u(user, "n") * 10))
    drawn = users.withColumn("click", F.explode(F.sequence(F.lit(1), clicks.cast("int"))))
    mode = u(user, F.col("click"), "mode")
    drawn = drawn.withColumn("pool", F.when(mode < 0.7, F.concat(F.lit("c"), F.floor(u(user, F.floor(u(user, F.col("click"), "pref") * 3), "cat") * 1_000_000).cast("string"))).when(mode < 0.9, "popular").otherwise("all")).withColumn("r", u(user, F.col("click"), "pick"))
    cats = articles.select("category").distinct().withColumn("_c", F.row_number().over(Window.orderBy("category")) - 1)
    n_cats = cats.count()
    pools = (
        articles.join(cats, "category").select("id", F.concat(F.lit("c"), F.col("_c").cast("string")).alias("pool"))
        .unionByName(articles.where(u(F.col("id"), "popular") < 0.2).select("id", F.lit("popular").alias("pool"))).unionByName(articles.select("id", F.lit("all").alias("pool")))
    )
    placed = numbered(pools, [F.col("pool"), F.col("id")], "_n")  # counts of ranges, so no task numbers a whole pool
    sizes = placed.groupBy("pool").agg(F.min("_n").alias("_first"), F.count("*").alias("size"))
    placed = placed.join(F.broadcast(sizes.select("pool", "_first")), "pool").select("pool", "id", (F.col("_n") - F.col("_first") + 1).cast("int").alias("place"))
    chosen = drawn.withColumn("pool", F.when(F.col("pool").startswith("c"), F.concat(F.lit("c"), (F.substring("pool", 2, 9).cast("long") % max(1, n_cats)).cast("string"))).otherwise(F.col("pool")))
    picked = chosen.join(F.broadcast(sizes.select("pool", "size")), "pool").withColumn("place", (F.floor(F.col("r") * F.col("size")) + 1).cast("int")).join(placed, ["pool", "place"])
    once = picked.groupBy("user", "pseudonym", F.col("id").alias("article_id")).agg(F.min("click").alias("click"))
    at = F.unix_micros(F.lit(asof).cast("timestamp")) - F.floor(u(user, F.col("click"), "ts") * days * 86_400_000_000)
    read = at + F.floor((30 + u(user, F.col("click"), "rd") * 270) * 1_000_000)
    share = read + F.floor((5 + u(user, F.col("click"), "sd") * 55) * 1_000_000)
    is_read = u(user, F.col("click"), "read") < 0.35
    events = F.array(F.struct(F.lit("click").alias("k"), at.alias("t")), F.when(is_read, F.struct(F.lit("read").alias("k"), read.alias("t"))), F.when(is_read & (u(user, F.col("click"), "share") < 0.05), F.struct(F.lit("share").alias("k"), share.alias("t"))))
    return once.select("pseudonym", "article_id", F.explode(F.array_compact(events)).alias("e")).select("pseudonym", "article_id", F.col("e.k").alias("event_type"), F.timestamp_micros("e.t").alias("created_at"))
