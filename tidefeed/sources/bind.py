"""Logical tables of the news model, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.functions import text as X

ASOF = "2024-01-31 00:00:00"
#: The driver's event types as the model's; others stay.
EVENT_TYPES = {"view": "read", "purchase": "share", "signup": "rec_click"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_interactions(table(spark, sf_dir, "events"))


def as_interactions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    for old, new in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    article = F.expr("try_cast(get_json_object(props, '$.k') AS bigint)")
    return events.select(F.col("event_id").alias("id"), "user_id", article.alias("article_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("created_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().withColumn("pseudonym", F.concat(F.lit("user_"), F.col("id").cast("string")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), X.strip(F.substring_index("text", "\n", 1)).alias("title"), F.substring("text", 1, 250).alias("excerpt"), F.col("text").alias("body"), "source",
        F.col("lang").alias("category"), F.lit("").alias("image_url"), F.concat(F.lit("https://www.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.timestamp_micros((F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60_000_000)).alias("parsed_at"),
    )


def portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One portal per source, in order; its position is its id."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).where("name is not null").distinct()
    numbered = names.withColumn("id", F.row_number().over(Window.orderBy("name")))
    return numbered.select(
        "id", "name", F.concat("name", F.lit(".example.com")).alias("domain"), F.when(F.col("id") % 3 == 0, "rss").otherwise("hybrid").alias("method"),
        F.array(F.concat(F.lit("https://rss."), "name", F.lit(".example.com/"))).alias("rss_urls"),
        F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://www."), "name", F.lit(".example.com/")))).alias("html_urls"),
    )
