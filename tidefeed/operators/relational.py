"""Filters, paging, counts, top lists and profiles over the logical tables. Every function is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.functions.scoring import percentage
from tidefeed.operators.numbering import descending, rows_between


def equals(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Optional equality: no value, or all categories, filters nothing."""
    return df.where(F.col(column) == value) if value and value != X.ALL_CATEGORIES else df


def contains(df: DataFrame, column: str, query: str | None) -> DataFrame:
    """Case-insensitive; % and _ in the query stay wildcards."""
    return df.where(F.col(column).ilike(f"%{query}%")) if query else df


def category_or_title(df: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return df if query == X.ALL_CATEGORIES else df.where(F.lower("category").contains(q) | F.lower("title").contains(q))


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int) -> DataFrame:
    """A page (numbered from 1) with each row's number."""
    size = min(size, most)
    first = (number - 1) * size
    rows = df.orderBy(*order).offset(first).limit(size)
    return rows.withColumn("row_no", (F.row_number().over(Window.orderBy(*order)) + first).cast("long"))


def newest_page(df: DataFrame, column: str, tie: str, number: int, size: int, most: int, **options) -> DataFrame:
    """page() in order of newest(), for pages at any depth: only the part of the table around the page is sorted."""
    size = min(size, most)
    return rows_between(df, F.struct(descending(column).alias("t"), F.col(tie).alias("i")), (number - 1) * size, size, **options)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def newest(column: str, tie: str) -> list[Column]:
    return [F.col(column).desc_nulls_first(), F.col(tie)]


def top_by_count(df: DataFrame, keys: list[str], name: str, n: int, tie: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), *tie).limit(n)


def joined(ix: DataFrame, articles: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Interactions with their articles (and users); broadcast or shuffle is the optimiser's choice by size."""
    a = articles.select(F.col("id").alias("article_id"), "title", "source", "category", "image_url")
    out = ix.join(a, "article_id")
    return out if users is None else out.join(users.withColumnRenamed("id", "user_id"), "user_id")


def recommendation_ctr(ix: DataFrame) -> DataFrame:
    def n(kind: str) -> Column:
        return F.count(F.when(F.col("event_type") == kind, 1))

    one = ix.agg(n("click").alias("total_organic_clicks"), n("rec_click").alias("total_rec_clicks"), n("read").alias("total_read"), n("share").alias("total_share"), F.countDistinct(F.when(F.col("event_type") == "rec_click", F.col("user_id"))).alias("users_clicked_rec"), F.countDistinct("user_id").alias("users_total"))
    return one.withColumn("ctr_recommendation_pct", percentage(F.col("total_rec_clicks"), F.col("total_organic_clicks") + F.col("total_rec_clicks"))).withColumn("adoption_rate_pct", percentage(F.col("users_clicked_rec"), F.col("users_total")))


def user_timeline(ix: DataFrame, articles: DataFrame, user_id: int) -> DataFrame:
    return joined(ix.where(F.col("user_id") == user_id), articles).select(F.col("id").alias("event_id"), "created_at", "article_id", "title", "source", X.label(F.col("category")).alias("category"), "event_type")


def user_categories(timeline: DataFrame) -> DataFrame:
    """Labelled before grouping; ties in order of first appearance."""
    return timeline.groupBy("category").agg(F.count("*").alias("count"), F.min(F.struct("created_at", "event_id")).alias("_first")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), "_first")).cast("long")).drop("_first")


def user_hours(timeline: DataFrame) -> DataFrame:
    hours = timeline.sparkSession.range(24).select(F.col("id").alias("hour"))
    counts = timeline.groupBy(F.hour("created_at").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def portal_status(portals: DataFrame, inactive: DataFrame) -> DataFrame:
    off = inactive.select("domain").distinct().withColumn("_off", F.lit(True))
    base = F.coalesce(F.get("html_urls", F.lit(0)), F.get("rss_urls", F.lit(0)))
    return portals.join(off, "domain", "left").select(F.col("id").cast("long").alias("id"), "name", "domain", "method", base.alias("base_url"), F.size("rss_urls").cast("long").alias("n_rss"), F.size("html_urls").cast("long").alias("n_html"), F.col("_off").isNull().alias("active"))


def select_portals(portals: DataFrame, inactive: DataFrame, chosen: list[str] | None) -> DataFrame:
    on = portals.join(inactive.select("domain"), "domain", "left_anti")
    return on.where(F.col("name").isin(*chosen)) if chosen else on


def toggled(stored: DataFrame, domain: str, active: bool) -> DataFrame:
    """stored (domain, active) with one domain switched, added if absent."""
    spark = stored.sparkSession
    new = spark.createDataFrame([(domain, active)], "domain string, active boolean")
    return stored.join(new.withColumnRenamed("active", "_new"), "domain", "full_outer").select("domain", F.coalesce("_new", "active").alias("active"))


def listing(rss: DataFrame, html: DataFrame, least: int = 5) -> DataFrame:
    """Feed rows, and listing rows where the method says so or the feed gave fewer than `least`; the first of each raw url stays."""
    few = rss.groupBy("portal").agg(F.count("*").alias("_n"))
    more = html.join(few, "portal", "left").where((F.col("method") == "html") | ((F.col("method") == "hybrid") & (F.coalesce("_n", F.lit(0)) < least))).drop("_n")
    both = rss.withColumn("_part", F.lit(0)).unionByName(more.withColumn("_part", F.lit(1)))
    first = Window.partitionBy("portal", "url").orderBy("_part", "seq")
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_part")


# Paragraphs that only tell an age or point elsewhere.
AGES = r"(?i)^\d{1,2}\s+(jam|menit|detik|hari)\s+yang\s+lalu"
POINTERS = r"(?i)^(baca juga|lihat juga|artikel terkait)"


def paragraphs_kept(paragraphs: DataFrame) -> DataFrame:
    """page_id, pos, p: paragraphs of 40 characters and more that aren't ages or pointers, the first of each 60 leading characters."""
    good = paragraphs.where((F.char_length("p") >= 40) & ~F.col("p").rlike(AGES) & ~F.col("p").rlike(POINTERS))
    first = Window.partitionBy("page_id", F.substring("p", 1, 60)).orderBy("pos")
    return good.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def bodies(kept: DataFrame) -> DataFrame:
    parts = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("_p"))
    return parts.select("page_id", F.array_join(F.transform("_p", lambda x: x["p"]), "\n\n").alias("body"), X.clip(F.get("_p", F.lit(0))["p"], 250, dots=True).alias("summary"))


def image_urls(pages: DataFrame, pictures: DataFrame) -> DataFrame:
    """page_id, image_url: the first meta tag that names one, else the first content picture with an address that isn't a logo's, else nothing."""
    src = X.strip(F.col("src"))
    good = F.when(F.col("rank") < 2, src != "").otherwise(src.startswith("http") & ~F.lower(src).contains("logo"))
    best = pictures.where(good).groupBy("page_id").agg(F.min_by(src, "rank").alias("image_url"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.coalesce("image_url", F.lit("")).alias("image_url"))


def fallback(a: DataFrame, b: DataFrame) -> DataFrame:
    """Content of extractor a if it succeeded with over 200 characters, else b's, else none (key: page_id)."""
    left = a.select("page_id", F.col("body").alias("_a"), F.col("summary").alias("_as"), F.col("ok").alias("_ok"))
    use = F.col("_ok") & (F.char_length("_a") > 200)
    return left.join(b.select("page_id", "body", "summary"), "page_id", "left").select("page_id", F.when(use, F.col("_a")).otherwise(F.coalesce("body", F.lit(""))).alias("body"), F.when(use, F.col("_as")).otherwise(F.coalesce("summary", F.lit(""))).alias("summary"), F.when(use, "a").when(F.col("body").isNotNull(), "b").otherwise("none").alias("extractor"))
