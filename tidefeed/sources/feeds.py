"""RSS and Atom feeds."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.sources.html import parse, tidy


def _name(e) -> str:
    return e.tag.rpartition("}")[2].lower()


def entries(xml: str | None, most: int = 20) -> list[tuple[str, str, str, str, str]]:
    """(title, url, date, raw category, summary) of a feed's first entries; a feed that can't be read has none."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return []
    out = []
    for item in [e for e in root.iter() if _name(e) in ("item", "entry")][:most]:
        got: dict[str, str] = {}
        for c in item:
            value = c.get("href") if _name(c) == "link" and c.get("href") else c.get("term") if _name(c) == "category" and c.get("term") else "".join(c.itertext())
            got.setdefault(_name(c), value or "")
        date = next((got[k] for k in ("pubdate", "published", "updated", "created") if got.get(k)), "")
        summary = tidy(parse(got.get("description") or got.get("summary") or "").text())[:250]
        row = (tidy(got.get("title")), got.get("link", "").strip(), tidy(date), got.get("category", ""), summary)
        if row[0] and row[1].startswith("http"):
            out.append(row)
    return out


def scan(feeds: DataFrame, most: int = 20) -> DataFrame:
    """feeds (portal, xml) to portal, seq, title, url, date, category, summary."""

    def run(frames):
        for f in frames:
            rows = [(p, i, *e) for p, x in zip(f.portal, f.xml) for i, e in enumerate(entries(x, most))]
            yield pd.DataFrame(rows, columns=["portal", "seq", "title", "url", "date", "raw_category", "summary"])

    got = feeds.select("portal", "xml").mapInPandas(run, "portal string, seq long, title string, url string, date string, raw_category string, summary string")
    return got.withColumn("category", X.category(F.col("raw_category"))).drop("raw_category")


def rendered(articles: DataFrame, most: int = 20) -> DataFrame:
    """One feed per source of its first articles (id, title, url, category, excerpt, source): portal, xml. No more than `most` of a source are gathered."""

    def safe(c: str):
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    item = F.concat(F.lit("<item><title>"), safe("title"), F.lit("</title><link>"), safe("url"), F.lit("</link><category>"), safe("category"), F.lit("</category><description>"), safe("excerpt"), F.lit("</description></item>"))
    first = articles.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where(F.col("_r") <= most)
    got = first.select("source", "id", item.alias("item")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("r"))
    return got.select(F.col("source").alias("portal"), F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("r", lambda x: x["item"]), ""), F.lit("</channel></rss>")).alias("xml"))
