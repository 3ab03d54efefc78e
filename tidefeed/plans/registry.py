"""Queries over the reference data model, by operator id, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.functions.scoring import Params, decay_weight, event_weight, rounded
from tidefeed.operators import dedup, recommend
from tidefeed.operators import relational as R
from tidefeed.plans import extra
from tidefeed.session import cut
from tidefeed.sources import bind as B
from tidefeed.sources import html

QUERIES: dict = {}
ORACLE: dict = {}

#: The logical tables in the oracle's SQL.
BASE = r"""
WITH ix AS (SELECT event_id AS id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'share' WHEN 'signup' THEN 'rec_click' ELSE event_type END AS event_type,
  ts::TIMESTAMP AS created_at FROM events),
usr AS (SELECT DISTINCT user_id AS id, concat('user_', user_id) AS pseudonym FROM events),
art AS (SELECT doc_id AS id, regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') AS title, left(text, 250) AS excerpt,
  text AS body, source, lang AS category, '' AS image_url, concat('https://www.example.com/', doc_id) AS url,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS parsed_at FROM documents)
"""
#: The recommendation model in the oracle's SQL.
MODEL = BASE + r""",
m AS (SELECT user_id, article_id, sum(exp(-0.1::DOUBLE * greatest(0::DOUBLE, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) / 86400000000::DOUBLE))
  * CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'read' THEN 2.0::DOUBLE WHEN 'share' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) AS w
  FROM ix WHERE user_id IS NOT NULL AND article_id IS NOT NULL GROUP BY ALL),
nrm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM m GROUP BY 1),
sims AS (SELECT item_a, item_b, dot / (a.n * b.n) AS sim FROM (SELECT a.article_id AS item_a, b.article_id AS item_b, sum(a.w * b.w) AS dot
  FROM m a JOIN m b ON a.user_id = b.user_id AND a.article_id <> b.article_id GROUP BY ALL)
  JOIN nrm a ON a.article_id = item_a JOIN nrm b ON b.article_id = item_b WHERE dot / (a.n * b.n) > 0.1::DOUBLE)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def TS(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- scans -----------------------------------------------------------------------------------------------------------
@query("s1_interactions", BASE + f"SELECT user_id, article_id, event_type, {TS('created_at')} AS created_at FROM ix")
def s1(s: SparkSession, d: str) -> DataFrame:
    return B.interactions(s, d).select("user_id", "article_id", "event_type", ts("created_at").alias("created_at"))


@query("s4_summary", r"""
SELECT doc_id, CASE WHEN length(t) > 300 THEN concat(left(t, 297), '...') ELSE t END AS summary FROM (
  SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text || ' ', '(?s)(.+?[.!?]|.+?$)(?:\s+|$)', 1),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 30)[1:2], ' ') AS t FROM (SELECT doc_id, regexp_replace(text, '\s+$', '') AS text FROM documents))
""")
def s4(s, d):
    return B.table(s, d, "documents").select("doc_id", X.summary(F.regexp_replace("text", r"\s+$", "")).alias("summary"))


PARAGRAPHS = r"paras AS (SELECT doc_id AS page_id, unnest(range(len(p))) AS pos, unnest(p) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),"
KEPT = r""" kept AS (SELECT page_id, pos, p FROM paras WHERE length(p) >= 40 AND NOT regexp_matches(p, '(?i)^\d{1,2}\s+(jam|menit|detik|hari)\s+yang\s+lalu')
  AND NOT regexp_matches(p, '(?i)^(baca juga|lihat juga|artikel terkait)') QUALIFY row_number() OVER (PARTITION BY page_id, left(p, 60) ORDER BY pos) = 1),
b AS (SELECT page_id, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS body, first(p ORDER BY pos) AS p1 FROM kept GROUP BY 1)"""


def _paragraphs(s, d):
    return B.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "p"))


@query("s5_paragraphs", "WITH " + PARAGRAPHS + KEPT + " SELECT page_id, sha256(body) AS body_sha, concat(left(p1, 250), CASE WHEN length(p1) > 250 THEN '...' ELSE '' END) AS summary FROM b")
def s5(s, d):
    b = R.bodies(R.paragraphs_kept(_paragraphs(s, d)))
    return b.select("page_id", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha"), "summary")


@query("s6_fallback", "WITH " + PARAGRAPHS + KEPT + """ SELECT d.doc_id AS page_id, sha256(CASE WHEN length(text) > 200 AND doc_id % 2 = 0 THEN text ELSE coalesce(body, '') END) AS body_sha,
  CASE WHEN length(text) > 200 AND doc_id % 2 = 0 THEN 'a' WHEN body IS NOT NULL THEN 'b' ELSE 'none' END AS extractor FROM documents d LEFT JOIN b ON page_id = doc_id""")
def s6(s, d):
    a = B.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"), F.lit("").alias("summary"), (F.col("doc_id") % 2 == 0).alias("ok"))
    return R.fallback(a, R.bodies(R.paragraphs_kept(_paragraphs(s, d)))).select("page_id", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha"), "extractor")


# pages have no images of their own: tags made from the id stand before each page, whose article begins with pictures of its own
PICTURED = r"""concat(CASE page_id % 6 WHEN 0 THEN concat('<meta property="og:image" content=" https://i.example.com/og', page_id, ' "><meta name="twitter:image" content="x">')
  WHEN 1 THEN concat('<meta property="og:image" content=""><meta content="https://i.example.com/tw', page_id, '" name="twitter:image">') ELSE '' END,
  '<aside><img src="https://i.example.com/side.png"></aside>', CASE page_id % 6 WHEN 2 THEN concat('<article><p><img class="a" src="https://i.example.com/', page_id, '.png"></p></article>')
  WHEN 3 THEN concat('<article><img src="https://i.example.com/Logo.png"><img src="https://i.example.com/b.png"></article>')
  WHEN 4 THEN concat('<div class="post-content"><img src="/relative.png"></div><article><img src="https://i.example.com/art', page_id, '.png"></article>') ELSE '' END, html)"""


@query("s7_image", r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('https://i.example.com/og', page_id) WHEN 1 THEN concat('https://i.example.com/tw', page_id)
  WHEN 2 THEN concat('https://i.example.com/', page_id, '.png') WHEN 4 THEN concat('https://i.example.com/art', page_id, '.png') ELSE '' END AS image_url FROM pages""")
def s7(s, d):
    pages = B.table(s, d, "pages").select("page_id", F.expr(PICTURED).alias("html"))
    return R.image_urls(pages, html.pictures(pages))


@query("s8_crawl", BASE + """, l AS (SELECT source AS portal, id AS seq, concat('https://e.com/', id % 700) AS url, title, CASE (id % 2) WHEN 0 THEN 'rss' ELSE 'html' END AS kind FROM art),
 rss AS (SELECT * FROM l WHERE kind = 'rss'), n AS (SELECT portal, count(*) AS n FROM rss GROUP BY 1),
 both_ AS (SELECT *, 0 AS part FROM rss UNION ALL SELECT l.*, 1 FROM l LEFT JOIN n USING (portal) WHERE kind = 'html' AND (portal < 'src15' OR coalesce(n, 0) < 5))
 SELECT portal, url, title, seq FROM both_ QUALIFY row_number() OVER (PARTITION BY portal, url ORDER BY part, seq) = 1""")
def s8(s, d):
    rows = B.articles(s, d).select(F.col("source").alias("portal"), F.col("id").alias("seq"), F.concat(F.lit("https://e.com/"), (F.col("id") % 700).cast("string")).alias("url"), "title", F.when(F.col("source") < "src15", "html").otherwise("hybrid").alias("method"))
    return R.listing(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).select("portal", "url", "title", "seq")


PORTALS = """WITH n AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL)),
p AS (SELECT id, name, concat(name, '.example.com') AS domain, CASE WHEN id % 3 = 0 THEN 'rss' ELSE 'hybrid' END AS method FROM n) """


@query("s11_portals", PORTALS + """SELECT id, name, domain, method, CASE WHEN method = 'rss' THEN concat('https://rss.', domain, '/') ELSE concat('https://www.', domain, '/') END AS base_url,
  1::BIGINT AS n_rss, CASE WHEN method = 'rss' THEN 0 ELSE 1 END::BIGINT AS n_html, id % 4 <> 0 AS active FROM p""")
def s11(s, d):
    p = B.portals(s, d)
    return R.portal_status(p, p.where("id % 4 = 0"))


@query("f7_portal_selection", PORTALS + "SELECT id, name FROM p WHERE id % 4 <> 0 AND name IN ('src0', 'src1', 'src2', 'src3')")
def f7(s, d):
    p = B.portals(s, d)
    return R.select_portals(p, p.where("id % 4 = 0"), ["src0", "src1", "src2", "src3"]).select(F.col("id").cast("long").alias("id"), "name")


@query("k8_portal_toggle", PORTALS + "SELECT domain, CASE WHEN domain = 'src1.example.com' THEN false ELSE true END AS active FROM p UNION ALL SELECT 'new.example.com', true")
def k8(s, d):
    stored = B.portals(s, d).select("domain", F.lit(True).alias("active"))
    return R.toggled(R.toggled(stored, "src1.example.com", False), "new.example.com", True)


# --- filters and search ----------------------------------------------------------------------------------------------
@query("f1_equality", BASE + "SELECT id, title FROM art WHERE source = 'src1' AND category = 'en'")
def f1(s, d):
    return R.equals(R.equals(R.equals(B.articles(s, d), "source", "src1"), "category", "en"), "title", "").select("id", "title")


@query("f2_contains", BASE + "SELECT id, title FROM art WHERE title ILIKE '%The_e%'")
def f2(s, d):
    return R.contains(B.articles(s, d), "title", "The_e").select("id", "title")


@query("f3_nonempty", BASE + "SELECT id FROM art WHERE body IS NOT NULL AND body <> ''")
def f3(s, d):
    return B.articles(s, d).where(X.nonempty(F.col("body"))).select("id")


@query("f4_not_like", BASE + "SELECT id, pseudonym FROM usr WHERE pseudonym NOT LIKE 'user_1%'")
def f4(s, d):
    return B.users(s, d).where(~F.col("pseudonym").like("user_1%"))


@query("f5_in_list", BASE + "SELECT id, title, source FROM art WHERE id IN (3, 5, 7, 11, 10000000)")
def f5(s, d):
    wanted = s.createDataFrame([(3,), (5,), (7,), (11,), (10000000,)], "id long")
    return B.articles(s, d).join(F.broadcast(wanted), "id", "left_semi").select("id", "title", "source")


@query("f6_category_or_title", BASE + "SELECT id FROM art WHERE contains(lower(category), 'fr') OR contains(lower(title), 'fr')")
def f6(s, d):
    return R.category_or_title(B.articles(s, d), "fr").select("id")


RAW = """, raw AS (SELECT id AS seq, CASE WHEN id % 17 = 0 THEN '  ' ELSE title END AS title, CASE WHEN id % 19 = 0 THEN '' WHEN id % 23 = 0 THEN 'ftp://x/' || id ELSE url END AS url, excerpt, source FROM art)"""


def _raw(s, d):
    n = F.col("id")
    return B.articles(s, d).select(n.alias("seq"), F.when(n % 17 == 0, "  ").otherwise(F.col("title")).alias("title"), F.when(n % 19 == 0, "").when(n % 23 == 0, F.concat(F.lit("ftp://x/"), n.cast("string"))).otherwise(F.col("url")).alias("url"), "excerpt", "source")


@query("f8_validity", BASE + RAW + r" SELECT seq, CASE WHEN regexp_replace(title, '^\s+|\s+$', '', 'g') = '' THEN 'judul kosong' WHEN url = '' THEN 'url kosong' WHEN NOT starts_with(url, 'http') THEN 'url tidak valid' END AS reason FROM raw")
def f8(s, d):
    return _raw(s, d).select("seq", dedup.validity(F.col("title"), F.col("url")).alias("reason"))


@query("f9_lookup", BASE + f"SELECT id, title, source, category, {TS('parsed_at')} AS parsed_at FROM art WHERE id = 42")
def f9(s, d):
    return B.articles(s, d).where("id = 42").limit(1).select("id", "title", "source", "category", ts("parsed_at").alias("parsed_at"))


@query("f11_projection", BASE + f"SELECT id, title, left(excerpt, 200) AS excerpt, coalesce(nullif(category, ''), 'Umum') AS category, coalesce(image_url, '') AS image_url, {TS('parsed_at')} AS parsed_at FROM art")
def f11(s, d):
    return B.articles(s, d).select("id", "title", X.clip(F.col("excerpt"), 200).alias("excerpt"), X.label(F.col("category")).alias("category"), X.filled(F.col("image_url")).alias("image_url"), ts("parsed_at").alias("parsed_at"))


@query("m9_article_search", BASE + f"""SELECT id, title, source, {TS('parsed_at')} AS parsed_at, row_no FROM (SELECT *, row_number() OVER (ORDER BY parsed_at DESC, id) AS row_no FROM art
  WHERE category = 'en' AND title ILIKE '%on%' AND body <> '') WHERE row_no BETWEEN 16 AND 30""")
def m9(s, d):
    a = B.articles(s, d)
    found = R.contains(R.equals(R.equals(a, "source", None), "category", "en"), "title", "on").where(X.nonempty(F.col("body")))
    return R.page(found, R.newest("parsed_at", "id"), 2, 15, 100).select("id", "title", "source", ts("parsed_at").alias("parsed_at"), "row_no")


@query("w8_deep_page", BASE + "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, row_no FROM (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS row_no FROM ix) WHERE row_no BETWEEN 9991 AND 10000")
def w8_deep(s, d):
    """Page 1,000 of all events."""
    found = R.newest_page(B.interactions(s, d).select("id", "created_at"), "created_at", "id", 1000, 10, 200, shallow=1000)
    return found.select("id", ts("created_at").alias("created_at"), "row_no")


@query("t1_page_count", BASE + "SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM art WHERE source = 'src2'")
def t1(s, d):
    return R.page_count(R.equals(B.articles(s, d), "source", "src2"), 25)


@query("t2_newest_nulls_first", BASE + f"SELECT id, {TS('p')} AS parsed_at FROM (SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE parsed_at END AS p FROM art) ORDER BY p DESC NULLS FIRST, id LIMIT 40")
def t2(s, d):
    a = B.articles(s, d).withColumn("parsed_at", F.when(F.col("id") % 50 != 0, F.col("parsed_at")))
    return a.orderBy(*R.newest("parsed_at", "id")).limit(40).select("id", ts("parsed_at").alias("parsed_at"))


@query("t3_latest_runs", BASE + f"SELECT id, source, {TS('parsed_at')} AS started_at FROM art ORDER BY parsed_at DESC, id LIMIT 10")
def t3(s, d):
    return B.articles(s, d).orderBy(*R.newest("parsed_at", "id")).limit(10).select("id", "source", ts("parsed_at").alias("started_at"))


@query("t7_first_per_source", BASE + "SELECT source, id FROM art QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 20")
def t7(s, d):
    return B.articles(s, d).withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where("_r <= 20").select("source", "id")


@query("t8_shuffled_sidebar", BASE + "SELECT id, title FROM art ORDER BY parsed_at DESC, id LIMIT 10")  # in any order
def t8(s, d):
    return B.articles(s, d).orderBy(*R.newest("parsed_at", "id")).limit(10).orderBy(F.rand(7)).select("id", "title")


@query("w8_row_numbers", BASE + "SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS row_no FROM ix ORDER BY row_no LIMIT 50 OFFSET 100")
def w8(s, d):
    return R.page(B.interactions(s, d).select("id", "created_at"), R.newest("created_at", "id"), 3, 50, 200).select("id", "row_no")


# --- joins and counts ------------------------------------------------------------------------------------------------
@query("j1_three_way", BASE + "SELECT ix.id, pseudonym, title, event_type FROM ix JOIN usr ON usr.id = user_id JOIN art ON art.id = article_id")
def j1(s, d):
    return R.joined(B.interactions(s, d), B.articles(s, d), B.users(s, d)).select("id", "pseudonym", "title", "event_type")


@query("m8_interactions_list", BASE + f"""SELECT ix.id, pseudonym, title, source, event_type, {TS('created_at')} AS created_at FROM ix JOIN usr ON usr.id = user_id JOIN art ON art.id = article_id
  WHERE pseudonym ILIKE '%user_1%' AND event_type = 'click' ORDER BY ix.created_at DESC, ix.id LIMIT 50""")
def m8(s, d):
    rows = R.equals(R.contains(R.joined(B.interactions(s, d), B.articles(s, d), B.users(s, d)), "pseudonym", "user_1"), "event_type", "click")
    return rows.orderBy(*R.newest("created_at", "id")).limit(50).select("id", "pseudonym", "title", "source", "event_type", ts("created_at").alias("created_at"))


@query("a1_table_counts", BASE + "SELECT (SELECT count(*) FROM art) AS articles, (SELECT count(*) FROM usr) AS users, (SELECT count(*) FROM ix) AS interactions, (SELECT count(DISTINCT source) FROM art) AS portals")
def a1(s, d):
    one = [B.articles(s, d).agg(F.count("*").alias("articles"), F.countDistinct("source").alias("portals")), B.users(s, d).agg(F.count("*").alias("users")), B.interactions(s, d).agg(F.count("*").alias("interactions"))]
    a, b, c = (x.withColumn("_", F.lit(1)) for x in one)
    return a.join(b, "_").join(c, "_").drop("_")


@query("a2_event_counts", BASE + "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'rec_click') AS rec_click, count(*) FILTER (event_type = 'read') AS read, count(*) FILTER (event_type = 'share') AS share FROM ix")
def a2(s, d):
    return B.interactions(s, d).agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("click", "rec_click", "read", "share")])


@query("a3_by_source", BASE + "SELECT source, count(*) AS n FROM art GROUP BY 1")
def a3(s, d):
    return B.articles(s, d).groupBy("source").agg(F.count("*").alias("n"))


RAWCAT = "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN '' ELSE category END"


@query("a4_by_category", BASE + f"SELECT coalesce(nullif(c, ''), 'Umum') AS category, n FROM (SELECT {RAWCAT} AS c, count(*) AS n FROM art GROUP BY 1)")
def a4(s, d):
    raw = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, "").otherwise(F.col("category"))
    return B.articles(s, d).select(raw.alias("c")).groupBy("c").agg(F.count("*").alias("n")).select(X.label(F.col("c")).alias("category"), "n")


@query("a5_by_event", BASE + "SELECT event_type, count(*) AS n FROM ix GROUP BY 1")
def a5(s, d):
    return B.interactions(s, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a6_top_articles", BASE + "SELECT article_id, title, source, category, count(*) AS n FROM ix JOIN art ON art.id = article_id GROUP BY ALL ORDER BY n DESC, article_id LIMIT 10")
def a6(s, d):
    return R.top_by_count(R.joined(B.interactions(s, d), B.articles(s, d)), ["article_id", "title", "source", "category"], "n", 10, ["article_id"])


@query("a7_top_users", BASE + "SELECT pseudonym, count(*) AS n FROM ix JOIN usr ON usr.id = user_id GROUP BY 1 ORDER BY n DESC, pseudonym LIMIT 10")
def a7(s, d):
    return R.top_by_count(B.interactions(s, d).join(B.users(s, d).withColumnRenamed("id", "user_id"), "user_id"), ["pseudonym"], "n", 10, ["pseudonym"])


@query("m11_portal_clicks", BASE + "SELECT coalesce(nullif(source, ''), '-') AS portal, count(*) AS click_count FROM ix JOIN art ON art.id = article_id GROUP BY source")
def a8(s, d):
    return R.joined(B.interactions(s, d), B.articles(s, d)).groupBy("source").agg(F.count("*").alias("click_count")).select(X.filled(F.col("source"), "-").alias("portal"), "click_count")


@query("m11_article_clicks", BASE + "SELECT article_id AS id, title, source, category, image_url, count(*) AS click_count FROM ix JOIN art ON art.id = article_id GROUP BY ALL ORDER BY click_count DESC, article_id LIMIT 20")
def a9(s, d):
    return R.top_by_count(R.joined(B.interactions(s, d), B.articles(s, d)), ["article_id", "title", "source", "category", "image_url"], "click_count", 20, ["article_id"]).withColumnRenamed("article_id", "id")


@query("a10_top_recommended", BASE + "SELECT article_id AS id, title, source, category, count(*) AS rec_clicks FROM ix JOIN art ON art.id = article_id WHERE event_type = 'rec_click' GROUP BY ALL ORDER BY rec_clicks DESC, article_id LIMIT 10")
def a10(s, d):
    return R.top_by_count(R.joined(B.interactions(s, d).where("event_type = 'rec_click'"), B.articles(s, d)), ["article_id", "title", "source", "category"], "rec_clicks", 10, ["article_id"]).withColumnRenamed("article_id", "id")


@query("m12_recommendation_ctr", BASE + """, c AS (SELECT count(*) FILTER (event_type = 'click') AS total_organic_clicks, count(*) FILTER (event_type = 'rec_click') AS total_rec_clicks, count(*) FILTER (event_type = 'read') AS total_read,
  count(*) FILTER (event_type = 'share') AS total_share, count(DISTINCT user_id) FILTER (event_type = 'rec_click') AS users_clicked_rec, count(DISTINCT user_id) AS users_total FROM ix)
  SELECT *, CASE WHEN total_organic_clicks + total_rec_clicks > 0 THEN CAST(printf('%.2f', total_rec_clicks / (total_organic_clicks + total_rec_clicks) * 100) AS DOUBLE) ELSE 0 END AS ctr_recommendation_pct,
  CASE WHEN users_total > 0 THEN CAST(printf('%.2f', users_clicked_rec / users_total * 100) AS DOUBLE) ELSE 0 END AS adoption_rate_pct FROM c""")
def m12(s, d):
    return R.recommendation_ctr(B.interactions(s, d))


@query("m7_summary", BASE + """SELECT 'articles' AS kind, 'all' AS label, count(*) AS n FROM art UNION ALL SELECT 'interactions', 'all', count(*) FROM ix
  UNION ALL SELECT 'event', event_type, count(*) FROM ix GROUP BY 2 UNION ALL SELECT 'category', coalesce(nullif(category, ''), 'Umum'), count(*) FROM ix JOIN art ON art.id = article_id GROUP BY category""")
def m7(s, d):
    ix, a = B.interactions(s, d), B.articles(s, d)

    def total(df, kind):
        return df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("all").alias("label"), "n")

    events = ix.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit("event").alias("kind"), F.col("event_type").alias("label"), "n")
    kinds = R.joined(ix, a).groupBy("category").agg(F.count("*").alias("n")).select(F.lit("category").alias("kind"), X.label(F.col("category")).alias("label"), "n")
    return total(a, "articles").unionByName(total(ix, "interactions")).unionByName(events).unionByName(kinds)


@query("m10_site_stats", BASE + "SELECT 'source' AS kind, source AS label, count(*) AS n FROM art GROUP BY 2 UNION ALL SELECT 'category', coalesce(nullif(category, ''), 'Umum'), count(*) FROM art GROUP BY category")
def m10(s, d):
    sets = B.articles(s, d).groupingSets([["source"], ["category"]], "source", "category").agg(F.count("*").alias("n"), F.grouping("source").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "source").otherwise("category").alias("kind"), F.when(F.col("g") == 0, F.col("source")).otherwise(X.label(F.col("category"))).alias("label"), "n")


PROFILE = BASE + ", tl AS (SELECT ix.id AS event_id, created_at, article_id, title, source, coalesce(nullif(category, ''), 'Umum') AS category, event_type FROM ix JOIN art ON art.id = article_id WHERE user_id = 3) "


@query("m13_user_timeline", PROFILE + f"SELECT event_id, {TS('created_at')} AS created_at, article_id, title, source, category, event_type FROM tl")
def m13(s, d):
    return R.user_timeline(B.interactions(s, d), B.articles(s, d), 3).withColumn("created_at", ts("created_at"))


@query("a13_user_categories", PROFILE + "SELECT category, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(created_at), arg_min(event_id, (created_at, event_id))) AS rank FROM tl GROUP BY 1")
def a13(s, d):
    return R.user_categories(R.user_timeline(B.interactions(s, d), B.articles(s, d), 3))


@query("a14_user_hours", PROFILE + "SELECT h AS hour, count(event_id) AS count FROM range(24) r(h) LEFT JOIN tl ON hour(created_at) = h GROUP BY 1")
def a14(s, d):
    return R.user_hours(R.user_timeline(B.interactions(s, d), B.articles(s, d), 3))


@query("a15_first_last", BASE + f"SELECT user_id, {TS('min(created_at)')} AS first_at, {TS('max(created_at)')} AS last_at, count(*) AS n FROM ix GROUP BY 1")
def a15(s, d):
    g = B.interactions(s, d).groupBy("user_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count("*").alias("n"))
    return g.select("user_id", ts("first_at").alias("first_at"), ts("last_at").alias("last_at"), "n")


@query("a25_basic_aggregates", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, bool_and(value >= 0) AS all_positive FROM events GROUP BY 1")
def a25(s, d):
    return B.table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@query("m15_categories", "SELECT unnest(range(14)) AS pos, unnest(['Semua', " + ", ".join(f"'{c}'" for c in X.CATEGORIES) + "]) AS category")
def m15(s, d):
    return s.createDataFrame(list(enumerate([X.ALL_CATEGORIES, *X.CATEGORIES])), "pos long, category string")


@query("m15_category_counts", BASE + ", c AS (SELECT unnest(range(15)) AS pos, unnest(['Semua', " + ", ".join(f"'{c}'" for c in X.CATEGORIES) + ", 'Umum']) AS category), k AS (SELECT CASE lang WHEN 'en' THEN 'Internasional' WHEN 'de' THEN 'Teknologi' WHEN 'fr' THEN 'Olahraga' ELSE 'Umum' END AS category FROM documents) SELECT pos, category, CASE WHEN pos = 0 THEN (SELECT count(*) FROM k) ELSE (SELECT count(*) FROM k WHERE k.category = c.category) END AS n FROM c")
def m15_counts(s, d):
    """The categories that a reader may choose from, in order, with the articles of each; the first is all of them."""
    raw = F.when(F.col("lang") == "en", "world").when(F.col("lang") == "de", "gadget").when(F.col("lang") == "fr", "sepak bola")
    found = B.table(s, d, "documents").select(X.category(raw).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    every = found.groupBy(F.lit(X.ALL_CATEGORIES).alias("category")).agg(F.sum("n").alias("n"))
    listed = s.createDataFrame(list(enumerate([X.ALL_CATEGORIES, *X.CATEGORIES, X.NO_CATEGORY])), "pos long, category string")
    return listed.join(found.unionByName(every), "category", "left").select("pos", "category", F.coalesce("n", F.lit(0)).alias("n"))


# --- scalar functions ------------------------------------------------------------------------------------------------
TRACK = ", ".join(f"'{k}'" for k in X.TRACKING_KEYS)
CANON = rf"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
parts AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[^:]*://([^/?]*)', 1)), '^[w.]+', '') AS host,
  regexp_replace(regexp_extract(u, '^[^:]*://[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(u, '\?(.*)$', 1) AS q FROM u),
qs AS (SELECT *, list_sort(list_filter(list_transform(string_split(q, '&'), lambda p: {{'k': url_decode(split_part(p, '=', 1)), 'v': url_decode(substr(p, strpos(p, '=') + 1))}}),
  lambda x: x.v <> '' AND lower(x.k) NOT IN ({TRACK}))) AS ps FROM parts),
canon AS (SELECT page_id, concat(scheme, '://', host, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(ps) > 0 AND q <> '' THEN concat('?', array_to_string(list_transform(ps, lambda x: concat(url_encode(x.k), '=', url_encode(x.v))), '&')) ELSE '' END) AS url FROM qs)
"""


@query("x1_canonical_url", CANON + "SELECT page_id, url FROM canon")
def x1(s, d):
    return B.table(s, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


@query("x2_url_hash", CANON + "SELECT page_id, sha256(url) AS url_hash FROM canon")
def x2(s, d):
    return B.table(s, d, "pages").select("page_id", X.url_hash(F.col("url")).alias("url_hash"))


HASHES = BASE + r", h AS (SELECT id, source, sha256(concat(lower(title), '|', left(lower(regexp_replace(excerpt, '^\s+|\s+$', '', 'g')), 200))) AS content_hash FROM art)"


@query("x3_content_hash", HASHES + "SELECT id, content_hash FROM h")
def x3(s, d):
    return B.articles(s, d).select("id", X.content_hash(F.col("title"), F.col("excerpt")).alias("content_hash"))


PRINTS = BASE + r""", tk AS (SELECT id, [w for w in string_split_regex(regexp_replace(lower(concat(title, ' ', regexp_replace(excerpt, '^\s+|\s+$', '', 'g'))), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+') if w <> ''] AS ws FROM art),
tok AS (SELECT id, unnest(list_concat(ws, [concat(ws[i], ' ', ws[i + 1]) for i in range(1, len(ws))])[1:200]) AS t FROM tk),
hs AS (SELECT id, ('0x' || substr(md5(t), 17, 16))::UBIGINT AS h FROM tok),
votes AS (SELECT id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM hs, range(64) r(b) GROUP BY ALL),
fps AS (SELECT art.id, art.source, coalesce(fp, 0)::UBIGINT AS fp FROM art LEFT JOIN (SELECT id, sum(CASE WHEN v > 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END)::UBIGINT AS fp FROM votes GROUP BY 1) USING (id))
"""


def _prints(s, d):
    a = B.articles(s, d)
    return dedup.simhash(a, "id", F.concat_ws(" ", "title", X.strip(F.col("excerpt"))))


@query("x4_simhash", PRINTS + "SELECT id, lower(printf('%016x', fp)) AS simhash FROM fps")
def x4(s, d):
    return _prints(s, d).select("id", X.hex64(F.col("fp")).alias("simhash"))


# signs whose normal form has capitals: texts are lower-cased first, so these stay
SIGNS = ("™", "25℃", "№ 5", "ﬃ Ａ")


@query("x4_signs", PRINTS.replace("lower(concat(title", "concat('harga ', ['TM', '25°C', 'No 5', 'ffi a'][id % 4 + 1], ' ', lower(concat(title").replace("'g'))), '[^", "'g')))), '[^") + "SELECT id, lower(printf('%016x', fp)) AS simhash FROM fps")
def x4_signs(s, d):
    a = B.articles(s, d)
    sign = F.element_at(F.array(*[F.lit(x) for x in SIGNS]), (F.col("id") % 4 + 1).cast("int"))
    return dedup.simhash(a, "id", F.concat_ws(" ", F.lit("Harga"), sign, "title", X.strip(F.col("excerpt")))).select("id", X.hex64(F.col("fp")).alias("simhash"))


@query("x5_hamming", PRINTS + "SELECT id, CAST(bit_count(xor(fp::HUGEINT, 1311768467463790320)) AS BIGINT) AS distance FROM fps")
def x5(s, d):
    return _prints(s, d).select("id", X.hamming(F.col("fp"), F.lit(1311768467463790320)).cast("long").alias("distance"))


CASES = " ".join(f"WHEN regexp_matches(lower(raw), '{'|'.join(w)}') THEN '{k}'" for k, w in X.CATEGORIES.items())


@query("x6_category", f"""SELECT raw, n, CASE WHEN raw = '' THEN 'Umum' {CASES} ELSE array_to_string(list_transform(string_split_regex(lower(raw), ''), lambda c, i: CASE WHEN i = 1 OR NOT regexp_matches(lower(raw)[i - 1], '\\p{{L}}') THEN upper(c) ELSE c END), '') END AS category
  FROM (SELECT regexp_extract(lower(text), '[a-z]+[ -][a-z]+') AS raw, count(*) AS n FROM documents GROUP BY 1)""")
def x6(s, d):
    raw = B.table(s, d, "documents").select(F.regexp_extract(F.lower("text"), "[a-z]+[ -][a-z]+", 0).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return raw.select("raw", "n", X.category(F.col("raw")).alias("category"))


@query("x7_clean_text", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM documents")
def x7(s, d):
    return B.table(s, d, "documents").select("doc_id", F.sha2(X.clean_text(F.col("text")).cast("binary"), 256).alias("clean"))


@query("x8_first_date", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'p' END, CASE WHEN event_id % 3 = 1 THEN 'u' END, 'c') AS date FROM events")
def x8(s, d):
    n = F.col("event_id") % 3
    return B.table(s, d, "events").select("event_id", X.first_date(F.when(n == 0, "p").otherwise(""), F.when(n == 1, "u"), F.lit("c")).alias("date"))


# an exact tie at two places for odd ids, and decimal ties at four places that binary numbers miss on either side
@query("x12_rounding", "SELECT event_id, CAST(25 * event_id // 2 + CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END AS DOUBLE) / 100 AS eighths, CAST(printf('%.4f', (2 * event_id + 1) / 20000::DOUBLE) AS DOUBLE) AS places FROM events")
def x12(s, d):
    n = F.col("event_id")
    return B.table(s, d, "events").select("event_id", rounded(n / F.lit(8.0), 2).alias("eighths"), rounded((2 * n + 1) / F.lit(20000.0), 4).alias("places"))


@query("x9_decay", BASE + "SELECT id, round(exp(-0.1::DOUBLE * greatest(0::DOUBLE, (epoch_us(TIMESTAMP '2024-01-15') - epoch_us(created_at)) / 86400000000::DOUBLE)), 6) AS w FROM ix")
def x9(s, d):
    return B.interactions(s, d).select("id", F.round(decay_weight(F.col("created_at"), F.lit("2024-01-15 00:00:00").cast("timestamp"), 0.1), 6).alias("w"))


@query("x10_event_weight", BASE + "SELECT id, CASE event_type WHEN 'click' THEN 5.0::DOUBLE WHEN 'read' THEN 2.0::DOUBLE WHEN 'share' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM ix")
def x10(s, d):
    return B.interactions(s, d).select("id", event_weight(F.col("event_type"), Params(click=5.0)).alias("w"))


@query("x13_coalesce", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, ''), props) AS v FROM events")
def x13(s, d):
    return B.table(s, d, "events").select("event_id", X.filled(F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")), F.col("props")).alias("v"))


@query("x14_truncate", "SELECT doc_id, left(text, 60) AS short, concat(left(text, 250), CASE WHEN length(text) > 250 THEN '...' ELSE '' END) AS long FROM documents")
def x14(s, d):
    return B.table(s, d, "documents").select("doc_id", X.clip(F.col("text"), 60).alias("short"), X.clip(F.col("text"), 250, dots=True).alias("long"))


@query("x16_host", "SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host FROM pages")
def x16(s, d):
    return B.table(s, d, "pages").select("page_id", X.host(F.col("url")).alias("host"))


@query("x16_resolve", r"""SELECT page_id, concat(regexp_extract(url, '^[^/]*//[^/?#]*'), regexp_replace(regexp_replace(p, '/[^/]*$', ''), '/?[^/]*$', ''), '/a?b=1') AS url
  FROM (SELECT page_id, url, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def x16b(s, d):
    return B.table(s, d, "pages").select("page_id", X.resolved(F.col("url"), F.lit("../a?b=1")).alias("url"))


@query("x17_hour", BASE + "SELECT id, hour(created_at)::BIGINT AS hour FROM ix")
def x17(s, d):
    return B.interactions(s, d).select("id", F.hour("created_at").cast("long").alias("hour"))


@query("x18_countdown", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS t FROM (SELECT event_id, greatest(event_id * 37 - 5000, 0) AS s FROM events)")
def x18(s, d):
    return B.table(s, d, "events").select("event_id", X.countdown(F.col("event_id") * 37 - 5000).alias("t"))


@query("x19_ago", "SELECT event_id, CASE WHEN event_id < 60 THEN concat(event_id, ' menit lalu') WHEN event_id < 1440 THEN concat(event_id // 60, ' jam lalu') ELSE concat(event_id // 1440, ' hari lalu') END AS t FROM events")
def x19(s, d):
    return B.table(s, d, "events").select("event_id", X.ago(F.col("event_id")).alias("t"))


@query("x20_code", BASE + "SELECT id, upper(substr(replace(pseudonym, 'user_', ''), 1, 6)) AS code FROM usr")
def x20(s, d):
    return B.users(s, d).select("id", X.participation_code(F.col("pseudonym"), "user_").alias("code"))


@query("x21_pseudonym", BASE + "SELECT id, substr(sha256(concat('seed', id)), 1, 16) AS p FROM usr")
def x21(s, d):
    return B.users(s, d).select("id", X.pseudonym(F.concat(F.lit("seed"), F.col("id").cast("string"))).alias("p"))


@query("x24_html_text", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def x24(s, d):
    return B.table(s, d, "pages").select("page_id", X.tags_removed(F.col("html")).alias("text"))


@query("x25_duration", "SELECT event_id, CASE WHEN event_id < 1000 THEN printf('%.2f ms', event_id + 0.3::DOUBLE) ELSE printf('%.2f s', (event_id + 0.3::DOUBLE) / 1000) END AS t FROM events")
def x25(s, d):
    return B.table(s, d, "events").select("event_id", X.duration(F.col("event_id") + F.lit(0.3)).alias("t"))


# --- de-duplication --------------------------------------------------------------------------------------------------
@query("j9_exact_duplicates", HASHES + "SELECT id, row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1 AS is_first FROM h")
def j9(s, d):
    h = B.articles(s, d).select("id", X.content_hash(F.col("title"), F.col("excerpt")).alias("h"))
    return dedup.exact_duplicates(h, "h", "id").select("id", "is_first")


@query("j13_near_pairs", PRINTS + "SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.fp, y.fp)::HUGEINT) AS BIGINT) AS distance FROM fps x JOIN fps y ON x.id < y.id AND bit_count(xor(x.fp, y.fp)::HUGEINT) <= 5")
def j13(s, d):
    return dedup.near_pairs(_prints(s, d))


@query("j13_near_classes", PRINTS + """SELECT x.id, min(y.id) FILTER (y.fp = x.fp) AS class_id, count(*) - 1 AS n_links FROM fps x JOIN fps y ON bit_count(xor(x.fp, y.fp)::HUGEINT) <= 5 GROUP BY x.id""")
def j13_classes(s, d):
    return dedup.near_classes(_prints(s, d))


TIDY = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
STATUS = (
    PRINTS.replace("WITH ix", "WITH RECURSIVE ix").replace(", tk AS", RAW + r", tk AS")
    .replace("concat(title, ' ', " + TIDY.format("excerpt") + ")", "concat(" + TIDY.format("title") + ", ' ', " + TIDY.format("excerpt") + ")")
    .replace("AS ws FROM art)", "AS ws FROM (SELECT seq AS id, title, excerpt FROM raw))")
    + r""", st AS MATERIALIZED (SELECT seq, r.source, fp, row_number() OVER (ORDER BY seq) AS n,
  CASE WHEN regexp_replace(title, '^\s+|\s+$', '', 'g') = '' THEN 'judul kosong' WHEN url = '' THEN 'url kosong' WHEN NOT starts_with(url, 'http') THEN 'url tidak valid' END AS reason, hash(url) AS uh,
  hash(concat(lower(regexp_replace(title, '^\s+|\s+$', '', 'g')), '|', left(lower(regexp_replace(excerpt, '^\s+|\s+$', '', 'g')), 200))) AS ch FROM raw r JOIN fps ON fps.id = seq),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS source, NULL::VARCHAR AS status, NULL::VARCHAR AS reason, []::UBIGINT[] AS us, []::UBIGINT[] AS cs, []::STRUCT(s VARCHAR, f UBIGINT)[] AS kept
  UNION ALL SELECT n, seq, source, status, reason, CASE WHEN status = 'new' THEN list_append(us, uh) ELSE us END, CASE WHEN status = 'new' THEN list_append(cs, ch) ELSE cs END,
    CASE WHEN status = 'new' THEN list_append(kept, {'s': source, 'f': fp}) ELSE kept END
  FROM (SELECT st.n, st.seq, st.source, st.reason, uh, ch, fp, us, cs, kept, CASE WHEN st.reason IS NOT NULL THEN 'invalid' WHEN list_contains(us, uh) OR list_contains(cs, ch) THEN 'duplicate'
    WHEN coalesce(list_bool_or(list_transform(list_filter(kept, lambda x: x.s = st.source)[-50:], lambda x: bit_count(xor(x.f, fp)::HUGEINT) <= 5)), false) THEN 'near_dup' ELSE 'new' END AS status
    FROM walk JOIN st ON st.n = walk.n + 1)),
z AS (SELECT seq, source, status, reason FROM walk WHERE n > 0)
"""
)


@query("m6_ingest", STATUS + " SELECT seq, status, reason FROM z")
def m6(s, d):
    return dedup.ingest(_raw(s, d))


@query("a16_status_counts", STATUS + " SELECT " + ", ".join(f"count(*) FILTER (status = '{n}') AS {n if n != 'new' else chr(34) + 'new' + chr(34)}" for n in ("new", "duplicate", "near_dup", "invalid", "error")) + " FROM z")
def a16(s, d):
    return dedup.status_counts(dedup.ingest(_raw(s, d)))


@query("k4_crawl_log", STATUS + """ SELECT source AS portal, count(*) AS found, count(*) FILTER (status = 'new') AS articles_new, count(*) FILTER (status IN ('duplicate', 'near_dup')) AS articles_dup
  FROM z GROUP BY 1""")
def k4(s, d):
    z = dedup.ingest(_raw(s, d)).join(_raw(s, d).select("seq", "source"), "seq")
    new, copies = (F.count(F.when(F.col("status").isin(*names), 1)) for names in (("new",), ("duplicate", "near_dup")))
    return z.groupBy(F.col("source").alias("portal")).agg(F.count("*").alias("found"), new.alias("articles_new"), copies.alias("articles_dup"))


@query("k1_article_insert", STATUS + r" SELECT seq, nullif(left(regexp_replace(excerpt, '^\s+|\s+$', '', 'g'), 500), '') AS excerpt, url FROM z JOIN raw USING (seq) WHERE status = 'new'")
def k1(s, d):
    new = dedup.ingest(_raw(s, d)).where("status = 'new'").select("seq")
    e = X.clip(X.strip(F.col("excerpt")), 500)
    return _raw(s, d).join(new, "seq").select("seq", F.when(e != "", e).alias("excerpt"), "url")


# --- recommendation --------------------------------------------------------------------------------------------------
def _model(s, d):
    m = cut(recommend.matrix(B.interactions(s, d), B.ASOF))  # both are read several times by what follows
    return m, cut(recommend.similarity(m))


@query("a17_user_item", MODEL + "SELECT user_id, article_id, round(w, 6) AS w FROM m")
def a17(s, d):
    return _model(s, d)[0].select("user_id", "article_id", F.round("w", 6).alias("w"))


@query("a18_norms", MODEL + "SELECT article_id, round(n, 6) AS norm FROM nrm")
def a18(s, d):
    return _model(s, d)[0].groupBy("article_id").agg(F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"))


@query("m1_similarity", MODEL + "SELECT item_a, item_b, round(sim, 6) AS sim FROM sims")
def m1(s, d):
    return _model(s, d)[1].withColumn("sim", F.round("sim", 6))


RECS = MODEL + """, sc AS (SELECT user_id, item_b AS cand, sum(sim * w) AS score FROM m JOIN sims ON item_a = article_id GROUP BY ALL),
 recs AS (SELECT sc.user_id, cand AS article_id, CAST(printf('%.4f', score) AS DOUBLE) AS score, row_number() OVER (PARTITION BY sc.user_id ORDER BY sc.score DESC, cand) AS rank FROM sc LEFT JOIN m ON m.user_id = sc.user_id AND m.article_id = cand WHERE m.user_id IS NULL QUALIFY rank <= 10) """


@query("m2_recommend_all", RECS + "SELECT user_id, article_id, score, rank FROM recs")
def m2(s, d):
    return recommend.recommend(*_model(s, d))


@query("m2_recommend_with_seen", MODEL + """, sc AS (SELECT user_id, item_b AS cand, sum(sim * w) AS score FROM m JOIN sims ON item_a = article_id GROUP BY ALL)
 SELECT user_id, cand AS article_id, CAST(printf('%.4f', score) AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY sc.score DESC, cand) AS rank FROM sc QUALIFY rank <= 10""")
def m2s(s, d):
    return recommend.recommend(*_model(s, d), exclude_seen=False)


COLD = MODEL + """, pop AS (SELECT article_id, sum(w) AS pop FROM m GROUP BY 1)
 SELECT u.user_id, pop.article_id, 0.01::DOUBLE AS score, row_number() OVER (PARTITION BY u.user_id ORDER BY pop DESC, pop.article_id) AS rank FROM (SELECT DISTINCT user_id FROM m) u CROSS JOIN pop
 LEFT JOIN m ON m.user_id = u.user_id AND m.article_id = pop.article_id WHERE m.user_id IS NULL QUALIFY rank <= 10"""


@query("t6_cold_start", COLD)
def t6(s, d):
    m, sims = _model(s, d)
    return recommend.recommend(m, sims.where("false"))


@query("m3_similar_items", MODEL + "SELECT s.item_b AS article_id, title, CAST(printf('%.4f', sim) AS DOUBLE) AS similarity FROM (SELECT * FROM sims WHERE item_a = 7 ORDER BY sim DESC, item_b LIMIT 5) s JOIN art ON art.id = item_b")
def m3(s, d):
    return recommend.similar_items(_model(s, d)[1], 7).join(B.articles(s, d).select(F.col("id").alias("article_id"), "title"), "article_id")


@query("a21_popularity", MODEL + "SELECT article_id, round(sum(w), 6) AS popularity FROM m GROUP BY 1")
def a21(s, d):
    return _model(s, d)[0].groupBy("article_id").agg(F.round(F.sum("w"), 6).alias("popularity"))


@query("m16_model_size", MODEL + "SELECT (SELECT count(DISTINCT user_id) FROM m) AS n_users, (SELECT count(DISTINCT article_id) FROM m) AS n_items, (SELECT count(*) FROM ix) AS n_interactions, (SELECT count(*) FROM sims) AS n_sim_pairs")
def m16(s, d):
    return recommend.model_size(B.interactions(s, d), *_model(s, d))


@query("s12_cache_decode", RECS + "SELECT user_id, rank, article_id, score FROM recs")
def s12(s, d):
    return recommend.decoded(recommend.cached(recommend.recommend(*_model(s, d))))


@query("m5_serve", RECS + """SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'cache' ELSE 'live' END AS origin, rank, article_id, title, source, score FROM recs JOIN art ON art.id = article_id WHERE user_id IN (3, 4, 10)
  UNION ALL SELECT 1000000007, 'unknown', NULL, NULL, NULL, NULL, NULL""")
def m5(s, d):
    m, sims = _model(s, d)
    cache = recommend.cached(recommend.recommend(m.where("user_id % 2 = 0"), sims))  # the others have no row yet
    asked = s.createDataFrame([(3,), (4,), (10,), (1_000_000_007,)], "user_id long")
    found = recommend.serve(asked, cache, m, sims, B.users(s, d))
    return found.join(B.articles(s, d).select(F.col("id").alias("article_id"), "title", "source"), "article_id", "left").select("user_id", "origin", "rank", "article_id", "title", "source", "score")


@query("w7_score_share", RECS + "SELECT user_id, article_id, CAST(round(score / greatest(max(score) OVER (PARTITION BY user_id), 0.0001::DOUBLE) * 100) AS BIGINT) AS share_pct FROM recs")
def w7(s, d):
    return recommend.score_share(recommend.recommend(*_model(s, d))).select("user_id", "article_id", "share_pct")


SPLIT = """, sp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) > greatest(1, floor(count(*) OVER (PARTITION BY user_id) * 0.8::DOUBLE)) AS is_test, count(*) OVER (PARTITION BY user_id) AS n FROM ix)"""


@query("w1_split", BASE + SPLIT + "SELECT user_id, count(*) AS n, count(*) FILTER (is_test) AS n_test FROM sp WHERE n >= 5 GROUP BY 1")
def w1(s, d):
    return recommend.split(B.interactions(s, d)).groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"))


@query("m4_evaluate", MODEL + SPLIT + """, tr AS (SELECT DISTINCT user_id, article_id FROM sp WHERE n >= 5 AND NOT is_test), te AS (SELECT DISTINCT user_id, article_id FROM sp WHERE n >= 5 AND is_test),
 nt AS (SELECT user_id, count(*) AS nt FROM te GROUP BY 1), um AS (SELECT m.* FROM m JOIN tr USING (user_id, article_id) WHERE user_id IN (SELECT user_id FROM nt)),
 sc AS (SELECT user_id, item_b AS cand, sum(sim * w) AS score FROM um JOIN sims ON item_a = article_id GROUP BY ALL),
 rk AS (SELECT sc.user_id, cand, row_number() OVER (PARTITION BY sc.user_id ORDER BY sc.score DESC, cand) AS rank FROM sc LEFT JOIN um ON um.user_id = sc.user_id AND um.article_id = cand WHERE um.user_id IS NULL QUALIFY rank <= 10),
 ht AS (SELECT rk.user_id, rank, CASE WHEN te.user_id IS NULL THEN 0 ELSE 1 END AS hit FROM rk LEFT JOIN te ON te.user_id = rk.user_id AND te.article_id = cand),
 pu AS (SELECT user_id, sum(hit) AS h, count(*) AS n, sum(ap) AS ap FROM (SELECT *, hit * sum(hit) OVER (PARTITION BY user_id ORDER BY rank) / rank AS ap FROM ht) GROUP BY 1)
 SELECT count(*) AS n_users_evaluated, CAST(printf('%.4f', avg(h / n)) AS DOUBLE) AS precision, CAST(printf('%.4f', avg(h / nt)) AS DOUBLE) AS recall, CAST(printf('%.4f', avg(ap / least(10, nt))) AS DOUBLE) AS map, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'insufficient_data' END AS status FROM pu JOIN nt USING (user_id)""")
def m4(s, d):
    return recommend.evaluate(B.interactions(s, d), B.ASOF)


extra.register(query, BASE, CASES, PRINTS, RECS, m2)
