"""Queries over feeds, pages, sinks, streams and the simulator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.operators import dedup, fetch, simulate
from tidefeed.operators import relational as R
from tidefeed.session import scratch
from tidefeed.sources import bind as B
from tidefeed.sources import feeds, html, sinks
from tidefeed.streaming import jobs

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TIDY = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def register(query, base: str, cases: str, prints: str, base_recs: str, recommendations) -> None:
    feed_sql = base + f""" SELECT source AS portal, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS seq, {TIDY.format('title')} AS title, url, left({TIDY.format('excerpt')}, 250) AS summary,
      CASE WHEN category = '' THEN 'Umum' {cases.replace('raw', 'category')} ELSE concat(upper(category[1]), lower(category[2:])) END AS category FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM art) WHERE r <= 20 AND {TIDY.format('title')} <> ''"""

    @query("s2_feeds", feed_sql)
    def s2(s, d):
        return feeds.scan(feeds.rendered(B.articles(s, d))).select("portal", "seq", "title", "url", "summary", "category")

    # the given pages have one structure: a menu, one article (a headline, then paragraphs, the first of which may stay open), a footer
    unescape = r"""regexp_replace(replace(replace(replace(replace(replace({}, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"""
    untagged = r"regexp_replace(replace({}, '<br>', ' '), '<[^>]*>', '', 'g')"
    page_sql = f"""pg AS (SELECT page_id, url, {unescape.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS site, {unescape.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1,
      regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS links FROM pages)"""
    whole_sql = f"""pp AS (SELECT page_id, i, {TIDY.format(unescape.format(untagged.format('x')))} AS t FROM (SELECT page_id, unnest(range(len(x) - 1)) AS i, unnest(x[2:]) AS x FROM (SELECT page_id, string_split(art, '<p>') AS x FROM pg))),
      wa AS (SELECT pg.page_id, {TIDY.format('site')} AS title, CASE WHEN max(length(t)) >= 25 THEN string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> '') ELSE '' END AS body FROM pg LEFT JOIN pp ON pp.page_id = pg.page_id GROUP BY ALL),
      ws AS (SELECT *, CASE WHEN length(s) > 300 THEN concat(left(s, 297), '...') ELSE s END AS summary FROM (SELECT *, array_to_string(list_filter(list_transform(regexp_extract_all(replace(body, chr(10) || chr(10), ' ') || ' ', '(?s)(.+?[.!?]|.+?$)(?:\\s+|$)', 1),
        lambda z: {TRIM.format('z')}), lambda z: length(z) > 30)[1:2], ' ') AS s FROM (SELECT page_id, title, coalesce(body, '') AS body FROM wa)))"""
    open_ = "CASE WHEN contains(art, '<p><b>') THEN position('<p><b>' IN art) ELSE length(art) + 1 END"
    kept_sql = f"""cp AS (SELECT page_id, 1000000 AS i, substr(art, {open_}) AS x FROM pg UNION ALL
        SELECT page_id, unnest(range(len(x) - 1)), unnest(x[2:]) FROM (SELECT page_id, string_split(substr(art, 1, {open_} - 1), '<p>') AS x FROM pg)),
      cs AS (SELECT page_id, i, array_to_string(list_transform(string_split(regexp_replace(x, '<[^>]*>', chr(1), 'g'), chr(1)), lambda z: {TRIM.format(unescape.format('z'))}), '') AS t FROM cp),
      cn AS (SELECT page_id, length(array_to_string(list_transform(string_split(regexp_replace(art, '<[^>]*>', chr(1), 'g'), chr(1)), lambda z: {TRIM.format(unescape.format('z'))}), '')) AS size FROM pg),
      ck AS (SELECT cs.* FROM cs JOIN cn USING (page_id) WHERE size > 200 AND length(t) >= 40 AND NOT regexp_matches(t, '(?i)^\\d{{1,2}}\\s+(jam|menit|detik|hari)\\s+yang\\s+lalu') AND NOT regexp_matches(t, '(?i)^(baca juga|lihat juga|artikel terkait)')
        QUALIFY row_number() OVER (PARTITION BY page_id, left(t, 60) ORDER BY i) = 1),
      cb AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS body, concat(left(first(t ORDER BY i), 250), CASE WHEN length(first(t ORDER BY i)) > 250 THEN '...' ELSE '' END) AS summary FROM ck GROUP BY 1)"""

    @query("s3_listing", f"WITH {page_sql} SELECT page_id, 0::BIGINT AS seq, title, url, '' AS date, '' AS raw_category, 'Umum' AS category FROM (SELECT page_id, url, {TIDY.format('h1')} AS title FROM pg) WHERE length(title) > 8")
    def s3(s, d):
        found = html.listings(B.table(s, d, "pages"), {"title": "h1, h2, h3"})
        return found.withColumn("category", X.category(F.col("raw_category")))

    @query("s4_page_text", f"WITH {page_sql}, {whole_sql} SELECT page_id, title, length(body) >= 100 AS ok, CAST(length(body) AS BIGINT) AS n_chars, summary FROM ws")
    def s4(s, d):
        a = html.articles(B.table(s, d, "pages"))
        return a.select("page_id", "title", "ok", F.char_length("body").cast("long").alias("n_chars"), X.summary(F.replace("body", F.lit("\n\n"), F.lit(" "))).alias("summary"))

    @query("s5_page_content", f"WITH {page_sql}, {kept_sql} SELECT page_id, body, summary FROM cb")
    def s5(s, d):
        return R.bodies(R.paragraphs_kept(html.paragraphs(B.table(s, d, "pages"))))

    @query("s6_page_fallback", f"""WITH {page_sql}, {whole_sql}, {kept_sql}, wx AS (SELECT page_id, body, CASE WHEN length(s) > 300 THEN concat(left(s, 297), '...') ELSE s END AS summary FROM (SELECT page_id, body,
        array_to_string(list_filter(list_transform(regexp_extract_all(body || ' ', '(?s)(.+?[.!?]|.+?$)(?:\\s+|$)', 1), lambda z: {TRIM.format('z')}), lambda z: length(z) > 30)[1:2], ' ') AS s FROM ws))
      SELECT page_id, CASE WHEN length(wx.body) > 200 THEN wx.body ELSE coalesce(cb.body, '') END AS body, CASE WHEN length(wx.body) > 200 THEN wx.summary ELSE coalesce(cb.summary, '') END AS summary,
        CASE WHEN length(wx.body) > 200 THEN 'a' WHEN cb.body IS NOT NULL THEN 'b' ELSE 'none' END AS extractor FROM wx LEFT JOIN cb USING (page_id)""")
    def s6(s, d):
        pages = B.table(s, d, "pages")
        a = html.articles(pages).withColumn("summary", X.summary(F.col("body")))
        return R.fallback(a, R.bodies(R.paragraphs_kept(html.paragraphs(pages))))

    host = "regexp_extract(url, '^[^/]*//[^/?#]*')"

    @query("s9_discovery", f"""WITH {page_sql}, n AS (SELECT page_id, url, site, unnest(links) AS l, unnest(range(len(links))) AS i FROM pg),
      f AS (SELECT page_id, url, concat({host}, {unescape.format('l')}) AS u, min(i) AS i FROM n WHERE l NOT IN ('', '#', '/') GROUP BY ALL HAVING concat({host}, {unescape.format('l')}) <> url),
      u AS (SELECT page_id, list(u ORDER BY i)[1:2] AS us FROM f GROUP BY 1)
      SELECT page_id, {TRIM.format("split_part(split_part(site, '|', 1), '-', 1)")} AS site, 'article' AS item, 'h1' AS title, 'time' AS date, 'span[class*=''label'']' AS category, 'a[href]' AS link, 'p' AS summary,
        array_to_string(list_concat([url], coalesce(us, [])), ' ') AS urls, 0::BIGINT AS preview FROM pg LEFT JOIN u USING (page_id)""")
    def s9(s, d):
        return html.discovery(B.table(s, d, "pages")).withColumn("urls", F.array_join("urls", " "))

    @query("k5_interactions_export", base + f"SELECT ix.id, pseudonym, article_id, title, source, coalesce(nullif(category, ''), 'Umum') AS category, event_type, {TS.format('created_at')} AS created_at FROM ix JOIN usr ON usr.id = user_id JOIN art ON art.id = article_id")
    def k5(s, d):
        return _through_csv(s, sinks.interactions_export(B.interactions(s, d), B.articles(s, d), B.users(s, d)))

    @query("k6_articles_export", base + f"SELECT id, title, source, coalesce(nullif(category, ''), 'Umum') AS category, url, {TS.format('parsed_at')} AS parsed_at, sha256(regexp_replace(url, 'www[.]', '')) AS url_hash, left(excerpt, 200) AS excerpt FROM art")
    def k6(s, d):
        return sinks.articles_export(B.articles(s, d))

    @query("k7_metrics", "SELECT event_type, 'n' AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'users', count(DISTINCT user_id)::DOUBLE FROM events GROUP BY 1")
    def k7(s, d):
        return sinks.metrics_long(B.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")), "event_type")

    batch = "b AS (SELECT concat('user_', user_id + 40) AS pseudonym, article_id * 15 AS article_id, CASE WHEN event_type = 'error' THEN 'zoom' ELSE event_type END AS event_type FROM ix)"

    def _batch(s, d):
        ix = B.interactions(s, d)
        return ix.select(F.concat(F.lit("user_"), (F.col("user_id") + 40).cast("string")).alias("pseudonym"), (F.col("article_id") * 15).alias("article_id"), F.when(F.col("event_type") == "error", "zoom").otherwise(F.col("event_type")).alias("event_type"))

    given = f"{batch}, nu AS (SELECT (SELECT max(id) FROM usr) + row_number() OVER (ORDER BY pseudonym) AS id, pseudonym FROM (SELECT DISTINCT pseudonym FROM b WHERE pseudonym NOT IN (SELECT pseudonym FROM usr)))"

    @query("k3_new_users", base + f", {given} SELECT id, pseudonym FROM nu")
    def k3a(s, d):
        return sinks.log_interactions(_batch(s, d), B.users(s, d), B.articles(s, d))[0]

    @query("k3_logged", base + f", {given} SELECT article_id, b.pseudonym, u.id AS user_id, CASE WHEN event_type IN ('click', 'read', 'share', 'rec_click') THEN event_type ELSE 'click' END AS event_type FROM b JOIN (FROM usr UNION ALL FROM nu) u ON u.pseudonym = b.pseudonym WHERE article_id IN (SELECT id FROM art)")
    def k3b(s, d):
        return sinks.log_interactions(_batch(s, d), B.users(s, d), B.articles(s, d))[1]

    @query("m14_simulator")
    def m14(s, d):
        return simulate.simulate(B.articles(s, d))

    @query("r1_event_windows", base + f"SELECT {TS.format('time_bucket(INTERVAL 1 day, created_at)')} AS start, event_type, count(*) AS n FROM ix GROUP BY ALL")
    def r1(s, d):
        """Events replayed from a folder, counted in tumbling windows; the state is flushed by writing complete results."""
        ix = B.table(s, d, "events")
        stream = B.as_interactions(s.readStream.schema(ix.schema).parquet(_folder(s, ix)))
        counted = jobs.event_windows(stream, width="1 day")
        return _finished(s, counted, "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")

    memory = prints.replace("WITH ix", "WITH RECURSIVE ix") + """, st AS MATERIALIZED (SELECT id AS seq, source, fp, row_number() OVER (ORDER BY id) AS n FROM fps),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS source, NULL::VARCHAR AS status, []::STRUCT(s VARCHAR, f UBIGINT)[] AS kept
  UNION ALL SELECT n, seq, source, status, CASE WHEN status = 'new' THEN list_append(kept, {'s': source, 'f': fp}) ELSE kept END
  FROM (SELECT st.n, st.seq, st.source, fp, kept, CASE WHEN coalesce(list_bool_or(list_transform(list_filter(kept, lambda x: x.s = st.source)[-50:],
    lambda x: bit_count(xor(x.f, fp)::HUGEINT) <= 5)), false) THEN 'near_dup' ELSE 'new' END AS status FROM walk JOIN st ON st.n = walk.n + 1))
SELECT source, seq, status FROM walk WHERE n > 0"""

    @query("r6_near_duplicate_memory", memory)
    def r6(s, d):
        a = B.articles(s, d)
        fp = dedup.simhash(a, "id", F.concat_ws(" ", "title", X.strip(F.col("excerpt")))).join(a.select("id", "source"), "id").select(F.col("id").alias("seq"), "source", "fp")
        stream = s.readStream.schema(fp.schema).parquet(_folder(s, fp))
        return _finished(s, jobs.near_duplicate_memory(stream), "append")

    # every host's file: addresses below /en and /de/2 are forbidden but for some; hosts of odd length have none
    robots = [(0, True, "/en/1"), (1, False, "/en"), (2, False, "/de/2"), (3, True, "/de/25"), (4, False, "")]
    listed = ", ".join(f"({o}, {str(a).lower()}, '{p}')" for o, a, p in robots)
    plan_sql = f"""WITH u AS (SELECT page_id, h, CASE WHEN p LIKE '/%' THEN p ELSE concat('/', p) END AS p FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS p FROM pages)),
      r(o, a, pre) AS (VALUES {listed}),
      v AS (SELECT page_id, coalesce(arg_min(a OR pre = '', o), true) AS by_first, coalesce(arg_min(a OR pre = '', 2 * -length(pre) + CASE WHEN a OR pre = '' THEN 0 ELSE 1 END), true) AS by_longest FROM u JOIN r ON starts_with(p, pre) WHERE length(h) % 2 = 0 GROUP BY 1),
      k AS (SELECT page_id, h, coalesce(by_first, true) AS by_first, coalesce(by_longest, true) AS by_longest FROM u LEFT JOIN v USING (page_id))
      SELECT page_id, by_longest, CAST(coalesce(sum(1200 + page_id % 3 * 400) OVER (PARTITION BY h ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM k WHERE by_first"""

    @query("s10_fetch_plan", plan_sql)
    def s10(s, d):
        """Addresses that may be fetched, by the first rule that holds, and when: at least 1.2 seconds apart for each host."""
        pages = B.table(s, d, "pages").select("page_id", "url")
        hosts = pages.select(X.host(F.col("url")).alias("host")).distinct().where("char_length(host) % 2 = 0")
        rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("allow"), F.lit(p).alias("path")) for o, a, p in robots])
        rules = hosts.select("host", F.explode(rows).alias("r")).select("host", "r.*")
        open_ = fetch.allowed(pages, rules).where("allowed").select("page_id", "url")
        longest = fetch.allowed(open_, rules, longest=True).withColumnRenamed("allowed", "by_longest")
        return fetch.start_times(longest, 1200 + F.col("page_id") % 3 * 400).select("page_id", "by_longest", F.col("start").alias("start_ms"))

    recs = base_recs + " SELECT user_id, rank, article_id, score FROM recs"

    @query("k2_replaced", recs)
    def k2(s, d):
        """Recommendations replaced three times: by some users', by all users', and by none, which leaves them alone."""
        rows = recommendations(s, d)
        path = scratch(s, "versions")
        for part in (rows.where("user_id % 2 = 0"), rows, rows.where("false")):
            sinks.replace_if_any(part, path)
        return sinks.Versions(s, path).read()

    made = """concat('<html><head><title>Site ', doc_id, ' | News</title></head><body><nav><a href="/s', doc_id, '">S</a><a href="#">x</a><a href="http://other.example.org/b">B</a></nav>',
      '<article class="item"><h2> Headline  number ', doc_id, '</h2><a href="/one/', doc_id, '">go</a><time> today </time><span class="x-label">Tekno</span></article>',
      '<article class="item"><h2>short</h2><a href="/two">go</a></article><article class="item"><h2>Another headline ', doc_id, '</h2><a href="https://x.example.com/', doc_id, '">go</a></article>',
      '<div class="article-body"><p>', repeat('A paragraph longer than forty characters. ', 8), doc_id, '</p><p>Baca juga: something else entirely that is long enough</p><div class="ads"><p>',
      repeat('An advertisement longer than forty. ', 3), '</p></div><p>tiny</p></div></body></html>')"""

    def _made(s, d):
        """Pages made from documents' ids. Ids are so few bytes that tasks by bytes would hold too many pages: they are dealt by their number."""
        ids = B.table(s, d, "documents").select("doc_id")
        return ids.repartition(ids.count() // 5000 + 1).select(F.col("doc_id").alias("page_id"), F.lit("http://h.example.com/x").alias("url"), F.expr(made).alias("html"))

    @query("s3_listing_made", """SELECT doc_id AS page_id, 0::BIGINT AS seq, concat('Headline number ', doc_id) AS title, concat('http://h.example.com/one/', doc_id) AS url, 'today' AS date, 'Teknologi' AS category FROM documents
      UNION ALL SELECT doc_id, 1, concat('Another headline ', doc_id), concat('https://x.example.com/', doc_id), '', 'Umum' FROM documents""")
    def s3m(s, d):
        return html.listings(_made(s, d)).select("page_id", "seq", "title", "url", "date", X.category(F.col("raw_category")).alias("category"))

    @query("s5_page_content_made", """SELECT doc_id AS page_id, concat(repeat('A paragraph longer than forty characters. ', 8), doc_id) AS body, concat(left(repeat('A paragraph longer than forty characters. ', 8), 250), '...') AS summary FROM documents""")
    def s5m(s, d):
        return R.bodies(R.paragraphs_kept(html.paragraphs(_made(s, d))))

    # pages of five shapes around a document's lines: divisions, table cells, paragraphs left open, sections with readers' comments, divisions as paragraphs
    first, second = "First come first served, says a reader of this page", "Nobody asked the readers, which is, as ever, a pity"
    link = '<a href="/a">A link whose text is far longer than twenty-five characters</a>'
    line = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

    def around(before: str, each: str, after: str) -> str:
        return f"concat('{before}', array_join(transform(split(coalesce(text, ''), '\n'), x -> concat('<{each}>', {line}, '{'' if each == 'p class=open' else '</' + each + '>'}')), ''), '{after}')"

    shapes = [
        around(f'<html><head><title>T</title></head><body><nav><ul><li>{link}</ul></nav><div class="main-menu"><p>A menu with a long text, which is not a link</p></div><div id="main"><div class="story">', "p", '</div></div><div id="comments"><p>A comment, longer, with commas, than most lines of an article, and so on</p></div></body></html>'),
        around(f"<table><tr><td>{link}<td>", "p", "</table>"),
        around('<div class="x">', "p class=open", f"</div><div>See {link}</div>"),
        around("<article><section><div>", "p", f"</div></section></article><ul><li><p>{first}</p><li><p>{second}</p></ul>"),
        around('<div class="t">', "div", f"</div><div>{link}</div>"),
    ]
    article_sql = f"""WITH l AS (SELECT doc_id, i, {TIDY.format('raw')} AS t FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
      g AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> '') AS body, coalesce(sum(CASE WHEN length(t) >= 25 THEN 1 + length(regexp_replace(t, '[^,]', '', 'g')) + least(length(t) / 100, 3) END), 0) AS score FROM l GROUP BY 1),
      b AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 5 = 3 AND score < 4 + length('{second}') / 100 THEN '{second}' WHEN score > 0 THEN body ELSE '' END AS body, CASE doc_id % 5 WHEN 0 THEN 'T' ELSE '' END AS title FROM g)
      SELECT page_id, title, sha256(body) AS body_sha, length(body) >= 100 AS ok FROM b"""

    @query("s4_article_made", article_sql)
    def s4m(s, d):
        n = F.pmod("doc_id", F.lit(len(shapes)))
        page = F.coalesce(*[F.when(n == i, F.expr(shape)) for i, shape in enumerate(shapes)])
        a = html.articles(B.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), page.alias("html")))
        return a.select("page_id", "title", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha"), "ok")

    # containers: one too short before the next, advertisements inside, an attribute first, none that counts
    other = "Another text altogether, which is long enough to be taken where the first one is too short for it. " * 3
    ad, caption = "An advertisement that is longer than forty characters, again and again. " * 3, "A caption that is longer than forty characters, too"
    content_shapes = [
        around('<div class="article-content">Too short</div><div class="post-content">', "p", f"</div><article><p>{other}</p></article>"),
        around("<article>", "p", f'<div class="ads-box"><p>{ad}</p></div><figure><figcaption>{caption}</figcaption></figure></article>'),
        around('<div itemprop="articleBody">', "p", f"</div><article><p>{other}</p></article>"),
        around('<div class="text">', "p", "</div>"),
    ]
    content_sql = rf"""WITH l AS (SELECT doc_id, i, {TRIM.format('raw')} AS t FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
      n AS (SELECT doc_id, sum(length(t)) AS size FROM l GROUP BY 1),
      c AS (SELECT doc_id, i, t FROM l JOIN n USING (doc_id) WHERE doc_id % 4 = 1 OR (doc_id % 4 IN (0, 2) AND size > 200)
        UNION ALL SELECT doc_id, 0, '{other.strip()}' FROM n WHERE doc_id % 4 IN (0, 2) AND size <= 200),
      k AS (SELECT * FROM c WHERE length(t) >= 40 AND NOT regexp_matches(t, '(?i)^\d{{1,2}}\s+(jam|menit|detik|hari)\s+yang\s+lalu') AND NOT regexp_matches(t, '(?i)^(baca juga|lihat juga|artikel terkait)')
        QUALIFY row_number() OVER (PARTITION BY doc_id, left(t, 60) ORDER BY i) = 1)
      SELECT doc_id AS page_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS body_sha, concat(left(first(t ORDER BY i), 250), CASE WHEN length(first(t ORDER BY i)) > 250 THEN '...' ELSE '' END) AS summary FROM k GROUP BY 1"""

    @query("s5_page_content_shapes", content_sql)
    def s5s(s, d):
        n = F.pmod("doc_id", F.lit(len(content_shapes)))
        page = F.coalesce(*[F.when(n == i, F.expr(shape)) for i, shape in enumerate(content_shapes)])
        b = R.bodies(R.paragraphs_kept(html.paragraphs(B.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), page.alias("html")))))
        return b.select("page_id", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha"), "summary")

    # listings: other items where a portal's own are missing, short titles and missing links, sections of pages left open
    listing_shapes = [
        """concat('<div class="news-item big"><h3>Headline of page ', doc_id, '</h3><a href="rel/', doc_id, '?x=1">go</a><span class="cat-label"> Olahraga </span></div><div class="news"><h3>No item at all</h3></div>')""",
        """concat('<article><h2>Tiny</h2><a href="/t">a</a></article><article><h2>A title without a link ', doc_id, '</h2></article><article><h2>Good headline ', doc_id, '</h2><a href="//cdn.example.org/', doc_id, '">b</a><time> 1 Mei </time></article>')""",
        """concat('<ul><li><article><h3>First &amp; foremost ', doc_id, '</h3><a name="x">no</a><a href="https://h.example.com/p#', doc_id, '">c</a><li><article><h2>ftp is no address</h2><a href="ftp://h.example.com/f">d</a></article></ul>')""",
    ]
    listing_sql = """SELECT doc_id AS page_id, 0::BIGINT AS seq, concat('Headline of page ', doc_id) AS title, concat('http://h.example.com/x/rel/', doc_id, '?x=1') AS url, '' AS date, 'Olahraga' AS category FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 0, concat('A title without a link ', doc_id), 'http://h.example.com/x/y', '', 'Umum' FROM documents WHERE doc_id % 3 = 1
      UNION ALL SELECT doc_id, 1, concat('Good headline ', doc_id), concat('http://cdn.example.org/', doc_id), '1 Mei', 'Umum' FROM documents WHERE doc_id % 3 = 1
      UNION ALL SELECT doc_id, 0, concat('First & foremost ', doc_id), concat('https://h.example.com/p#', doc_id), '', 'Umum' FROM documents WHERE doc_id % 3 = 2"""

    @query("s3_listing_shapes", listing_sql)
    def s3s(s, d):
        n = F.pmod("doc_id", F.lit(3))
        page = F.coalesce(*[F.when(n == i, F.expr(shape)) for i, shape in enumerate(listing_shapes)])
        pages = B.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("http://h.example.com/x/y").alias("url"), page.alias("html"))
        return html.listings(pages).select("page_id", "seq", "title", "url", "date", X.category(F.col("raw_category")).alias("category"))

    @query("s9_discovery_made", """SELECT doc_id AS page_id, concat('Site ', doc_id) AS site, 'article' AS item, 'h2' AS title, 'time' AS date, 'span[class*=''label'']' AS category, 'a[href]' AS link, 'p' AS summary,
      concat('http://h.example.com/x http://h.example.com/s', doc_id) AS urls, 2::BIGINT AS preview FROM documents""")
    def s9m(s, d):
        return html.discovery(_made(s, d)).withColumn("urls", F.array_join("urls", " "))

    @query("s9_address", """SELECT page_id, CASE WHEN contains(q, 'tempo') THEN 'https://www.tempo.co' WHEN contains(q, 'detik') THEN 'https://www.detik.com' WHEN contains(q, '.') THEN concat('https://', q) END AS url
      FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'koran tempo' WHEN 1 THEN 'detik' WHEN 2 THEN concat('p', page_id, '.example.com') ELSE 'nowhere' END AS q FROM pages)""")
    def s9a(s, d):
        n = F.col("page_id")
        asked = F.when(n % 4 == 0, "Koran TEMPO ").when(n % 4 == 1, "detik/").when(n % 4 == 2, F.concat(F.lit("p"), n.cast("string"), F.lit(".example.com/"))).otherwise("nowhere")
        return B.table(s, d, "pages").select("page_id", X.portal_address(asked).alias("url"))


def _finished(spark, stream, mode: str):
    """What a stream that has read all there is wrote."""
    path = scratch(spark, "out")
    jobs.into_folder(stream, path, scratch(spark, "state"), mode).awaitTermination()
    return jobs.from_folder(spark, path, stream.schema, mode)


def _folder(spark, df) -> str:
    path = scratch(spark, "stream")
    df.write.parquet(path)
    return path


def _through_csv(spark, df):
    """df written as CSV and read again."""
    path = scratch(spark, "csv")
    sinks.csv(df, path)
    return spark.read.schema(df.schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
