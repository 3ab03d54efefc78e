from tidefeed.sources import feeds, html

PAGE = """<html><head><title>My Site | News</title></head><body><nav><a href="/a">A</a><a href="#">x</a><a href="http://other/b">B</a></nav>
<article class="item big"><h2>A headline that is long</h2><a href="/one">go</a><time> today </time><span class="x-label">Tekno</span></article>
<article class="item"><h2>short</h2><a href="/two">go</a></article>
<div id="main" class="article-body"><p>{long}</p><p>Baca juga: something else entirely that is long enough</p><div class="ads"><p>{long}ads</p></div><p>tiny</p><p>{long}</p></div></body></html>"""
LONG = "A paragraph which is clearly longer than forty characters and is repeated so that the container is accepted. " * 3


def test_selectors():
    root = html.parse(PAGE)
    assert [n.tag for n in root.select("article.item h2")] == ["h2", "h2"]
    assert root.first("div#main").attrs["class"] == "article-body" and len(root.select("span[class*='label'], time")) == 2
    assert html.parse("<p>a<br>b</p></div>").first("p").text() == "ab" and html.parse(None).select("p") == []


def test_listing_and_discovery(spark):
    pages = spark.createDataFrame([(1, "http://h/x", PAGE), (2, "http://h/y", None), (3, "http://h/", "<div class='news-item'><h3>Ａnother headline</h3><a href='http://z/1'>x</a></div>")], "page_id long, url string, html string")
    rows = [tuple(r) for r in html.listings(pages).orderBy("page_id").collect()]
    assert rows == [(1, 0, "A headline that is long", "http://h/one", "today", "Tekno"), (3, 0, "Another headline", "http://z/1", "", "")]
    got = {r.page_id: r for r in html.discovery(pages).collect()}
    assert got[1].site == "My Site" and got[1].urls == ["http://h/x", "http://h/a"] and got[1].title == "h2" and got[1].item == "article"
    assert got[2].item == "article" and got[2].urls == ["http://h/y"] and got[2].preview == 0 and got[2].site == ""
    three = PAGE.replace("<div id", "<article><h2>One more headline</h2><a href='/z'>z</a><span class='date'>d</span></article><div id")
    found = html.discovery(spark.createDataFrame([(1, "http://h/x", three)], "page_id long, url string, html string")).first()
    assert (found.title, found.date, found.category, found.link, found.summary, found.preview) == ("h2", "time", "span[class*='label']", "a[href]", "p", 2)


def test_site_name_without_white_space(spark):
    titles = ["Site\n| News", "Site\t- News | x", " The \n Site\n\n-x", "Site\u00a0| x", "Site"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string")
    assert [r.site for r in html.discovery(pages).orderBy("page_id").collect()] == ["Site", "Site", "The \n Site", "Site", "Site"]


def test_content(spark):
    from tidefeed.operators import relational as R

    pages = spark.createDataFrame([(1, PAGE.replace("{long}", LONG)), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    kept = R.bodies(R.paragraphs_kept(html.paragraphs(pages))).collect()
    assert [r.page_id for r in kept] == [1] and kept[0].body == LONG.strip() and kept[0].summary == LONG[:250] + "..."
    whole = {r.page_id: r.ok for r in html.articles(pages).collect()}
    assert whole == {1: True, 2: False, 3: False}


def article(spark, html_text):
    return html.articles(spark.createDataFrame([(1, html_text)], "page_id long, html string")).first()


def test_article_among_menus_and_comments(spark):
    one, two = "The council met on Monday, and after a long debate, it agreed on the plan.", "Work begins in spring, the mayor said, if the weather allows it."
    menu = "".join(f"<li><a href='/{i}'>Section number {i} with quite a long name, really</a></li>" for i in range(30))
    talk = "".join(f"<li><p>Reader {i} thinks that this is, frankly, far too long.</p></li>" for i in range(3))
    want = f"{one}\n\nShort.\n\n{two}"
    body = f"<p>{one}<p>Short.<p>{two}"
    for shape in (
        f"<ul>{menu}</ul><div><div class=story>{body}</div></div><ul>{talk}</ul>",
        f"<div class='comments'>{talk * 9}</div><article><h1>H</h1>{body}<div class='share-bar'><p>Share this article with all your friends, now</p></div></article>",
        f"<table><tr><td><ul>{menu}</ul><td>{body}</table>",
        f"<div><div>{menu}</div><section><div>{one}</div><div>Short.</div><div>{two}</div></section></div>",
        f"<div><b><p>{one}</b><p>Short.<p>{two}<p><a href=/x>Read also: something else entirely, long enough</a></div><footer><p>{one}</p></footer>",
        f"</div></p><div>{body}<script>var t = '<p>';</script><!-- <p>{one}</p> -->",
    ):
        got = article(spark, "<title> A  title </title>" + shape)
        assert got.body == want and got.ok and got.title == "A title", shape


def test_article_of_odd_pages(spark):
    for text in (None, "", "<p>", "plain text only", "<ul><li><a href=x>a link that is longer than twenty-five characters</a></ul>"):
        got = article(spark, text)
        assert got.ok is False and len(got.body) < 100
    deep = "<div>" * 3000 + "<p>A paragraph, deep down below, that is found all the same, even there.</p>"
    assert article(spark, deep).body.startswith("A paragraph, deep")
    tie = "".join(f"<div><p>{w} paragraph of the very same length and score.</p></div>" for w in ("One", "Two"))
    assert article(spark, f"<main>{tie}</main>").body.startswith("One") and article(spark, "<br><p>x<br>y</p>").body == ""


def test_feeds(spark):
    rss = "<rss><channel>" + "".join(f"<item><title>T {i}</title><link>http://x/{i}</link><pubDate>d{i}</pubDate><category>Bola</category><description>&lt;b&gt;s&lt;/b&gt;  x</description></item>" for i in range(25)) + "</channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://y/1"/><updated>u</updated></entry><entry><title></title><link href="http://y/2"/></entry><entry><title>F</title><link href="ftp://y"/></entry></feed>'
    got = feeds.scan(spark.createDataFrame([("a", rss), ("b", atom), ("c", "<broken"), ("d", None)], "portal string, xml string")).collect()
    assert [r.portal for r in got].count("a") == 20 and [(r.title, r.url, r.date) for r in got if r.portal == "b"] == [("E", "http://y/1", "u")]
    assert got[0].category == "Olahraga" and got[0].summary == "s x" and len(got) == 21


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, "http://h/x", PAGE)], "page_id long, url string, html string").repartition(1)
    for found in (html.listings(pages), html.paragraphs(pages), html.articles(pages)):
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert "MapInArrow" not in html.discovery(pages)._jdf.queryExecution().executedPlan().toString()  # it reads what one pass has left


def test_workers_pass_on_pages_in_pieces_and_leave_no_trees(spark, monkeypatch):
    import gc

    import pyarrow as pa

    passed = {}

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"page_id": list(range(1200)), "html": ["<article><p>A paragraph</p></article>"] * 1200})
            gc.collect()
            gc.disable()
            try:
                passed["rows"] = [b.num_rows for b in run(iter([batch]))]
                passed["trees"] = sum(isinstance(o, html.Node) for o in gc.get_objects())
            finally:
                gc.enable()

    html._table(Pages(), "text string", lambda root: [(root.first("p").text(),)])
    assert passed["rows"] == [500, 500, 200] and passed["trees"] < 20
