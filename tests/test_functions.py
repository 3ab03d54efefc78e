import hashlib
import re
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.functions.scoring import Params, decay_weight, event_weight, percentage


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.wired.com/a/", "https://ired.com/a"),
        ("HTTP://Web.id//?b=2&a=1&utm_source=x&c=#f", "http://eb.id/?a=1&b=2"),
        ("http://h.x/p?UTM_Medium=q&x=a+b&x=a%20a", "http://h.x/p?x=a+a&x=a+b"),
        ("  https://a.b/c///?q=1#z ", "https://a.b/c?q=1"),
        ("http://a.b/c;p=1?z=%7E*", "http://a.b/c?z=~%2A"),
    ],
)
def test_canonical_url(spark, url, want):
    assert values(spark, [(url,)], "u string", X.canonical_url(F.col("u"))) == [(want,)]


def test_canonical_url_follows_the_standard_parser(spark):
    urls = ["http://www.x.org/a/b/?k=v&a=%C3%A9&ref=1", "https://x.y:80/?b=1&b=0&_GA=3", "http://x/?a=1&&b", "https://q.r"]
    for url, (got,) in zip(urls, values(spark, [(u,) for u in urls], "u string", X.canonical_url(F.col("u")))):
        p = urlparse(url)
        q = urlencode(sorted((k, v) for k, v in parse_qsl(p.query) if k.lower() not in X.TRACKING_KEYS))
        assert got == f"{p.scheme}://{p.netloc.lower().lstrip('w.')}{p.path.rstrip('/') or '/'}" + (f"?{q}" if q else "")


def test_content_hash_ignores_case_borders_and_what_follows_200(spark):
    rows = [(" A ", "x" * 201), ("a", "X" * 200), ("a", "x" * 199)]
    a, b, c = values(spark, rows, "t string, e string", X.content_hash(F.col("t"), F.col("e")))
    assert a == b != c


def reference_simhash(text):
    text = re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", text.lower()))
    w = text.split()
    votes = [0] * 64
    for t in (w + [f"{a} {b}" for a, b in zip(w, w[1:])])[:200]:
        h = int(hashlib.md5(t.encode()).hexdigest(), 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return format(sum(1 << i for i in range(64) if votes[i] > 0), "016x")


def test_simhash(spark):
    from tidefeed.operators.dedup import simhash

    texts = ["", "  !? ", "one", "the quick brown fox", "Éa, b_c 12 x-y", "Harga ™ 25℃ № 5", "ﬃ © ² Ⅷ ＡＢ", " ".join(f"w{i}" for i in range(300)), None]
    got = {r.id: r.h for r in simhash(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t")).select("id", X.hex64(F.col("fp")).alias("h")).collect()}
    assert got == {i: reference_simhash(t or "") for i, t in enumerate(texts)}
    back = values(spark, [("8000000000000001",)], "h string", X.hex64(X.from_hex64(F.col("h"))), X.hamming(X.from_hex64(F.col("h")), F.lit(0).cast("long")))
    assert back == [("8000000000000001", 2)]


def test_category(spark):
    cases = {"Internasional": "Nasional", "entertainment": "Teknologi", "photo": "Hiburan", " ": "Umum", None: "Umum", "hello-foo": "Hello-Foo", "it's o": "It'S O"}
    assert values(spark, [(k,) for k in cases], "c string", X.category(F.col("c"))) == [(v,) for v in cases.values()]


def test_text_helpers(spark):
    got = values(
        spark, [("ﬁ  a\n b ", "<p>a<b>c</b></p><script>x</script>", "http://A.b/x")], "a string, h string, u string",
        X.clean_text(F.col("a")), X.tags_removed(F.col("h")), X.host(F.col("u")), X.resolved(F.col("u"), F.lit("/y")), X.countdown(F.lit(90061)), X.countdown(F.lit(-5)), X.ago(F.lit(61)), X.filled(F.lit(""), "z"),
    )
    assert got == [("fi a b", "a c", "a.b", "http://A.b/y", "25:01:01", "00:00:00", "1 jam lalu", "z")]


def test_summary(spark):
    long = "A" * 160 + ". " + "B" * 160 + ". " + "C" * 40
    got = values(spark, [("Short. This sentence has more than thirty characters! And this one has as many as that, too. Third one is never used here.",), (long,), ("",)], "t string", X.summary(F.col("t")))
    assert got[0] == ("This sentence has more than thirty characters! And this one has as many as that, too.",)
    assert len(got[1][0]) == 300 and got[1][0].endswith("...") and got[2] == ("",)


def test_weights(spark):
    rows = [("2024-01-01 00:00:00", "rec_click"), ("2024-02-05 00:00:00", "share"), ("2024-01-30 12:00:00", "click")]
    ts, asof = F.col("t").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp")
    got = values(spark, rows, "t string, k string", F.round(decay_weight(ts, asof, 0.1), 6), event_weight(F.col("k"), Params(click=5)))
    assert got == [(0.049787, 1.0), (1.0, 3.0), (0.951229, 5.0)]
    assert values(spark, [(1, 3, 0)], "a int, b int, c int", percentage(F.col("a"), F.col("b")), percentage(F.col("a"), F.col("c"))) == [(33.33, 0.0)]


@pytest.mark.parametrize("bad", [{"decay": 0}, {"click": 11}, {"min_sim": 2}, {"top_n": 51}])
def test_parameter_ranges(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_rounding_equals_the_exact_binary_value(spark):
    import random

    from tidefeed.functions.scoring import rounded

    rnd = random.Random(2)
    xs = [0.125, 0.375, 2.00005, 1.00005, 2.5, 0.5, -0.125, -2.00005, 1e-9, 0.0, 1e15 + 0.3, 3e300, 2.675, 1.005]
    xs += [(2 * i + 1) / 20000 for i in range(2000)] + [i / 8 for i in range(-50, 50)] + [rnd.random() * 10 ** rnd.randrange(-6, 9) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[rounded(F.col("x"), d).alias(f"r{d}") for d in (0, 2, 4, 6)]).collect()
    for r in rows:
        assert [r.r0, r.r2, r.r4, r.r6] == [round(r.x, d) for d in (0, 2, 4, 6)], r.x


def test_links_resolve_as_urljoin_does(spark):
    from itertools import product
    from urllib.parse import urljoin

    bases = ["http://h.org", "http://h.org/", "https://h.org/a", "http://h.org/a/b/", "http://h.org/a/b/c.html?x=1#f", "HTTP://H.org/a//b", "ftp://h.org/d/e", "", "mailto:me@h.org"]
    links = ["", "x", "/y", "./z", "../w", "../../..", "../../../u/v", "a/./b/../c", "..", ".", "?q=1", "#top", "p?q#r", "//other.org/x/../y", "http:rel", "https://z.org", "ftp://f.org/x", "mailto:a@b", "javascript:void(0)", " /lead", "a b", "x/", "//", "?", "/a//b", "HTTPS://Up.org/P", "c;d", "a:b"]
    rows = [(b, l) for b, l in product(bases, links)]
    got = spark.createDataFrame(rows, "b string, l string").select("b", "l", X.resolved(F.col("b"), F.col("l")).alias("u")).collect()
    wrong = [(r.b, r.l, r.u, urljoin(r.b, r.l)) for r in got if r.u != urljoin(r.b, r.l)]
    assert not wrong, wrong[:20]
