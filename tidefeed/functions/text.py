"""Text, URL and hash functions as Column expressions; only Unicode normal forms need a Python worker."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query keys that only track a visitor.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "from", "source", "fbclid", "gclid", "ocid", "_ga")

# Categories in order, each with the substrings that select it.
CATEGORIES = {
    "Nasional": ["nasional", "indonesia", "nusantara", "daerah", "regional", "peristiwa", "news"],
    "Politik": ["politik", "pemerintah", "pilkada", "pemilu", "dpr", "mpr", "dprd"],
    "Ekonomi": ["ekonomi", "keuangan", "pasar", "saham", "rupiah", "inflasi", "finance", "moneter"],
    "Bisnis": ["bisnis", "industri", "korporasi", "startup", "umkm", "investasi"],
    "Teknologi": ["teknologi", "tekno", "gadget", "digital", "internet", "ai", "software", "sains", "inet"],
    "Olahraga": ["olahraga", "sport", "bola", "sepak bola", "basket", "badminton", "atletik"],
    "Hiburan": ["hiburan", "entertainment", "selebriti", "film", "musik", "artis", "seleb", "hot"],
    "Internasional": ["internasional", "dunia", "global", "luar negeri", "world", "mancanegara"],
    "Kesehatan": ["kesehatan", "health", "medis", "dokter", "covid", "virus", "gizi"],
    "Pendidikan": ["pendidikan", "kampus", "universitas", "sekolah", "beasiswa", "edukasi"],
    "Otomotif": ["otomotif", "mobil", "motor", "kendaraan", "oto"],
    "Gaya Hidup": ["gaya hidup", "lifestyle", "kuliner", "travel", "wisata", "fashion", "food"],
    "Hukum": ["hukum", "kriminal", "polisi", "pengadilan", "korupsi", "kpk", "kejaksaan"],
}
NO_CATEGORY, ALL_CATEGORIES = "Umum", "Semua"


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column, default: Column | str = "") -> Column:
    """default where c is null or empty."""
    return F.coalesce(F.when(c != "", c), default if isinstance(default, Column) else F.lit(default))


def nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def label(c: Column) -> Column:
    return filled(c, NO_CATEGORY)


def clip(c: Column, n: int, dots: bool = False) -> Column:
    cut = F.substring(F.coalesce(c, F.lit("")), 1, n)
    return F.concat(cut, F.when(F.char_length(c) > n, "...").otherwise("")) if dots else cut


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme and host (leading characters w and . gone), path without trailing slashes, sorted query without tracking or blank keys; no fragment, no path parameters."""
    u = strip(F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(u, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1)), r"^[w.]+", "")
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(rest, r"^//[^/?]*", ""), r"^([^?]*)", 1), r";[^/]*$", "")
    trimmed = F.regexp_replace(path, r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)

    def decode(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]*=.+")),
        lambda p: F.struct(decode(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"), decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS)))

    def encode(x: Column) -> Column:  # the form encoder writes * as it is and ~ as %7E; the reverse is wanted
        return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    text = F.array_join(F.transform(kept, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when((host != "") | rest.startswith("//"), F.concat(F.lit("//"), host)).otherwise(""),
        F.when(trimmed == "", "/").otherwise(trimmed), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
    )


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url).cast("binary"), 256)


def content_hash(title: Column, excerpt: Column) -> Column:
    e = F.substring(F.lower(strip(F.coalesce(excerpt, F.lit("")))), 1, 200)
    return F.sha2(F.concat(F.lower(strip(F.coalesce(title, F.lit("")))), F.lit("|"), e).cast("binary"), 256)


def simhash_words(text: Column) -> Column:
    clean = F.regexp_replace(normal_form(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")


def simhash_tokens(words: Column, most: int = 200) -> Column:
    """Words, then pairs of neighbours, of which the first `most`."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.slice(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())), 1, most)


def low_md5(token: Column) -> Column:
    """The low 64 bits of MD5, as a long."""
    h = F.md5(token.cast("binary"))
    high = F.conv(F.substring(h, 17, 8), 16, 10).cast("long")
    low = F.conv(F.substring(h, 25, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def from_hex64(c: Column) -> Column:
    return F.shiftleft(F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(c, 9, 8), 16, 10).cast("long"))


def category(raw: Column) -> Column:
    """The first category with a matching substring, else the text with every word capitalised."""
    low = F.lower(strip(raw))
    out = F.when(raw.isNull() | (strip(raw) == ""), NO_CATEGORY)
    for name, words in CATEGORIES.items():
        out = out.when(low.rlike("|".join(words)), name)
    return out.otherwise(title_case(strip(raw)))


def title_case(c: Column) -> Column:
    """Upper case after anything that isn't a letter, lower case after a letter."""
    chars = F.split(F.lower(c), "")
    up = F.transform(chars, lambda x, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(x)).otherwise(x))
    return F.array_join(up, "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
# Schemes whose links may be relative.
RELATIVE = ("", "file", "ftp", "gopher", "http", "https", "imap", "mms", "nntp", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "shttp", "svn", "svn+ssh", "wais", "ws", "wss")


def resolved(base: Column, link: Column) -> Column:
    """The address that a link on a page at `base` means: its own host, or the base's with the paths joined and dot segments taken
    out; links of other schemes stay as they are."""
    b, raw = F.coalesce(base, F.lit("")), F.coalesce(link, F.lit(""))
    l = F.regexp_replace(raw, r"^[\x00-\x20]+|[\t\r\n]", "")

    def part(u: Column, i: int) -> Column:
        return F.regexp_extract(u, URL, i)

    def mark(u: Column, i: int) -> Column:
        return F.when(F.char_length(part(u, i)) > 1, part(u, i)).otherwise("")

    scheme = F.lower(F.when(part(l, 1) != "", part(l, 1)).otherwise(part(b, 1)))
    foreign = (scheme != F.lower(part(b, 1))) | ~scheme.isin(*RELATIVE)
    own_host, path, above = F.char_length(part(l, 2)) > 2, part(l, 3), F.regexp_replace(part(b, 3), r"[^/]*$", "")
    joined = F.split(F.when(path.startswith("/"), path).when(above == "", F.concat(F.lit("/"), path)).otherwise(F.concat(above, path)), "/")
    n = F.size(joined)
    steps = F.concat(F.slice(joined, 1, 1), F.filter(F.slice(joined, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x: (x != "") | path.startswith("/")), F.slice(joined, n, F.lit(1)))
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    whole = F.concat(F.array_join(walked, "/"), F.when(F.element_at(joined, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise(""))
    rooted = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))
    head = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    below = F.when(path == "", F.concat(part(b, 3), F.when(mark(l, 4) != "", mark(l, 4)).otherwise(mark(b, 4)))).otherwise(F.concat(rooted, mark(l, 4)))
    there = F.concat(head, part(l, 2), path, mark(l, 4), mark(l, 5))
    return F.when(raw == "", b).when((b == "") | foreign, raw).when(own_host, there).otherwise(F.concat(head, part(b, 2), below, mark(l, 5)))


def normal_form(c: Column) -> Column:
    """NFKC. Texts of ASCII and precomposed Latin letters are in that form already: only others travel to a Python worker."""
    other = c.rlike(r"[^\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E]")
    return F.coalesce(nfkc(F.when(other, c)), c)


def clean_text(c: Column) -> Column:
    return strip(F.regexp_replace(normal_form(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


# Portals that are known by a word in what is asked for, in order.
KNOWN_PORTALS = {
    "liputan6": "https://www.liputan6.com", "okezone": "https://www.okezone.com", "merdeka": "https://www.merdeka.com", "sindonews": "https://www.sindonews.com",
    "republika": "https://www.republika.co.id", "tempo": "https://www.tempo.co", "antara": "https://www.antaranews.com", "bisnis": "https://www.bisnis.com",
    "suara": "https://www.suara.com", "kumparan": "https://kumparan.com", "idntimes": "https://www.idntimes.com", "viva": "https://www.viva.co.id",
    "detik": "https://www.detik.com", "kompas": "https://www.kompas.com", "cnn": "https://www.cnnindonesia.com", "cnnindonesia": "https://www.cnnindonesia.com",
    "jpnn": "https://www.jpnn.com", "jawapos": "https://www.jawapos.com", "solopos": "https://www.solopos.com", "medcom": "https://www.medcom.id",
}


def portal_address(asked: Column) -> Column:
    """The address of a portal that is asked for by name or address; null where only the network could tell."""
    q = F.regexp_replace(F.lower(strip(asked)), "/+$", "")
    out = None
    for word, url in KNOWN_PORTALS.items():
        out = F.when(q.contains(word), url) if out is None else out.when(q.contains(word), url)
    return out.when(q.contains("."), F.when(q.startswith("http"), q).otherwise(F.concat(F.lit("https://"), q)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def first_date(*dates: Column) -> Column:
    return F.coalesce(*[F.when(d != "", d) for d in dates], F.lit(""))


def tags_removed(html: Column) -> Column:
    return clean_text(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " "))


def summary(body: Column, sentences: int = 2, least: int = 30, most: int = 300) -> Column:
    """The first sentences of over `least` characters, cut to most - 3 and dots if longer than most."""
    parts = F.filter(F.transform(F.split(body, r"(?<=[.!?])\s+"), strip), lambda s: F.char_length(s) > least)
    text = F.array_join(F.slice(parts, 1, sentences), " ")
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def countdown(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def ago(minutes: Column) -> Column:
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" menit lalu"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" jam lalu"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" hari lalu")))


def participation_code(pseudonym: Column, prefix: str) -> Column:
    return F.upper(F.substring(F.replace(pseudonym, F.lit(prefix), F.lit("")), 1, 6))


def pseudonym(seed: Column) -> Column:
    return F.substring(F.sha2(seed.cast("binary"), 256), 1, 16)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%.2f ms", ms)).otherwise(F.format_string("%.2f s", ms / 1000))
