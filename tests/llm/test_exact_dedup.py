import hashlib
import re
from collections import defaultdict

from tidefeed.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        t = t or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i))
    return {(i, min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(g), h) for h, g in groups.items() for _, _, i in g}


def check(got, rows):
    assert len(got) == len(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})


def test_against_brute_force(make, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(200, texts[0] + " ", "s"), (None, texts[1], "s"), (7, texts[7], None), (300, "a b", "s"), (300, "ab", "s"), (300, "a b", "s"), (None, "lone", "s"), (None, "lone", "s")]
    check(E.duplicate_groups(make(rows)).collect(), rows)


def test_several_rounds(make, monkeypatch):
    monkeypatch.setattr(E, "BITS_PER_ROW", 40_000)
    rows = [(i, f"text {i % 7} {i % 3}", "s") for i in range(40)] + [(90 + i, f"alone {i}", "s") for i in range(30)]
    docs = make(rows)
    assert E.filters(docs, len(rows), filter_blocks=30)[0] == 3
    check(E.duplicate_groups(docs, filter_blocks=30).collect(), rows)
    assert E.distinct_documents(docs, filter_blocks=30).count() == 21 + 30


def test_filter_has_every_repeat_and_little_else(make, spark):
    rows = [(i, f"text {i}", "s") for i in range(2000)] + [(5000 + i, f"text {i}", "s") for i in range(0, 2000, 10)]
    table = E.digests_of(make(rows))
    _, blocks = E.filters(table, len(rows))
    probed = E.maybe_repeated(table, E.repeat_filter(table, blocks), blocks).groupBy("_sha").agg({"_maybe": "min", "*": "count"}).collect()
    assert all(r["min(_maybe)"] for r in probed if r["count(1)"] > 1)
    assert sum(r["min(_maybe)"] for r in probed if r["count(1)"] == 1) < 60


def test_hot_group(make):
    rows = [(i, "same text", "s") for i in range(500)] + [(1000 + i, f"text {i}", "s") for i in range(300)]
    got = E.duplicate_groups(make(rows)).where("group_size > 1").collect()
    assert len(got) == 500 and {r.keep_id for r in got} == {0}


def test_documents_that_stay(make, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s")]
    docs = make(rows)
    kept = E.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in brute(rows)})


def test_empty(make):
    docs = make(["a"]).where("false")
    assert E.duplicate_groups(docs).count() == 0 and E.distinct_documents(docs).count() == 0


def test_narrowed_loses_no_key(make, spark):
    from tidefeed.llm import common

    rows, keys = spark.range(3000).withColumnRenamed("id", "k"), spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    got = {r.k: r["_in"] for r in common.narrowed(rows, keys, "k", keys.count()).collect()}
    assert all(got[k] for k in range(0, 3000, 7)) and sum(got.values()) < 429 + 300
    assert not any(r["_in"] for r in common.narrowed(rows, keys.where("false"), "k", 0).collect())
