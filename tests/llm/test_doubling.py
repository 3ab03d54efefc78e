"""Operator 11 against brute force, its oracle, and odd input."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from tidefeed.llm import doubling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=13):
    """doc_id, words, removed, hash of what is kept; a null doc_id is the least."""
    low = -(1 << 63)
    docs = [(low if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for key, _, words in docs:
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            least[w] = min(least.get(w, key), key)
    out = []
    for key, i, words in docs:
        gone = set()
        for k in range(len(words) - length + 1):
            if least[tuple(words[k : k + length])] < key:
                gone |= set(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(i), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_levels():
    assert doubling.levels() == [4, 8, 13]
    assert doubling.levels(3) == [3] and doubling.levels(16, 4) == [4, 8, 16]


@pytest.mark.parametrize("length, seed", [(13, 4), (13, 1), (4, 4), (16, 4), (7, 9)])
def test_brute_force(make, texts, length, seed):
    docs = make(texts)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(doubling.remove_repeats(docs, length, seed, batch_bytes=4000, least_shards=5)) == brute(rows, length)


def test_tree_of_rounds(make, texts):
    docs = make([(i % 90, t, "s") for i, t in enumerate(texts * 3)], 12)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for fan_in in (1 << 12, 3):
        assert found(doubling.remove_repeats(docs, batch_bytes=300, least_shards=3, fan_in=fan_in)) == brute(rows)


def test_odd_input(make):
    run = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"x{i % 977}" for i in range(150_000))
    rows = [(7, None, "s"), (8, "", "s"), (9, run, "s"), (9, run + " tail", "s"), (None, run, "s"), (None, run + " more", "s"), (11, run.upper(), "s"), (12, long, "s"), (13, "y " + long, "s"), (14, run.replace(" ", "\n\t"), "s"), (15, run.replace(" ", "\u00a0"), "s")]
    docs = make(rows)
    assert found(doubling.remove_repeats(docs)) == brute([r[:2] for r in rows])
    assert doubling.remove_repeats(docs.where("false")).count() == 0
    kept = {r.doc_id: r.kept for r in doubling.remove_repeats(docs, with_text=True).collect() if r.doc_id}
    assert kept[14] == "" and kept[13] == "y" and kept[15] == run.replace(" ", "\u00a0")


def test_passage_in_every_text_sends_one_name_a_batch():
    rng = np.random.default_rng(1)
    shared = [f"s{i}" for i in range(13)]
    texts = [" ".join([*(f"r{x}" for x in rng.integers(0, 1 << 40, 5)), *shared]).encode() for _ in range(500)]
    data = b"".join(texts)
    row = {"doc": doubling._put(np.arange(500).tobytes()), "size": doubling._put(np.array([len(t) for t in texts]).tobytes()), "data": doubling._put(data)}
    lev = doubling.Level.first(row, doubling._hashers(), 13, True)
    (a, _), least, more, index, _, _ = lev.messages(4, True)
    assert len(lev.pos) == 500 * 6 and len(a) == 500 * 5 + 1 and more.sum() == 1 and least[more].tolist() == [0]
    assert np.bincount(index).max() == 500


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted((str(a), b, c, d) for a, b, c, d in con.execute(doubling.ORACLE_OP11).fetchall())
    got = found(doubling.op11_substring_dedup(spark, sf))
    assert got == want and any(r[2] for r in got)
