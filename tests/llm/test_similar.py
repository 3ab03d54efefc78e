import os
import random

import pytest

import corpus_pipeline
from tidefeed.llm import similar as N
from tidefeed.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_components(rows):
    """(id, text) to the smallest id reachable by similarities of 0.8 and more."""
    sets, label = [shingles(t) for _, t in rows], [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {i: x for (i, _), x in zip(rows, label)}


def copies():
    """Bases, copies with one to five changed words, chains, short and empty texts."""
    rnd = random.Random(8)
    out = []
    for _ in range(12):
        w = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice((6, 30, 100, 200)))]
        for k in range(6):
            out.append(" ".join(w))
            w = w[:]
            for _ in range(k):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(500)}"
    return out + ["", None, " \n", "a b c", "A  b c", "a b d"]


def groups(df, ids):
    own = {r.doc_id: r.component_id for r in df.collect()}
    return {i: own.get(i, i) for i in ids}


def test_against_brute_force(make):
    rows = list(enumerate(copies()))
    docs = make([(i, t, "s") for i, t in rows])
    want = slow_components(rows)
    got = groups(N.components(docs), dict(rows))
    assert len(set(want.values())) < len(rows) and all(want[i] == want[got[i]] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 0.03 * len(want)  # what the radius misses


def test_rounds_and_buckets_lose_no_candidate(make):
    """All pairs within the two radii that verify are linked, whatever the partitions."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["a", "b"]) for _ in range(rnd.choice((6, 7, 8)))) for _ in range(60)]
    rows = list(enumerate(texts))
    sets = N.shingle_sets(N.WordHasher(), texts)
    fp = [N.set_print(s) for s in sets]
    fp2 = [N.set_print(N.mix64(s + N.np.uint64(0x9E3779B97F4A7C15))) for s in sets]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            shared = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if (fp[i] ^ fp[j]).bit_count() <= 22 and (fp2[i] ^ fp2[j]).bit_count() <= 40 and shared >= 0.5 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = groups(N.components(make([(i, t, "s") for i, t in rows], 2), similarity=0.5, bits=22, bits_2=40, growth=6), dict(rows))
    assert [got[i] for i in range(60)] == label and 1 < len(set(label)) < 60


def test_loose_cluster_takes_several_rounds(make):
    """Copies that resemble the middle but not each other: the smallest is asked first and refuses."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(12):
        w = base[:]
        for i in rnd.sample(range(0, 120, 6), 2):
            w[i] = f"x{k}_{i}"
        out.append(" ".join(w))
    rows = list(enumerate([*out[:6], " ".join(base), *out[6:]]))
    assert groups(N.components(make([(i, t, "s") for i, t in rows])), dict(rows)) == {i: 0 for i, _ in rows}


def test_repeated_ids_and_nulls(make):
    rows = [(5, "a b c d e f", "s"), (5, "other words are here now ok", "s"), (3, "a b c d e f", "s"), (3, "other words are here now ok", "s"), (None, "a b c d e f", "s"), (9, None, "s"), (8, " ", "s")]
    kept = N.distinct_documents(make(rows)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [3, 3, 8, None]


def test_stage_finds_what_three_bits_miss(make, spark):
    w = [f"word{i}" for i in range(100)]
    near = w[:50] + ["other"] + w[51:]  # 91 of 101 shingles in common
    docs = make([(4, " ".join(w), "s"), (2, " ".join(near), "s"), (3, "something else altogether here now", "s"), (None, " ".join(w), "s")])
    assert (simhash.fingerprint(" ".join(w)) ^ simhash.fingerprint(" ".join(near))).bit_count() > 3
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {None, 2, 3}


def test_empty(make):
    assert N.distinct_documents(make(["a"]).where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert groups(N.components(docs), dict(rows)) == slow_components(rows)


def test_cells_never_rule_out_a_similar_pair():
    np = N.np
    rng = np.random.default_rng(3)
    ruled = 0
    for _ in range(300):
        n, k = int(rng.integers(1, 900)), int(rng.integers(0, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(0, len(a) - k)], rng.integers(0, 2**63, k, dtype=np.uint64)])) if k else a
        shared = len(np.intersect1d(a, b))
        x, y = ({"n": np.array([len(s)]), "cells": np.frombuffer(N.cells_of(s), np.uint64).reshape(1, -1)} for s in (a, b))
        at = np.zeros(1, np.int64)
        may = N._may_be(x, at, y, at, 0.8)[0]
        assert may or shared < 0.8 * (len(a) + len(b) - shared)
        ruled += not may
    assert ruled > 50
