import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidefeed.llm import simhash as S
from tidefeed.llm.components import connected


def slow_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(items):
    """items: (id, fp); the smallest id reachable by links of at most 3 bits."""
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), x in zip(items, label):
        least[x] = min(least.get(x, i), i)
    return [least[x] for x in label]


def test_against_brute_force(make, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(make(rows)).collect()}
    prints = [(i, slow_print(t)) for i, t, _ in rows]
    want = slow_components(prints)
    assert got == {i: (format(f, "016x"), c) for (i, f), c in zip(prints, want)}
    assert len({c for _, c in got.values()}) < len(rows)


def test_fingerprint_is_the_sql_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1 == S.fingerprint("A  b\nC")


def clustered(n, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n)]
    return sorted({b ^ sum(1 << x for x in rnd.sample(range(64), k)) for b in base for k in (0, 0, 1, 2, 3, 3, 4, 5) for _ in range(3)})


def test_no_link_is_lost(spark):
    fps = clustered(40, 1)
    dense = [0xABC << 20 ^ m for m in range(200)]  # more than one small bucket, every pair close in most partitions
    fps = sorted(set(fps) | set(dense))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for hot in (20000, 30):
        roots = {r.node: r.root for r in connected(S.links(df, 3, hot_rows=hot)).collect()}
        group = [roots.get(r, r) for r in (f - (1 << 64) if f >> 63 else f for f in fps)]
        want = slow_components([(i, f) for i, f in enumerate(fps)])
        assert len(set(zip(group, want))) == len(set(group)) == len(set(want))


def test_plan_covers_the_threshold():
    rng = np.random.default_rng(0)
    for total in (10, 10**6, 10**10):
        for bits in (1, 3, 4):
            parts = S.plan(rng.integers(0, 2**63, 500, dtype=np.uint64), total, bits)
            assert sum(t + 1 for _, t in parts) == bits + 1
            used = [b for p, _ in parts for b in p]
            assert len(used) == len(set(used))
    assert max(len(p) for p, _ in S.plan(rng.integers(0, 2**63, 500, dtype=np.uint64), 10**10, 3)) > 16


def test_empty_and_null_ids(make, spark):
    assert S.near_duplicates(make(["a"]).where("false")).count() == 0
    got = S.near_duplicates(make([(None, "solo text here", "s")])).first()
    assert got.component_id is None and got.component_size == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (100, 102), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_edges_in_several_tasks(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(200)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(150)] + [(7, 7)]
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, {a})
            want.setdefault(b, {b})
            if want[a] is not want[b]:
                both = want[a] | want[b]
                for x in both:
                    want[x] = both
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for most in (1_000_000, 40):
        assert {r.node: r.root for r in connected(df, most).collect()} == {n: min(s) for n, s in want.items()}
