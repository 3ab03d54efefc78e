"""Operators 12 and 13 against brute force, the oracle, and odd input."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidefeed.llm import vector_codes, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, vector array<float>, label int, n int, x string, place int, error string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2, "y") for i, v, lab in rows], SCHEMA).repartition(parts)


def random_rows(n, d, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * np.linspace(2, 0.1, d) * spread
    return [(int(i), [float(np.float32(c)) for c in v], [None, 0, 1][i % 3]) for i, v in enumerate(base)]


def integers(rows, scale):
    ok = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    return ok, np.array([[math.floor(scale * c) for c in v] for _, v, _ in ok], dtype=object)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    ok, x = integers(rows, 4096)
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, ok[i][1]))
    d = x.shape[1]
    spans = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[list(x[i][a:b]) for i in order[:entries]] for a, b in spans]

    def nearest(book, q):
        return min((sum((s - t) ** 2 for s, t in zip(q, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(spans):
            held = {}
            for v in x:
                held.setdefault(nearest(books[p], v[a:b])[1], []).append(v[a:b])
            for e, vs in held.items():
                books[p][e] = [sum(col) // len(vs) for col in zip(*vs)]
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, lab), v in zip(ok, x):
        near = [nearest(books[p], v[a:b]) for p, (a, b) in enumerate(spans)]
        error = sum(e for e, _ in near)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, lab, "".join(f"{e:02x}" for _, e in near), error))
    return sorted((str(i), code, error, by_label[lab], digest) for i, lab, code, error in out)


def codes(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("d, n", [(16, 150), (11, 60), (8, 9)])
def test_codes_equal_brute_force(spark, d, n):
    rows = random_rows(n, d, d)
    assert codes(vector_codes.compress(frame(spark, rows))) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = random_rows(40, 16, 3)
    rows += [(100, None, 1), (101, [1.0] * 15 + [None], 1), (102, [math.nan] * 16, 1), (103, [math.inf] * 16, 0), (104, [], 0)]
    same = [0.25] * 16
    rows += [(None, same, 0), (None, same, None), (5, same, None), (5, same, None), *[(200 + i, same, 1) for i in range(30)]]
    assert codes(vector_codes.compress(frame(spark, rows, 7))) == brute_codes(rows)
    odd = frame(spark, [*rows, (300, [1.0] * 7, 0), (301, [1e30] * 16, 0)])
    assert codes(vector_codes.compress(odd)) == brute_codes(rows)
    empty = vector_codes.compress(frame(spark, rows).where("false"))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_filter_is_exact_and_measures_less():
    rng = np.random.default_rng(2)
    book, q = rng.integers(-5000, 5000, (16, 8)), rng.integers(-5000, 5000, (3000, 8))
    book[7] = book[3]  # a tie goes to the lower index
    entry, distance, measured = vector_codes.VAFile(book).nearest(q)
    exact = ((q[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    lower, upper = vector_codes.VAFile(book).bounds(q)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert measured < exact.size / 3


def test_codes_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(vector_codes.ORACLE_OP13)
    names = [c[0] for c in want.description]
    got = vector_codes.op13_vector_codes(spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def reference(rows, k=8):
    ok, ints = integers(rows, 1024)
    x = ints.astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s)) for v in x]
    return ok, n, deviation, (y @ axes) / np.sqrt(values), values / np.trace(y.T @ y / n)


def check_whitened(df, rows, k=8):
    ok, n, deviation, white, share = reference(rows, k)
    got = {}
    for r in df.collect():
        got.setdefault((str(r.vec_id), r.deviation), []).append(r)
        assert r.n == n and r.identity_error <= 1e-9
    keys = [(str(r[0]), d) for r, d in zip(ok, deviation)]
    assert set(keys) == set(got) and sum(len(v) for v in got.values()) == len(ok) * white.shape[1]
    for c in range(white.shape[1]):
        mine = [next(r for r in got[key] if r.component == c + 1) for key in keys]
        z = np.array([r.whitened for r in mine])
        sign = np.sign(z @ white[:, c])
        assert np.abs(sign * z - white[:, c]).max() < 1e-8
        assert max(abs(r.explained / share[c] - 1) for r in mine) < 1e-10


@pytest.mark.parametrize("n, d", [(300, 24), (120, 40), (200, 5)])
def test_whitening_equals_eigh(spark, n, d):
    rows = random_rows(n, d, n)
    check_whitened(whitening.whiten(frame(spark, rows)), rows, min(8, d))


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    check_whitened(whitening.op12_whitening(spark, SF), rows)


def test_whitening_of_odd_rows(spark):
    rows = random_rows(90, 12, 4)
    bad = [(500, None, 1), (501, [1.0] * 11 + [None], 1), (502, [math.nan] * 12, 1), (503, [-math.inf] * 12, 1), (504, [], 1)]
    rows = [*rows, *bad, (None, rows[3][1], 1), (7, rows[7][1], 1)]
    check_whitened(whitening.whiten(frame(spark, rows)), rows)
    assert whitening.whiten(frame(spark, rows).where("false")).count() == 0
    assert whitening.whiten(frame(spark, [(i, [0.5] * 6, 1) for i in range(9)])).count() == 0
    flat = [(i, [float(i % 5), float(i % 3), 0.5, 0.5], 1) for i in range(30)]
    assert whitening.whiten(frame(spark, flat)).groupBy("vec_id").count().select("count").distinct().collect() == [(2,)]


def test_lobpcg_finds_close_eigenvalues():
    rng = np.random.default_rng(6)
    d = 200
    axes = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.linspace(1.0, 0.5, d)
    matrix = (axes * values) @ axes.T
    passes = []

    def product(q):
        passes.append(q.shape[1])
        return matrix @ q, float(np.trace(matrix))

    found, x, norms, trace = whitening.lobpcg(product, d, 8)
    assert np.abs(found - values[:8]).max() < 1e-13 and norms.max() < 1e-11 and abs(trace - values.sum()) < 1e-9
    assert np.abs(np.abs(x.T @ axes[:, :8]) - np.eye(8)).max() < 1e-8 and max(passes) <= 48


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 20, 5], [3, 4]], np.int64)
    big = np.int64(1 << 40)
    assert whitening._deviation(x, int(big), np.array([0, 0])) == [None, None]
    assert whitening._deviation(x, 2, x.sum(axis=0)) == [(2 * (1 << 20) - (1 << 20) - 3) ** 2 + 1] * 2


def test_usable_takes_the_most_frequent_length(spark):
    rows, d = vectors.usable(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [1.0], 0)]), 4096)
    assert d == 2 and rows.count() == 2
