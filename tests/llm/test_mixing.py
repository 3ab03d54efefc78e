import numpy as np
import pytest

from tidefeed.llm import mixing as M


def slow_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s) + [s for s in size if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    fixed, budget = {}, 1.5 * sum(size.values())
    while True:
        free = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 2 * size[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: 2.0 * size[s] for s in over}


@pytest.fixture
def rows():
    rng = np.random.default_rng(2)
    return [(i, " ".join(["w"] * int(rng.integers(0, 60))), "big" if i % 3 else [None, "a", "tiny", "é", "zz"][i // 3 % 5]) for i in range(900)] + [(900, None, "big"), (901, "", "empty"), (902, "one two", "last")]


def test_targets_and_totals(make, rows):
    got = M.mix(make(rows), cell_rows=40, fan_in=3).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = slow_targets(size)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in size}
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.size * r.copies and r.taken <= 2 * r.size
    for s in size:
        assert abs(taken[s] - want[s]) <= max((r.size for r in got if r.source == s), default=0)


def test_reruns_agree_whatever_the_partitions(make, rows):
    a, b = ({(r.doc_id, r.copies) for r in M.mix(make(rows, parts), cell_rows=40).collect()} for parts in (2, 7))
    assert a == b


def test_settling_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    sizes = [5, 3, 8, 1, 9, 2]
    probs = [0.3, 0.5, 0.25, 0.9, 0.4, 0.0]
    total = np.zeros(len(sizes))
    for _ in range(4000):
        p, left = M.settle(sizes, probs, rng.random(6))
        assert abs(np.dot(p, sizes) - np.dot(probs, sizes)) < 1e-9
        assert sum(0 < x < 1 for x in p) == (left >= 0)
        total += p
    assert np.abs(total / 4000 - probs).max() < 0.03


def test_empty(make):
    assert M.mix(make(["a"]).where("false")).count() == 0
    assert [r.taken for r in M.mix(make([(1, None, None), (2, "", "s")])).collect()] == [0, 0]


def test_ids_stay_exact_beside_a_null(make):
    big = [9007199254740993 + 2 * i for i in range(20)]
    rows = [(i, "w " * (5 + i % 7), "s") for i in big] + [(None, "a b c", "s")] * 5 + [(big[0], "a b", "t")]
    got = M.mix(make(rows, 4), cell_rows=8)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted([*big, big[0]])
    assert sum(r.doc_id is None for r in got.collect()) == 5
    key = lambda df: sorted(((r.doc_id, r.size, r.copies) for r in df.collect()), key=str)
    assert key(got) == key(M.mix(make(rows, 2), cell_rows=8))


def test_nulls_do_not_share_a_cell(make):
    rows = [(None, f"word{i} " * (1 + i % 9), "s") for i in range(400)]
    got = M.mix(make(rows), cell_rows=20, fan_in=2).collect()
    assert len(got) == 400 and abs(sum(r.taken for r in got) - got[0].target) <= 9


def test_equal_rows_are_one_row_of_a_cell(make, monkeypatch):
    rows = [(1, "same text of five words", "s")] * 3000 + [(i, "w " * (1 + i % 9), "s") for i in range(2, 900)] + [(None, "", "s")] * 500
    monkeypatch.setattr(M, "EQUAL", 700)
    sizes = M.mix(make(rows, 6), cell_rows=100, fan_in=4)
    got = sizes.collect()
    assert len(got) == len(rows) and sum(r.doc_id == 1 for r in got) == 3000 and sum(r.doc_id is None for r in got) == 500
    copies = {r.copies for r in got if r.doc_id == 1}
    assert max(copies) - min(copies) <= 1 and abs(sum(r.taken for r in got) - got[0].target) <= 9
    again = M.mix(make(rows, 3), cell_rows=100, fan_in=4).collect()
    assert sorted((str(r.doc_id), r.copies) for r in again) == sorted((str(r.doc_id), r.copies) for r in got)
