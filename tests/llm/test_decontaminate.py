import random

import numpy as np

from tidefeed.llm import decontaminate as D


def naive_tiles(a, b, least):
    """Greedy string tiling by trying every start."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ua[i + k] and not ub[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append(best)
        ua[i : i + n] = ub[j : j + n] = [True] * n


def test_tiles_against_naive_tiling():
    rnd = random.Random(4)
    for _ in range(150):
        a = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 25))]
        b = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 25))]
        got = D.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for _, _, n in got) == len({x for _, j, n in got for x in range(j, j + n)})
        want = naive_tiles(a, b, 3)
        assert got == [(i, j, n) for n, i, j in want]


def test_one_repeated_word_stays_small():
    import tracemalloc

    text, item = np.full(100_000, 7, np.uint64), np.full(1000, 7, np.uint64)
    D.tiles(item[:10], text[:10])
    tracemalloc.start()
    assert D.tiles(item, text) == [(0, 0, 1000)]
    mixed = text.copy()
    mixed[::11] = 3
    assert sum(n for _, _, n in D.tiles(item, mixed)) == 1000
    seeds = D.Seeds([(1, "w " * 1000), (2, "w " * 40)], 5, 0.5)
    words, at = seeds.hasher.words(["w " * 100_000, "w w w", "x " * 50])
    assert list(seeds.candidates(words, at)) == [(0, 0), (0, 1)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_candidates_lose_no_pair():
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(30)]
    items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))) for i in range(25)]
    seeds = D.Seeds(items, 3, 0.5)
    words, at = seeds.hasher.words(texts)
    got = set(seeds.candidates(words, at, most=5))
    for r, t in enumerate(texts):
        for k, (_, x) in enumerate(items):
            a, b = x.split(), t.split()
            if a and sum(n for n, _, _ in naive_tiles(a, b, 3)) >= 0.5 * len(a):
                assert (r, k) in got


ITEM = "the committee shall publish its findings within thirty days of the final hearing and send copies to every member who asked for them in writing"


def test_operator(make, spark):
    w = ITEM.split()
    swapped = " ".join(w[12:] + ["and", "so"] + w[:12])
    rows = [(0, "x y z " + ITEM.upper() + " q", "s"), (1, swapped, "s"), (2, " ".join(w[:6]) + " something else entirely", "s"), (3, None, "s"), (4, "", "s"), (5, "a " * 5000 + ITEM, "s"), (None, ITEM, "s"), (0, "clean text here", "s")]
    items = spark.createDataFrame([(7, ITEM), (3, ITEM), (9, "too short"), (10, None), (11, "one two three four five six")], "item_id long, text string")
    for block in (2_000_000, 20):
        got = D.contamination(make(rows), items, block_tokens=block).collect()
        bad = {(r.doc_id, r.item_id, r.n_items) for r in got if r.contaminated}
        assert {(1, 3, 2), (5, 3, 2), (None, 3, 2), (0, 3, 2)} == bad
    docs = make(rows)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for i, t, _ in rows if i in (2, 3, 4) or t == "clean text here")


def test_rows_stay_apart_at_any_number_of_blocks(make, spark):
    other = "seven ships with grain and timber left the northern harbour before the first storm of that winter closed the strait for months"
    rows = [(0, ITEM, "s"), (0, "clean text here", "s"), (None, ITEM, "s"), (None, "also clean", "s"), (None, None, "s"), (1, other + " " + ITEM, "s")]
    items = spark.createDataFrame([(7, ITEM), (3, ITEM), (5, other), (8, "short")], "item_id long, text string")
    one, many = ([tuple(r) for r in D.contamination(make(rows), items, block_tokens=n).collect()] for n in (2_000_000, 20))
    assert sorted(one, key=str) == sorted(many, key=str) and len(many) == len(rows)
    assert sum(r[0] is None for r in many) == 3


def test_empty(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not D.contamination(make(["a b c d e f"]), none).first().contaminated
    assert D.clean(make(["a"]).where("false"), none).count() == 0


def test_verdicts_against_every_document_and_item(make, spark):
    """The whole operator by naive tiling of all pairs, in one block of items and in many."""
    rnd = random.Random(21)
    vocab = [f"w{i}" for i in range(30)]

    def prose(n):
        return [rnd.choice(vocab) for _ in range(n)]

    items = [(i, prose(rnd.choice((3, 6, 12, 20)))) for i in range(12)]
    texts = []
    for _ in range(30):
        words = prose(rnd.randint(0, 15))
        for _, item in rnd.sample(items, 2):
            a = rnd.randrange(len(item))
            words += item[a:] + prose(rnd.randint(0, 6)) + item[:a] if rnd.random() < 0.4 else item[: len(item) // 3]
        texts.append(" ".join(words).upper() if rnd.random() < 0.2 else " ".join(words))
    want = []
    for t in texts:
        shares = {i: sum(n for n, _, _ in naive_tiles(item, t.lower().split(), 5)) / len(item) for i, item in items}
        hit = {i: s for i, s in shares.items() if s >= 0.5}
        best = min(hit, key=lambda i: (-hit[i], i)) if hit else None
        want.append((best, round(hit[best], 9) if hit else 0.0, len(hit)))
    docs, table = make(texts, 4), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for block in (2_000_000, 20):
        got = {r.doc_id: (r.item_id, round(r.coverage, 9), r.n_items) for r in D.contamination(docs, table, block_tokens=block).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert {r.doc_id for r in D.clean(docs, table, block_tokens=block).collect()} == {i for i, w in enumerate(want) if w[0] is None}
    assert 5 < sum(w[0] is not None for w in want) < 28
