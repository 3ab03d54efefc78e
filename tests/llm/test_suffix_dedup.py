import hashlib
import random

import numpy as np
import pytest

from tidefeed.llm import suffix_dedup as S


def brute(rows):
    """Of distinct (doc_id, text) in order of id."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect()]


@pytest.mark.parametrize("shard", [1 << 24, 2000])
def test_against_brute_force(make, texts, shard):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[50], "s"), (5, texts[5], "s")]
    got = S.remove_repeats(make(rows), shard_bytes=shard, with_text=True).collect()
    assert len(got) == len(rows)
    want = brute([(i, t) for i, t, _ in rows])
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("fan_in", [4096, 2])
def test_small_batches_and_rounds(make, texts, fan_in):
    rows = [(i, t, "s") for i, t in enumerate(texts * 2)]
    got = S.remove_repeats(make(rows, 5), shard_bytes=5000, batch_bytes=3000, least_shards=1, fan_in=fan_in)
    assert dict(results(got)) == brute([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("parts", [1, 7, 16])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_repeated_rows_are_one_document_wherever_they_lie(make, spark, texts, parts, broadcast):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[-1], "s"), (None, None, "s")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = results(S.remove_repeats(make(rows * 2, parts), batch_bytes=4000, least_shards=3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = brute([(i, t) for i, t, _ in rows if i is not None] + [(None, texts[-1])])
    assert len(got) == 2 * len(rows)
    assert all(g == want[i] for i, g in got if i is not None or g[0])


def test_texts_of_one_id_are_ordered_by_hash(make):
    rnd = random.Random(3)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    rows = [(1, shared + "x", "s"), (1, "y" + shared, "s"), (1, "y" + shared, "s")]
    removed = sorted(g[1] for _, g in results(S.remove_repeats(make(rows, 3))))
    assert removed in ([0, 0, 300], [0, 300, 300])  # one text keeps the passage, rows that repeat agree


def test_radix_groups():
    data = b"".join(bytes([65 + i % 3]) * 40 + b"tail%d" % (i % 2) + b"-" * 80 for i in range(9))
    start = np.arange(0, len(data) - 100)
    order, first = S.radix_groups(data, start, np.zeros(len(start), np.uint64))
    groups = {}
    for s in start.tolist():
        groups.setdefault(data[s : s + 100], []).append(s)
    assert dict(zip(order.tolist(), first.tolist())) == {s: g[0] for g in groups.values() if len(g) > 1 for s in g}


def test_very_long_text(make, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    text = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(3000))
    rows = [(0, text, "s"), (1, text[500:2500], "s")]
    assert dict(results(S.remove_repeats(make(rows)))) == brute([(i, t) for i, t, _ in rows])


def test_pieces_find_each_minimiser_once(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 512)
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 123, 9000).astype(np.uint8).tobytes()
    ids = S._put(np.array([[1], [2], [0], [len(data)], [1]], np.int64).tobytes())
    b = S.Batch(ids, S._put(data), S.Minimisers())
    assert (np.diff(b.spots) > 0).all() and len(np.concatenate(b.starts)) == len(data) - 99


def test_session_is_left_alone(make, spark, texts):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    S.remove_repeats(make(texts)).count()
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_empty(make):
    assert S.remove_repeats(make(["a"]).where("false")).count() == 0


def test_shards_answer_in_rounds(make, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts * 2)]
    one, many = (dict(results(S.remove_repeats(make(rows, 9), batch_bytes=600, least_shards=3, fan_in=f))) for f in (4096, 4))
    assert one == many == brute([(i, t) for i, t, _ in rows])
