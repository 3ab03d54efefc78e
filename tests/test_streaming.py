import datetime as dt

from tidefeed.streaming import jobs


def test_periodic_and_new_user_rebuild(spark, tmp_path):
    src, built, schema = str(tmp_path / "in"), [], "user_id long"
    known = spark.createDataFrame([(1,)], schema)
    each = jobs.rebuild_for_new_users(lambda: known, lambda: built.append(1))
    for users in ([1], [1, 2]):
        spark.createDataFrame([(u,) for u in users], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.periodic(jobs.read_folder(spark, src, schema), each, str(tmp_path / "ck")).awaitTermination()
    assert built == [1]


def finished(spark, stream, out, state, mode="append"):
    jobs.into_folder(stream, str(out), str(state), mode).awaitTermination()
    return jobs.from_folder(spark, str(out), stream.schema, mode)


def test_memory_of_near_duplicates(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "seq long, source string, fp long"
    rows = [(0, "a", 0), (1, "a", 7), (2, "b", 7), (3, "a", -1), (4, "a", -2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    got = finished(spark, jobs.near_duplicate_memory(spark.readStream.schema(schema).parquet(src)), tmp_path / "out", tmp_path / "ck")
    assert {r.seq: r.status for r in got.collect()} == {0: "new", 1: "near_dup", 2: "new", 3: "new", 4: "near_dup"}


def test_restart_in_mid_stream_gives_the_batch_result(spark, tmp_path):
    import random

    rnd = random.Random(6)
    schema = "seq long, source string, fp long, url_hash string, content_hash string"
    base, rows, want, memory = [rnd.getrandbits(62) for _ in range(40)], [], {}, {}
    for seq in range(240):
        fp = rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(62), rnd.choice((0, 2, 9))))
        rows.append((seq, f"s{seq % 3}", fp, f"u{rnd.randrange(150)}", f"c{rnd.randrange(200)}"))
        last, urls, contents = memory.setdefault(rows[-1][1], ([], set(), set()))
        _, _, _, u, c = rows[-1]
        status = "duplicate" if u in urls or c in contents else "near_dup" if any((fp ^ x).bit_count() <= 5 for x in last[-50:]) else "new"
        if status == "new":
            last.append(fp)
            urls.add(u)
            contents.add(c)
        want[seq] = status
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for i in range(0, 240, 60):
        spark.createDataFrame(rows[i : i + 60], schema).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.near_duplicate_memory(jobs.read_folder(spark, src, schema))
    tries = []

    def failing(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")
        tries.append(number)
        if number == 2:
            raise RuntimeError("lost")

    with jobs.stateful(spark):
        query = stream.writeStream.foreachBatch(failing).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        raise AssertionError("the third batch fails")
    except Exception as e:
        assert "lost" in str(e)
    assert tries == [0, 1, 2]
    got = finished(spark, stream, out, state).collect()
    assert len(got) == 240 and {r.seq: r.status for r in got} == want and set(want.values()) == {"new", "duplicate", "near_dup"}


def test_interval_over_three_triggers_and_refused_bounds(spark, tmp_path):
    import pytest

    from tidefeed.sources.sinks import Versions

    table, now, ran = Versions(spark, str(tmp_path / "due")), dt.datetime(2024, 1, 1), []
    for hours in (0, 169):
        with pytest.raises(ValueError):
            jobs.Interval(table, hours)
    every = jobs.Interval(table, 6)

    def job():
        ran.append(1)
        if len(ran) == 2:
            raise RuntimeError
        return f"run {len(ran)}"

    hour = dt.timedelta(hours=1)
    assert every.remaining(now) is None
    assert [every.poll(now + h * hour, job) for h in (0, 5, 6, 7, 11)] == [False, False, True, False, False]
    assert every.remaining(now + 11 * hour) == 3600
    again = jobs.Interval(Versions(spark, str(tmp_path / "due")), 6)  # a restart
    assert not again.poll(now + 12 * hour, job, running=True) and not again.poll(now + 12 * hour, job)
    assert again.poll(now + 12.1 * hour, job) and again.state()["last_result"] == "failed: RuntimeError"
    assert again.poll(now + 19 * hour, job) and again.state()["run_count"] == 3 and again.state()["last_result"] == "run 3"
    off = jobs.Interval(table, 6, enabled=False)
    assert not off.poll(now + 99 * hour, job) and off.remaining(now) is None


def test_progress(spark, tmp_path):
    import time

    src, seen = str(tmp_path / "in"), jobs.Progress()
    for n in (3, 4):
        spark.range(n).toDF("user_id").coalesce(1).write.mode("append").parquet(src)
    spark.streams.addListener(seen)
    try:
        jobs.periodic(jobs.read_folder(spark, src, "user_id long"), lambda b, n: b.count(), str(tmp_path / "ck")).awaitTermination()
        until = time.time() + 20
        while not seen.ended and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    done = [b for b in seen.batches if b["rows"]]
    assert len(seen.ended) == 1 and [b["batch"] for b in done] == [0, 1] and {b["rows"] for b in done} <= {3, 4, 6, 7, 8}


def test_windows(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "created_at timestamp, event_type string"
    spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 5), "click") for h in (1, 1, 2)], schema).coalesce(1).write.parquet(src)
    q = jobs.event_windows(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("wins").collect()) == [1, 2]


def test_rebuild_after_crawl_and_no_overlap(spark, tmp_path):
    src, seen, schema = str(tmp_path / "in"), [], "user_id long"
    each = jobs.crawl_then_rebuild(lambda b, n: seen.append(("crawl", b.count())), lambda why: seen.append(why))
    spans = []

    def timed(batch, number):
        began = dt.datetime.now()
        each(batch, number)
        spans.append((began, dt.datetime.now()))

    for n in (1, 2):
        spark.range(n).toDF("user_id").coalesce(1).write.mode("append").parquet(src)
    jobs.periodic(jobs.read_folder(spark, src, schema), timed, str(tmp_path / "ck")).awaitTermination()
    assert [x if isinstance(x, str) else x[0] for x in seen] == ["crawl", "auto-after-crawl"] * 2 and sum(x[1] for x in seen if x[0] == "crawl") == 3
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    quiet = []
    jobs.crawl_then_rebuild(lambda b, n: quiet.append(n), lambda why: quiet.append(why), auto=False)(None, 7)
    assert quiet == [7]


def test_stream_into_folder(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "created_at timestamp, event_type string"
    spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 5), "click") for h in (1, 1, 2)], schema).coalesce(1).write.parquet(src)
    stream = jobs.event_windows(spark.readStream.schema(schema).parquet(src))
    assert sorted(r.n for r in finished(spark, stream, out, tmp_path / "ck", "complete").collect()) == [1, 2]
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 6), "click")], schema).coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.n for r in finished(spark, stream, out, tmp_path / "ck", "complete").collect()) == [1, 3]
