"""Fingerprints, exact and near-duplicate probes, and ingestion of crawled articles."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.session import cut

WINDOW, THRESHOLD = 50, 5


def simhash(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key (unique), fp (long). The narrow text is dealt by key once; tokens and the 64 votes follow in the same partition. Texts without tokens get 0."""
    words = df.select(key, text.alias("_t")).repartition(F.col(key)).select(key, X.simhash_words(F.col("_t")).alias("_w"))
    hashed = words.select(key, F.explode_outer(X.simhash_tokens(F.col("_w"))).alias("_t")).select(key, X.low_md5(F.col("_t")).alias("h"))
    # four bits of a hash, 16 apart, are counted in one long: there are at most 200 tokens, so lanes don't run over
    lanes = F.lit(0x0001000100010001)
    votes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(lanes)).alias(f"v{i}") for i in range(16)]
    counted = hashed.groupBy(key).agg(F.count("h").alias("n"), *votes)
    bits = F.lit(0).cast("long")
    for i in range(64):
        ones = F.shiftrightunsigned(f"v{i % 16}", i // 16 * 16).bitwiseAND(F.lit(0xFFFF))
        bits = bits.bitwiseOR(F.when(ones * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return counted.select(key, bits.alias("fp"))


def exact_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows marked `is_first`: the earliest of each key."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))  # partial minima before the shuffle: a hot key is one row a task
    return df.join(first, key).withColumn("is_first", F.col(order) == F.col("_first")).drop("_first")


def _block_masks(blocks: int) -> list[int]:
    """64 bits as masks of `blocks` neighbouring runs, as even as they come."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << j) - 1) ^ ((1 << i) - 1) for i, j in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def best_blocks(n: int, bits: int = THRESHOLD) -> int:
    """The number of blocks at which n random fingerprints make the fewest rows and pairs: more blocks are more keys, but longer ones."""

    def cost(blocks: int) -> float:
        keys = comb(blocks, blocks - bits)
        return keys * n + keys * n * n / 2 / 2.0 ** (64 * (blocks - bits) / blocks)

    return min(range(bits + 1, bits + 6), key=cost)


def near_pairs(prints: DataFrame, bits: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """All pairs a < b of ids whose fingerprints differ in at most `bits` bits.

    Of `blocks` blocks of bits such a pair agrees in all but `bits` at least, so rows are joined on every choice of that many blocks,
    never all rows; a pair is kept at the choice of its first agreeing blocks. More blocks make longer keys: 6 give 11 bits, 8 give
    24. Unset, the number is chosen by the number of rows. Keys are many times the rows, which estimates of their size miss: neither
    side may be broadcast.
    """
    blocks = blocks or best_blocks(prints.count(), bits)
    masks, size = _block_masks(blocks), blocks - bits
    choices = list(combinations(range(blocks), size))

    def part(choice: tuple) -> Column:
        mask = 0
        for i in choice:
            mask |= masks[i]
        return F.col("fp").bitwiseAND(F.lit(mask))

    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), part(c).alias("v")) for k, c in enumerate(choices)])).alias("b")
    keyed = prints.select("id", "fp", keys).select("id", "fp", F.col("b.k").alias("k"), F.col("b.v").alias("v"))
    l, r = keyed.alias("l"), keyed.alias("r")
    same = (F.col("l.k") == F.col("r.k")) & (F.col("l.v") == F.col("r.v")) & (F.col("l.id") < F.col("r.id"))
    near = l.hint("merge").join(r.hint("merge"), same).where(X.hamming(F.col("l.fp"), F.col("r.fp")) <= bits)
    diff = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    agree = F.filter(F.array(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)]), lambda x: x.isNotNull())
    own = F.element_at(F.array(*[F.array(*[F.lit(i) for i in c]) for c in choices]), F.col("l.k") + 1)
    first = F.slice(agree, 1, size) == own
    return near.where(first).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), X.hamming(F.col("l.fp"), F.col("r.fp")).cast("long").alias("distance"))


def near_classes(prints: DataFrame, bits: int = THRESHOLD) -> DataFrame:
    """id, class_id (the smallest id with the same fingerprint), n_links (how many other rows lie within `bits` bits): near_pairs told
    by rows. Rows of equal fingerprints are one class with a count, so copies don't yield their pairs. Classes may be as many as rows:
    they aren't broadcast."""
    prints = cut(prints.select("id", "fp"))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("n")))
    pairs = near_pairs(classes.select(F.col("class_id").alias("id"), "fp"), bits)
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    links = both.join(classes.select(F.col("class_id").alias("b"), "n").hint("merge"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("_near"))
    counted = classes.join(links.hint("merge"), "class_id", "left").select("fp", "class_id", (F.col("n") - 1 + F.coalesce("_near", F.lit(0))).alias("n_links"))
    return prints.join(counted.hint("merge"), "fp").select("id", "class_id", "n_links")


def validity(title: Column, url: Column) -> Column:
    """The reason why a raw article is invalid, null if it isn't."""
    return F.when(X.strip(F.coalesce(title, F.lit(""))) == "", "judul kosong").when(X.strip(F.coalesce(url, F.lit(""))) == "", "url kosong").when(~X.strip(url).startswith("http"), "url tidak valid")


def fingerprinted(raw: DataFrame) -> DataFrame:
    """raw (seq, title, url, excerpt, source) with url_hash, content_hash, fp."""
    hashed = raw.withColumn("url_hash", X.url_hash(F.col("url"))).withColumn("content_hash", X.content_hash(F.col("title"), F.col("excerpt")))
    return hashed.join(simhash(raw, "seq", F.concat_ws(" ", X.strip(F.coalesce("title", F.lit(""))), X.strip(F.coalesce("excerpt", F.lit(""))))), "seq")


def judged(fp: np.ndarray, last: list[int], block: int = 512) -> tuple[np.ndarray, list[int]]:
    """Of one source's fingerprints in order, which lie within THRESHOLD bits of one of the last WINDOW accepted before them (`last`
    came before all), and the last accepted ones after. Distances are computed a block at a time; only rows that have
    neighbours are then looked at one by one."""
    known = np.concatenate([np.array(last, np.int64), fp]).view(np.uint64)
    begin = len(last)
    accepted = np.ones(len(known), bool)
    kept = list(range(begin))
    for i in range(0, len(fp), block):
        j = min(i + block, len(fp))
        mine = known[begin + i : begin + j]
        row, other = np.nonzero(np.bitwise_count(mine[:, None] ^ known[None, : begin + j]) <= THRESHOLD)
        before = other < row + begin + i
        row, other = row[before], other[before]
        edge = np.searchsorted(row, np.arange(j - i + 1)).tolist()
        for k in range(j - i):
            if edge[k] < edge[k + 1]:
                near = other[edge[k] : edge[k + 1]]
                low = kept[-WINDOW] if len(kept) >= WINDOW else 0
                if (accepted[near] & (near >= low)).any():
                    accepted[begin + i + k] = False
                    continue
            kept.append(begin + i + k)
    return ~accepted[begin:], known[kept[-WINDOW:]].view(np.int64).tolist()


_JUDGED = "range int, seq long, open boolean, near boolean, source string, last array<long>"


def _judge_range(rows: pa.Table, states: pa.Table) -> pa.Table:
    """Statuses of a range's rows, and the last fingerprints that it accepted of each of its sources (rows without seq)."""
    rows = rows.sort_by("seq")
    came = dict(zip(states.column("source").to_pylist(), states.column("last").to_pylist()))
    source = rows.column("source").combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(source, pa.ChunkedArray):
        source = source.combine_chunks()
    code, fp, is_open = source.indices.to_numpy(zero_copy_only=False), rows.column("fp").to_numpy(), rows.column("open").to_numpy()
    near, ends = np.zeros(len(code), bool), []
    for c, name in enumerate(source.dictionary.to_pylist()):
        mine = np.flatnonzero((code == c) & is_open)
        near[mine], _ = judged(fp[mine], came.get(name) or [])
        ends.append((name, fp[mine][~near[mine]][-WINDOW:].tolist()))
    n, number = len(ends), rows.column("range")[0].as_py() if rows.num_rows else None
    schema = pa.schema([("range", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()), ("near", pa.bool_()), ("source", pa.string()), ("last", pa.list_(pa.int64()))])
    m = rows.num_rows
    status = [rows.column("range"), rows.column("seq"), rows.column("open"), pa.array(near), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int64()))]
    state = [pa.array([number] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), pa.array([e[0] for e in ends], pa.string()), pa.array([e[1] for e in ends], pa.list_(pa.int64()))]
    return pa.concat_tables([pa.Table.from_arrays(c, schema=schema) for c in (status, state)])


def _contested(rows: DataFrame) -> DataFrame:
    """key, seq, range of valid rows whose address or content another valid row has too: only these can ever be copies."""
    keys = F.explode(F.array(F.concat(F.lit("u"), "url_hash"), F.concat(F.lit("c"), "content_hash"))).alias("key")
    keyed = rows.where("valid").select(keys, "seq", "range")
    shared = keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    return keyed.join(shared, "key")


def _copies(accepted: DataFrame, contested: DataFrame) -> DataFrame:
    """seq, range, copy of the contested rows: whether an accepted row before has the same key."""
    first = accepted.groupBy("key").agg(F.min("seq").alias("first"))
    seen = contested.join(first, "key", "left").groupBy("seq", "range")
    return seen.agg(F.max(F.coalesce(F.col("first") < F.col("seq"), F.lit(False))).alias("copy"))


def _handed(states: DataFrame) -> DataFrame:
    """range, source, last: the last WINDOW fingerprints that ranges before have accepted of the source. Each of the WINDOW ranges before
    that accepted any gave one at least, so no more of them are looked at."""
    follow = Window.partitionBy("source").orderBy("range")
    filled = states.where(F.size("last") > 0).select("range", "source", F.flatten(F.collect_list("last").over(follow.rowsBetween(1 - WINDOW, 0))).alias("_all"))
    filled = filled.select("range", "source", F.slice("_all", F.greatest(F.size("_all") - WINDOW + 1, F.lit(1)), WINDOW).alias("_then"))
    none = states.where(F.size("last") == 0).select("range", "source", F.lit(None).cast("array<long>").alias("_then"))
    before = follow.rowsBetween(Window.unboundedPreceding, -1)
    return filled.unionByName(none).select("range", "source", F.last("_then", True).over(before).alias("last"))


def ingest(raw: DataFrame, block: int = 4096, report: list | None = None) -> DataFrame:
    """seq, status, reason of raw rows taken in in order of seq, each judged against the accepted rows before it only.

    A row is a duplicate if an accepted one has its address or its content (over all sources), and a near-duplicate if one of
    the last WINDOW accepted of its source is within THRESHOLD bits. Rows are cut into ranges of some `block` in order of seq,
    whatever their source, and ranges are judged in parallel: each takes the last accepted fingerprints of its sources from
    the range before, as the round before left them, and its copies from the accepted rows that share a key. Only ranges for
    which either has changed are judged again. The first range is right after the first round and any other as soon as all
    before it are, so the rounds end, at the result of going row by row. Usually few ranges remain after two rounds: what a
    range hands on seldom depends on what it got, since 50 accepted rows cover it.
    """
    rows = fingerprinted(raw).withColumn("reason", validity(F.col("title"), F.col("url")))
    rows = cut(rows.select("seq", "source", "url_hash", "content_hash", "fp", "reason", F.col("reason").isNull().alias("valid")))
    parts = max(1, -(-rows.count() // block))
    ranged = cut(rows.select("seq", "source", "fp", "valid", "url_hash", "content_hash").repartitionByRange(parts, "seq").withColumn("range", F.spark_partition_id()))
    contested = cut(_contested(ranged))
    copies = cut(_copies(contested, contested))
    work = ranged.select("range", "seq", "source", "fp", "valid")
    entered = raw.sparkSession.createDataFrame([], "range int, source string, last array<long>")
    active, rounds, latest = cut(work.select("range").distinct()), [], None
    while True:
        if report is not None:
            report.append(active.count())
        asked = work.join(active, "range").join(copies.select("seq", "copy"), "seq", "left")
        asked = asked.select("range", "seq", "source", "fp", (F.col("valid") & ~F.coalesce("copy", F.lit(False))).alias("open"))
        given = entered.join(active, "range")
        out = cut(asked.groupBy("range").cogroup(given.groupBy("range")).applyInArrow(_judge_range, _JUDGED))
        rounds.append(out)
        number = F.lit(len(rounds)).alias("round")
        judged_in = active.select("range", number)
        latest = judged_in if latest is None else latest.unionByName(judged_in)
        latest = cut(latest.groupBy("range").agg(F.max("round").alias("round")))
        now = _latest(rounds, latest)
        taken = now.where("seq is not null and open and not near").select("seq")
        again = cut(_copies(contested.join(taken, "seq", "left_semi"), contested))
        moved = again.join(copies.select("seq", F.col("copy").alias("_was")), "seq").where("copy <> _was").select("range")
        handed = cut(_handed(now.where("seq is null").select("range", "source", "last")))
        was = entered.select("range", "source", F.col("last").alias("_was"))
        same = handed.alias("h").join(was.alias("w"), (F.col("h.range") == F.col("w.range")) & F.col("h.source").eqNullSafe(F.col("w.source")), "left")
        changed = same.where(~F.coalesce("last", F.array().cast("array<long>")).eqNullSafe(F.coalesce("_was", F.array().cast("array<long>")))).select("h.range")
        active, copies, entered = cut(moved.unionByName(changed).distinct()), again, handed
        if active.isEmpty():
            break
    status = F.when(F.col("reason").isNotNull(), "invalid").when(~F.col("open"), "duplicate").when(F.col("near"), "near_dup").otherwise("new")
    return rows.select("seq", "reason").join(now.where("seq is not null").select("seq", "open", "near"), "seq").select("seq", status.alias("status"), "reason")


def _latest(rounds: list[DataFrame], latest: DataFrame) -> DataFrame:
    """Of each range what the last round that judged it found."""
    if len(rounds) == 1:
        return rounds[0]
    every = None
    for i, out in enumerate(rounds, 1):
        one = out.withColumn("round", F.lit(i))
        every = one if every is None else every.unionByName(one)
    return every.join(latest, ["range", "round"]).drop("round")


def status_counts(statuses: DataFrame) -> DataFrame:
    names = ("new", "duplicate", "near_dup", "invalid", "error")
    return statuses.agg(*[F.count(F.when(F.col("status") == n, 1)).alias(n) for n in names])
