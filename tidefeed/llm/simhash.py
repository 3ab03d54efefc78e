"""Operator 4: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most `bits` bits differ in at most t_i bits in some partition i of the 64, whenever the
partitions' t_i + 1 add up to bits + 1. Correlated bits are grouped into partitions and a dynamic program gives each
partition its own t_i (-1: not probed) at the least estimated work, number of partitions included. Both are fitted on a
bounded sample of fingerprints (sample, by order of a hash) and only affect speed: every fingerprint is indexed under its value,
probes all values within t_i, and each candidate is verified on all 64 bits, so no link is lost.

Only distinct fingerprints are compared, and only a spanning forest of a bucket's links is kept: the links of one
bucket never grow with the square of its size. A bucket of over hot_rows rows is first split by the plain pigeonhole
principle on all bits (bits + 1 interleaved blocks), which keeps every link. Components come from links that tasks contract, then
from alternating stars.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; a very long text
votes with all its shingles, 65,536 at a time; a bit that is set in exactly half of them (a tie) is 0; equal fingerprints are
linked; null doc_ids take part and lose to any other id (a component of only such rows has a null component_id); rows that
repeat a doc_id are marked each; extra columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected
from .textkit import slices

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        if len(words) < shingle:
            parts = [b" ".join(words)]
        else:
            parts = map(b" ".join, zip(*[words[at + k : to + k] for k in range(shingle)]))
        h = np.fromiter((digest(p, SEED) for p in parts), np.uint64, to - at)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return run


def _ball(width: int, radius: int) -> int:
    size, term = 1, 1
    for k in range(1, radius + 1):
        term = term * (width - k + 1) // k
        size += term
    return size if radius >= 0 else 0


def plan(sample: np.ndarray, total: int, bits: int = 3, pair: float = 0.05, share: float = 1.0) -> list[tuple[list[int], int]]:
    """[(bits of a partition, its threshold)] with the least estimated work over `total` fingerprints: signatures, and candidates at `pair` of a signature's work. No partition's ball covers over `share` of its values."""
    sample = np.unique(sample)
    on = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    if len(sample) > 1:
        centred = on - on.mean(0)
        norm = np.sqrt((centred**2).sum(0)) + 1e-9
        related = np.abs(centred.T @ centred / np.outer(norm, norm))
    else:
        related = np.zeros((64, 64))
    few = sample[:1500]
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, bits + 2):
        free, parts = set(range(64)), []
        for i in range(m):
            width = 64 // m + (i < 64 % m)
            part = [max(free, key=lambda b: (related[b].sum(), -b))]
            free.discard(part[0])
            while len(part) < width:
                nxt = max(free, key=lambda b: (related[b][part].sum(), -b))
                part.append(nxt)
                free.discard(nxt)
            parts.append(sorted(part))
        cost = np.full((m, bits + 2), np.inf)  # by threshold + 1
        for i, part in enumerate(parts):
            mask = np.uint64(sum(1 << b for b in part))
            apart = np.bitwise_count((few[:300, None] ^ few[None, :]) & mask).ravel()
            near = np.cumsum(np.bincount(apart, minlength=bits + 1)[: bits + 1]) - min(300, len(few))
            pairs = max(1, min(300, len(few))) * max(1, len(few) - 1)
            cost[i, 0] = 0
            for t in range(bits + 1):
                chance = max(near[t] / pairs, _ball(len(part), t) / 2.0 ** len(part))
                if _ball(len(part), t) > share * 2 ** len(part):
                    break
                cost[i, t + 1] = total * _ball(len(part), t) + 0.5 * chance * float(total) ** 2 * pair
        table = np.full((m + 1, bits + 2), np.inf)  # least cost of the first i partitions with sum(threshold + 1) = s
        table[0, 0] = 0
        choice = np.zeros((m + 1, bits + 2), int)
        for i in range(m):
            for s in range(bits + 2):
                for c in range(s + 1):
                    if table[i, s - c] + cost[i, c] < table[i + 1, s]:
                        table[i + 1, s], choice[i + 1, s] = table[i, s - c] + cost[i, c], c
        if table[m, bits + 1] < best[0]:
            s, chosen = bits + 1, []
            for i in range(m, 0, -1):
                chosen.append((parts[i - 1], int(choice[i, s]) - 1))
                s -= choice[i, s]
            best = (table[m, bits + 1], [(p, t) for p, t in reversed(chosen) if t >= 0])
    return best[1]


def _flips(part: list[int], radius: int) -> np.ndarray:
    """All masks over the partition's bits with at most radius bits set; the first is 0."""
    masks, level = [0], [(0, -1)]
    for _ in range(radius):
        level = [(m | 1 << part[j], j) for m, i in level for j in range(i + 1, len(part))]
        masks += [m for m, _ in level]
    return np.array(masks, np.uint64)


def _signatures(parts: list[tuple[list[int], int]]):
    """For each fingerprint and partition, a row to index it and rows to probe (probe: true)."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i, (part, radius) in enumerate(parts):
                mask = np.uint64(sum(1 << b for b in part))
                for flip in _flips(part, radius):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), i, np.int32)), pa.array(((fp & mask) ^ flip).view(np.int64)), pa.array(np.full(len(fp), flip != 0)), pa.array(fp.view(np.int64))],
                        names=["part", "key", "probe", "fp"],
                    )

    return run


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within one bucket: each found fingerprint is compared with those not yet found."""
    left, a, b = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _verify(bits: int, small: int = 32):
    """Rows sorted by (part, key, sub) within the partition, to links. Buckets of up to `small` rows are compared by array shifts, all buckets at once."""

    def links(bucket: np.ndarray, fp: np.ndarray):
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        size = np.diff(edge)
        of = np.repeat(size, size)
        a, b = [], []
        few = np.flatnonzero(of <= small)
        f, k = fp[few], bucket[few]
        for d in range(1, min(small, len(f))):
            same = k[d:] == k[:-d]
            if not same.any():
                break
            near = same & (np.bitwise_count(f[d:] ^ f[:-d]) <= bits)
            a.append(f[:-d][near])
            b.append(f[d:][near])
        for i in np.flatnonzero(size > small):
            x, y = _forest(np.unique(fp[edge[i] : edge[i + 1]]), bits)
            a.append(x)
            b.append(y)
        empty = np.zeros(0, np.uint64)
        x, y = (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)
        differ = x != y
        return pa.RecordBatch.from_arrays([pa.array(x[differ].view(np.int64)), pa.array(y[differ].view(np.int64))], names=["a", "b"])

    def run(batches):
        carry = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            carry = t
            if t.num_rows < 200_000:
                continue
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h == h[-1], True))  # the last bucket may go on
            if cut:
                yield links(h[:cut], t.column("fp").to_numpy()[:cut].view(np.uint64))
                carry = t.slice(cut)
        if carry is not None and carry.num_rows:
            yield links(carry.column("h").to_numpy(), carry.column("fp").to_numpy().view(np.uint64))

    return run


def links(prints: DataFrame, bits: int = 3, sample: int = 4000, hot_rows: int = 20000) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, distinct) of at most `bits` bits that connect all that are connected."""
    total = prints.count()
    chosen = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64).view(np.uint64)
    parts = plan(chosen, total, bits)
    signed = prints.mapInArrow(_signatures(parts), "part int, key long, probe boolean, fp long")
    crowded = common.written(signed.groupBy("part", "key").count().where(F.col("count") > hot_rows).select("part", "key"), "crowded")
    plain = F.lit(0).cast("long")
    if crowded.count():  # at most signatures / hot_rows rows; joined as Spark finds best by their size
        blocks = [sum(1 << b for b in range(j, 64, bits + 1)) for j in range(bits + 1)]
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in blocks]
        marked = signed.join(crowded.withColumn("_hot", F.lit(True)), ["part", "key"], "left")
        subs = F.when(F.col("_hot"), F.array(*[F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(m))) for j, m in enumerate(masks)])).otherwise(F.array(plain))
        signed = marked.withColumn("sub", F.explode(subs))
    else:
        signed = signed.withColumn("sub", plain)
    keyed = signed.select(F.xxhash64("part", "key", "sub").alias("h"), "fp")  # buckets that share a hash are verified like any other
    return keyed.repartition(F.col("h")).sortWithinPartitions("h", "fp").mapInArrow(_verify(bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (smallest doc_id of the component), component_size."""
    rows = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "prints")
    total = rows.count()
    prints = common.written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    roots = common.written(connected(links(prints.select("fp"), bits)), "roots")
    grouped = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    groups = common.written(grouped.select("fp", "root", "n").join(by_root, "root").drop("root"), "groups")
    out = common.join_groups(rows, groups, "fp", "n", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir)).drop("component_size")
