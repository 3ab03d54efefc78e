"""Operator 9: benchmark decontamination by greedy string tiling.

The test items' seeds (hashes of min_match words in a row) are joined with every text's; a text and an item whose shared seeds
can reach the coverage are tiled: the longest unmarked match is found by rolling hashes and marked, and so on while one of
min_match words is left. An item whose tiles cover at least `coverage` of its words contaminates the text, in whatever order
its passages come.

Items reach the executors in blocks of at most block_tokens words (a stated query set, in blocks, against all rows), eight
blocks at a time, so nothing that the driver holds or sends grows with the items; texts are read once a block and never
shuffled.

Defined cases: null text or item counts as empty; items of fewer than min_match words match nothing (so do texts); a very long
text is tiled whole, in memory of a few numbers a word, even if it repeats one word; repeated items count once each; of items
with equal coverage the smallest item_id is named; every row, with a null or repeated doc_id too, has its own verdict; extra
columns, whatever their names, are kept by clean() and not read; an empty table of items contaminates nothing; an empty
table of documents gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textkit import WordHasher, _tables, grams, slices

MIN_MATCH = 5
COVERAGE = 0.5


def _windows(prefix: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of `length` words that start at `at`, from the words' running sum."""
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[at + length] - prefix[at]) * down[at]


def _running(words: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(words) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])


@functools.lru_cache(maxsize=4)
def _tables_of(size: int):
    return _tables(size)


def _powers(n: int):
    return _tables_of(1 << max(12, n.bit_length()))


def _room(free: np.ndarray) -> np.ndarray:
    """For each seed, how many free seeds follow in a row, itself included."""
    taken = np.flatnonzero(~np.append(free, False))
    return taken[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))


def tiles(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of greedy string tiling's tiles over two arrays of word hashes, longest first.

    Each round finds the greatest length at which unmarked windows of both agree (by bisection over rolling hashes) and
    marks such windows in order of their start in the item, then in the text. Memory is that of the two arrays.
    """
    a, b = grams(item, min_match), grams(text, min_match)
    free_a, free_b = np.isin(a, b), np.isin(b, a)
    run_a, run_b = _running(item), _running(text)
    out: list[tuple[int, int, int]] = []
    limit = len(item)
    while True:
        room_a, room_b = _room(free_a), _room(free_b)
        most = min(limit, int(room_a.max(initial=0)) + min_match - 1, int(room_b.max(initial=0)) + min_match - 1)

        def shared(n: int):
            at_a, at_b = np.flatnonzero(room_a > n - min_match), np.flatnonzero(room_b > n - min_match)
            h_a, h_b = _windows(run_a, at_a, n), _windows(run_b, at_b, n)
            in_a, in_b = np.isin(h_a, h_b), np.isin(h_b, h_a)
            return at_a[in_a], h_a[in_a], at_b[in_b], h_b[in_b]

        low, found, n = min_match, None, most
        while low <= most:
            got = shared(n)
            if len(got[0]):
                found, low = (n, got), n + 1
            else:
                most = n - 1
            n = (low + most) // 2
        if found is None:
            return out
        n, (at_a, h_a, at_b, h_b) = found
        order = np.lexsort((at_b, h_b))
        sorted_b, places = h_b[order], at_b[order]
        first = {}
        taken_b = np.zeros(len(text) + 1, bool)
        end_a = 0
        for x, h in zip(at_a.tolist(), h_a.tolist()):
            if x < end_a:
                continue
            k = first.get(h)
            if k is None:
                k = int(np.searchsorted(sorted_b, np.uint64(h)))
            while k < len(places) and sorted_b[k] == h and taken_b[places[k] : places[k] + n].any():
                k += 1
            if k < len(places) and sorted_b[k] == h:
                y = int(places[k])
                out.append((x, y, n))
                taken_b[y : y + n] = True
                end_a = x + n
                free_a[max(0, x - min_match + 1) : x + n] = False
                free_b[max(0, y - min_match + 1) : y + n] = False
            first[h] = k
        limit = n - 1


class Seeds:
    """The items' seeds: which items have each, and how often."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int, coverage: float):
        self.hasher = WordHasher()
        self.ids, self.min_match, self.coverage = np.array([i for i, _ in items], np.int64), min_match, coverage
        words, at = self.hasher.words([t for _, t in items])
        self.tokens = [words[i:j] for i, j in zip(at[:-1], at[1:])]
        self.sizes = np.diff(at)
        grouped = [np.unique(grams(w, min_match), return_counts=True) for w in self.tokens]
        seed = np.concatenate([g for g, _ in grouped]) if grouped else np.zeros(0, np.uint64)
        whose, times = np.repeat(np.arange(len(items)), [len(g) for g, _ in grouped]), np.concatenate([c for _, c in grouped]) if grouped else np.zeros(0, np.int64)
        order = np.argsort(seed, kind="stable")
        self.whose, self.times = whose[order], times[order]
        self.key, first = np.unique(seed[order], return_index=True)
        self.begin = np.append(first, len(seed))
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.key >> np.uint64(42)] = True

    def candidates(self, words: np.ndarray, at: np.ndarray, most: int = 1 << 21):
        """(text, item) pairs whose shared seeds can reach the coverage. A tile of n words has n - min_match + 1 seeds, so it
        has at most min_match words for each. Repeated seeds of a text count once, and at most about `most` pairs are looked at in one go."""
        g = grams(words, self.min_match)  # seeds across two texts are dropped below
        hit = np.flatnonzero(self.sieve[g >> np.uint64(42)]) if len(self.key) else np.zeros(0, np.int64)
        place = np.searchsorted(self.key, g[hit])
        same = self.key[np.minimum(place, len(self.key) - 1)] == g[hit] if len(hit) else np.zeros(0, bool)
        hit, place = hit[same], place[same]
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + self.min_match <= at[row + 1]
        both = np.unique(row[inside] * len(self.key) + place[inside])
        row, place = both // max(1, len(self.key)), both % max(1, len(self.key))
        size = self.begin[place + 1] - self.begin[place]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        n_items = len(self.ids)
        for x, y in zip(first, np.append(first[1:], len(row))):
            weight = np.zeros(n_items, np.int64)
            cut = np.unique(np.concatenate([[x], x + np.flatnonzero(np.diff(np.cumsum(size[x:y]) // most)) + 1, [y]]))
            for i, j in zip(cut[:-1], cut[1:]):
                spread = np.repeat(self.begin[place[i:j]] - np.concatenate([[0], np.cumsum(size[i:j])[:-1]]), size[i:j]) + np.arange(size[i:j].sum())
                np.add.at(weight, self.whose[spread], self.times[spread])
            for item in np.flatnonzero((weight > 0) & (weight * self.min_match >= self.coverage * self.sizes)).tolist():
                yield int(row[x]), item


def _match(items: list[tuple[int, str | None]], min_match: int, coverage: float):
    def run(batches):
        seeds = Seeds(items, min_match, coverage)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best = [(0.0, None, 0)] * len(texts)
            words, at = seeds.hasher.words(texts)
            for r, i in seeds.candidates(words, at):
                share = sum(n for _, _, n in tiles(seeds.tokens[i], words[at[r] : at[r + 1]], min_match)) / int(seeds.sizes[i])
                if share >= coverage:
                    b, item = best[r], int(seeds.ids[i])
                    better = b[1] is None or (share, -item) > (b[0], -b[1])
                    best[r] = (share if better else b[0], item if better else b[1], b[2] + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*best) if best else [()] * 3, (pa.float64(), pa.int64(), pa.int64())))],
                names=["doc_id", "coverage", "item_id", "n_items"],
            )

    return run


def item_blocks(items: DataFrame, block_tokens: int):
    """The items, in lists of about block_tokens words."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    total = rows.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)))).first()[0] or 0
    n = max(1, -(-total // block_tokens))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else rows
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def _best(items: list[tuple[int, str | None]], min_match: int, coverage: float):
    """Rows with the verdict of the blocks before, to rows with that of these items as well."""
    match = _match(items, min_match, coverage)

    def run(batches):
        last = []

        def feed():
            for batch in slices(batches):
                last.append(batch)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])

        for found in match(feed()):
            batch = last.pop()
            both = [[r.column(c).to_pylist() for c in ("coverage", "item_id", "n_items")] for r in (batch, found)]
            rows = [(*(x[:2] if y[1] is None or x[1] is not None and (x[0], -x[1]) > (y[0], -y[1]) else y[:2]), x[2] + y[2]) for x, y in zip(zip(*both[0]), zip(*both[1]))]
            kept = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *kept], names=["doc_id", "text", "coverage", "item_id", "n_items"])

    return run


def _by_blocks(df: DataFrame, items: DataFrame, step, block_tokens: int, at_once: int = 8) -> DataFrame:
    """df after step(df, block) for every block of items; after at_once blocks the rows are written, so the driver never holds more of them."""
    for i, block in enumerate(item_blocks(items, block_tokens)):
        if i and i % at_once == 0:
            df = common.written(df, "blocks")
        df = step(df, block)
    return df


def contamination(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = 2_000_000) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, coverage (of the best item), item_id, n_items (that reach the coverage)."""
    schema = "doc_id long, text string, coverage double, item_id long, n_items long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_items"))
    out = _by_blocks(rows, items, lambda df, block: df.mapInArrow(_best(block, min_match, coverage), schema), block_tokens)
    return out.drop("text").withColumn("contaminated", F.col("item_id").isNotNull())


def _keep(items: list[tuple[int, str | None]], min_match: int, coverage: float):
    match = _match(items, min_match, coverage)

    def run(batches):
        def texts(batch):
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])

        last = []

        def feed():
            for batch in slices(batches):
                last.append(batch)
                yield texts(batch)

        for found in match(feed()):
            yield last.pop().filter(pa.array([i is None for i in found.column("item_id").to_pylist()], pa.bool_()))

    return run


def clean(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = 2_000_000) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    return _by_blocks(docs, items, lambda df, block: df.mapInArrow(_keep(block, min_match, coverage), docs.schema), block_tokens)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
