"""Operator 1: language-model scoring with a hierarchical Pitman-Yor model.

Words are customers of the restaurant of their context, the preceding word's hash class (2**18 classes, so that what one
sweep shares has a fixed size); a table opened there is a customer of the parent that all contexts share; its tables
come from the uniform distribution over the training vocabulary and one unknown word. Seating is sampled by Gibbs: customers are
taken out and seated again at a table in proportion to its size less the discount, or at a new one in proportion to
(strength + discount * tables) * the parent's probability. Predictive probabilities are averaged over the samples of the last
sweeps, and a text's score is the sum of their log10.

How it runs: texts become batches of word hashes, written once to the shared folder. Each batch sends its distinct (word,
context) pairs with their training counts to shards of words, merging fan_in (128) batches at a time in a tree, so a word that is a
third of all tokens meets a bounded number of rows. A shard holds all of its words' restaurants' counts, so a sweep is one pass
over the shards; between sweeps only the contexts' table totals (2 * 2**18 numbers, whatever the corpus) are summed and sent
out again (shards sample in parallel given the last totals). Sampling is seeded by shard and sweep, so a lost task repeats exactly
what it did. Answers go down the same tree to the batches, which score all their texts.

A Gibbs step takes out all customers of a word in a restaurant and draws their number of tables from its exact conditional, so a
sweep depends on the one before by its totals alone; the law is the same for every number of customers.

Defined cases: null text counts as empty, its only token is the end; words that training lacks take the unknown word's
probability; a very long text may be a batch of its own, hashed a piece at a time; rows that repeat are scored each (and learnt
from each); ties don't arise (nothing is ranked); without training tokens every probability is that of the uniform
distribution over the unknown word alone; a null doc_id is in the fold of the empty text; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textkit import WordHasher, mix64, slices

CLASSES = 1 << 18
END, BEGIN = np.uint64(0x5E0F7E57), np.uint64(0xBE61)  # not hashes of words but as good
EXACT = 2048
BLOCKS = 64


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes; integers in the fewest bytes that hold them."""
    head, body = [], []
    for name, a in arrays.items():
        if a.dtype.kind in "iu":
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        head.append([name, a.dtype.str, len(a)])
        body.append(np.ascontiguousarray(a).tobytes())
    text = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(text).to_bytes(4, "little") + text + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, n in json.loads(raw[4:at]):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    return out


def context_class(h: np.ndarray) -> np.ndarray:
    return (mix64(h) & np.uint64(CLASSES - 1)).astype(np.int64)


def _halves(context: np.ndarray) -> dict[str, np.ndarray]:
    """Context classes as their low 16 bits and the rest, which pack() keeps in two bytes and one."""
    return {"low": context & 0xFFFF, "high": context >> 16}


def _whole(m: dict) -> np.ndarray:
    return m["low"].astype(np.int64) + (m["high"].astype(np.int64) << 16)


def _batches(batch_tokens: int):
    """Documents to batches: ids, whether held out, lengths, the sorted distinct hashes and every token's place among them."""

    def run(rows):
        hasher, kept, size, count = WordHasher(), [], 0, 0

        def emit():
            nonlocal count
            ids = [i for k in kept for i in k[0]]
            held, lens = np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept])
            vocab, tokens = np.unique(np.concatenate([k[3] for k in kept]), return_inverse=True)
            kept.clear()
            count += 1
            docs = pack(ids=np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64), null=np.array([i is None for i in ids], np.uint8), held=held, lens=lens)
            key = ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 24) + count
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([docs], pa.binary()), pa.array([vocab.tobytes()], pa.binary()), pa.array([pack(tokens=tokens)], pa.binary())], names=["src", "docs", "vocab", "tokens"])

        for batch in slices(rows):
            words, at = hasher.words(batch.column("text").to_pylist())
            tokens = np.insert(words, at[1:], END)
            kept.append((batch.column("doc_id").to_pylist(), batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(at) + 1, tokens))
            size += len(tokens)
            if size >= batch_tokens:
                yield emit()
                size = 0
        if kept:
            yield emit()

    return run


def _pairs(docs: dict, vocab: np.ndarray, tokens: np.ndarray):
    """Distinct (word place * CLASSES + context class) of a batch, each token's place among them, which tokens train."""
    lens = docs["lens"].astype(np.int64)
    classes = context_class(vocab)
    context = np.empty(len(tokens), np.int64)
    context[1:] = classes[tokens[:-1]]
    context[np.cumsum(lens) - lens] = context_class(np.array([BEGIN]))[0]
    keys, place = np.unique(tokens.astype(np.int64) * CLASSES + context, return_inverse=True)
    return keys, place, np.repeat(docs["held"] == 0, lens)


def _slices(vocab: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes: where each begins and ends in the sorted vocabulary."""
    bounds = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(vocab, bounds), [len(vocab)]])


def _messages(shards: int):
    def run(batches):
        for batch in batches:
            for src, docs, vocab, tokens in zip(*(batch.column(c).to_pylist() for c in ("src", "docs", "vocab", "tokens"))):
                docs, vocab, tokens = unpack(docs), np.frombuffer(vocab, np.uint64), unpack(tokens)["tokens"].astype(np.int64)
                keys, place, train = _pairs(docs, vocab, tokens)
                counts = np.bincount(place, train, len(keys)).astype(np.int64)
                at = _slices(vocab, shards)
                cut = np.searchsorted(keys, at * CLASSES)
                rows = [(k, pack(words=vocab[at[k] : at[k + 1]], n=np.bincount(keys[cut[k] : cut[k + 1]] // CLASSES - at[k], minlength=at[k + 1] - at[k]), **_halves(keys[cut[k] : cut[k + 1]] % CLASSES), count=counts[cut[k] : cut[k + 1]])) for k in range(shards) if at[k] < at[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([src] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "src", "message"])

    return run


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Messages of one shard and group to one; members: which of its words and pairs each sender has."""
    srcs = table.column("src").to_pylist()
    parts = [unpack(m) for m in table.column("message").to_pylist()]
    order = np.argsort(srcs, kind="stable")
    words = np.unique(np.concatenate([p["words"] for p in parts]))
    own, keys = [], []
    for p in parts:
        at = np.searchsorted(words, p["words"])
        own.append(at)
        keys.append(np.repeat(at, p["n"].astype(np.int64)) * CLASSES + _whole(p))
    union, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, np.concatenate([p["count"] for p in parts]), len(union)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    members = [pack(src=np.array([srcs[i]], np.uint64), words=np.diff(own[i], prepend=0), pairs=np.diff(place[ends[i] - len(keys[i]) : ends[i]], prepend=0)) for i in order]
    message = pack(words=words, n=np.bincount(union // CLASSES, minlength=len(words)), **_halves(union % CLASSES), count=count)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "src": pa.array([key[1].as_py()], pa.int64()), "message": pa.array([message], pa.binary()), "members": pa.array([members], pa.list_(pa.binary()))})


@functools.lru_cache(maxsize=4)
def stirling(discount: float, most: int = EXACT) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers S(c, 1..c) for c up to `most`: the ways to seat c customers at t tables."""
    out = [np.zeros(0), np.zeros(1)]
    for n in range(1, most):
        row = np.full(n + 1, -np.inf)
        row[1:] = out[n]
        t = np.arange(1, n + 1)
        row[:n] = np.logaddexp(row[:n], out[n] + np.log(n - discount * t))
        out.append(row)
    return out


def _few(c: np.ndarray, t: np.ndarray, discount: float, terms: int = 30) -> np.ndarray:
    """The same logarithms for t far below c**discount: the sum over j of (-1)^j binom(t, j) (-j d)(1 - j d)...(c - 1 - j d), scaled by its first term."""
    binom, total, base = np.ones(t.shape), np.zeros(t.shape), gammaln(c - discount)
    for j in range(1, terms + 1):
        binom = binom * np.maximum(t - j + 1, 0) / j
        total += binom * (-1.0) ** (j + 1) * np.exp(gammaln(c - j * discount) - base + float(gammaln(j * discount + 1))) * np.sin(np.pi * j * discount) / np.pi
    return base + np.log(np.maximum(total, 1e-300)) - t * np.log(discount) - gammaln(t + 1)


def _saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same logarithms by the saddle point of their generating function f(x)^t, f(x) = (1 - (1 - x)^d) / d."""
    low, high = np.full(t.shape, -300.0), np.full(t.shape, 0.0)  # log(1 - x); x f'/f goes from 1 to infinity as x goes to 1
    for _ in range(45):
        y = (low + high) / 2
        over = -np.expm1(y) * np.exp((discount - 1) * y) * discount / np.maximum(-np.expm1(discount * y), 1e-300) > c / t
        low, high = np.where(over, y, low), np.where(over, high, y)
    y = (low + high) / 2
    x, f = -np.expm1(y), np.maximum(-np.expm1(discount * y), 1e-300) / discount
    ratio = c / t
    spread = np.maximum(ratio * (1 + (1 - discount) * x * np.exp(-y) - ratio), 1e-12)
    out = gammaln(c + 1) - gammaln(t + 1) + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * spread)
    return np.where(t >= c, 0.0, out)


def _great(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """stirling(discount)[c][t - 1] for c beyond the table."""
    few = t * 4 <= c**discount
    out = np.empty(t.shape)
    for at, law in ((few, _few), (~few, _saddle)):
        if at.any():
            out[at] = law(c[at], t[at], discount)
    return out


def gammaln(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift to at least 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    while (small := x < 10).any():
        shift = shift - np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _drawn(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A place in each row with probability in proportion to exp(logs)."""
    total = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return (total < rng.random(len(logs))[:, None] * total[:, -1:]).sum(axis=1)


def seat(count: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each pair of `count` customers (>= 1) where a new table has weight `mass`: a Gibbs step that takes all of a
    pair's customers out and seats them again at once. The number of tables then has probability in proportion to mass**t * S(count, t).

    One law for every count: S is tabulated up to EXACT customers and summed or approximated by saddle point beyond (within 2 % of the expected tables).
    """
    tables = np.ones(len(count), np.int64)
    logm = np.log(np.maximum(mass, 1e-300))
    known = stirling(discount)
    order = np.argsort(count, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(count[order]) != 0, [True]])) if len(count) else np.zeros(1, np.int64)
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
        c = int(count[order[i]])
        if c == 1:
            continue
        if c > EXACT:
            break
        step = max(1, 2_000_000 // c)
        for k in range(i, j, step):
            at = order[k : min(j, k + step)]
            tables[at] = 1 + _drawn(known[c][None, :] + logm[at][:, None] * np.arange(1, c + 1), rng)
    far = np.flatnonzero(count > EXACT)
    for k in range(0, len(far), 1000):
        at = far[k : k + 1000]
        c, m = count[at].astype(float), np.exp(logm[at])
        low, high = np.full(len(at), -300.0), np.zeros(len(at))
        for _ in range(60):  # the mode: there mass * x f'(x) = c
            y = (low + high) / 2
            over = np.log(m) + np.log(-np.expm1(np.minimum(y, -1e-12))) + (discount - 1) * y > np.log(c)
            low, high = np.where(over, y, low), np.where(over, high, y)
        mode = np.clip(m * -np.expm1(discount * (low + high) / 2) / discount, 1, c)
        first = np.maximum(1, np.floor(mode - 8 * np.sqrt(mode) - 8))
        last = np.minimum(c, np.ceil(mode + 8 * np.sqrt(mode) + 8))
        wide = np.maximum(1, np.ceil((last - first + 1) / 96))
        grid = first[:, None] + np.arange(96) * wide[:, None]
        inside = grid <= last[:, None]
        logs = np.where(inside, _great(np.broadcast_to(c[:, None], grid.shape), np.where(inside, grid, 1), discount) + np.log(m)[:, None] * grid, -np.inf)
        tables[at] = np.minimum(grid[np.arange(len(at)), _drawn(logs, rng)] + np.floor(rng.random(len(at)) * wide), c)
    return tables


def parent(g: dict, sums: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The parent's probability of words with so many customers and tables there."""
    fresh = (g["strength"] + g["root_discount"] * sums[-1]) / (g["vocabulary"] + 1)
    return (customers - g["root_discount"] * tables + fresh) / (g["strength"] + sums[-2])


class Restaurants:
    """The counts of one shard, and its chain of samples, which repeats exactly."""

    def __init__(self, shard: int, message: bytes):
        m = unpack(message)
        self.shard, self.words, self.n = shard, m["words"], m["n"].astype(np.int64)
        self.context, self.count = _whole(m), m["count"].astype(np.int64)
        self.of = np.repeat(np.arange(len(self.words)), self.n)
        self.word_count = np.bincount(self.of, self.count, len(self.words)).astype(np.int64)
        self.tables = (self.count > 0).astype(np.int64)
        self.root = (self.word_count > 0).astype(np.int64)

    def totals(self) -> np.ndarray:
        """Tables by context, then customers and tables of the parent."""
        by = np.bincount(self.context, self.tables, CLASSES)
        return np.concatenate([by, [self.tables.sum(), self.root.sum()]])

    def parent(self, g: dict, sums: np.ndarray) -> np.ndarray:
        """The parent's probability of each word, given the totals."""
        return parent(g, sums, np.bincount(self.of, self.tables, len(self.words)), self.root)

    def sweep(self, number: int, g: dict, sums: np.ndarray) -> None:
        rng = np.random.default_rng([g["seed"], self.shard, number])
        p = self.parent(g, sums)
        more = np.flatnonzero(self.count > 1)
        mass = (g["strength"] + g["discount"] * sums[self.context[more]]) * p[self.of[more]]
        self.tables[more] = seat(self.count[more], mass, g["discount"], rng)
        customers = np.bincount(self.of, self.tables, len(self.words)).astype(np.int64)
        some = np.flatnonzero(customers > 0)
        fresh = (g["strength"] + g["root_discount"] * sums[-1]) / (g["vocabulary"] + 1)
        self.root[some] = seat(customers[some], np.full(len(some), fresh), g["root_discount"], rng)


def _sum_rows(values: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(values, BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([pack(v=p.astype(np.int64)) for p in parts], pa.binary())], names=["block", "values"])


def _sum(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(unpack(v)["v"].astype(np.int64) for v in table.column("values").to_pylist())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([pack(v=total)], pa.binary())})


def _summed(df: DataFrame) -> np.ndarray | None:
    """The element-wise sum of all shards' arrays, added up by blocks on the executors; the driver gets one array."""
    rows = df.groupBy("block").applyInArrow(_sum, "block int, values binary").collect()
    return np.concatenate([unpack(r["values"])["v"].astype(np.float64) for r in sorted(rows, key=lambda r: r.block)]) if rows else None


def _shard_sums(g: dict | None, history: list[np.ndarray]):
    """g None: counts by context, tables and the corpus totals; else the totals after one more sweep than history has."""

    def run(batches):
        for batch in batches:
            for shard, message in zip(batch.column("shard").to_pylist(), batch.column("message").to_pylist()):
                r = Restaurants(shard, message)
                if g is None:
                    by = np.bincount(r.context, r.count, CLASSES)
                    tail = [r.count.sum(), (r.word_count > 0).sum(), (r.count == 1).sum(), (r.count == 2).sum(), (r.n * (r.word_count > 0) == 1).sum(), (r.n == 2).sum()]
                    yield _sum_rows(np.concatenate([by, r.totals(), tail]))
                else:
                    for i, sums in enumerate(history):
                        r.sweep(i, g, sums)
                    yield _sum_rows(r.totals())

    return run


def _answers(g: dict, history: list[np.ndarray], samples: int):
    """Each shard's answers for all its words (w_...) and pairs: counts, tables summed over the last samples, and the parent's customers and tables in each."""

    def run(batches):
        for batch in batches:
            for shard, src, message in zip(batch.column("shard").to_pylist(), batch.column("src").to_pylist(), batch.column("message").to_pylist()):
                r, out = Restaurants(shard, message), {}
                tables = np.zeros(len(r.count), np.int64)
                for i, sums in enumerate(history[:-1]):
                    r.sweep(i, g, sums)
                    k = i - (len(history) - 1 - samples)
                    if k >= 0:
                        tables += r.tables
                        out |= {f"w_customers{k}": np.bincount(r.of, r.tables, len(r.words)).astype(np.int64), f"w_tables{k}": r.root.copy()}
                answer = pack(w_count=r.word_count, count=r.count, tables=tables, **out)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([src], pa.int64()), pa.array([answer], pa.binary())], names=["shard", "src", "answer"])

    return run


def _pass_down(batches):
    """Answers of a merged message to the answers of its members."""
    for batch in batches:
        for shard, answer, members in zip(batch.column("shard").to_pylist(), batch.column("answer").to_pylist(), batch.column("members").to_pylist()):
            a = unpack(answer)
            for blob in members:
                m = unpack(blob)
                words, pairs = np.cumsum(m["words"].astype(np.int64)), np.cumsum(m["pairs"].astype(np.int64))
                own = pack(**{k: v[words if k[0] == "w" else pairs] for k, v in a.items()})
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(m["src"][0])], pa.int64()), pa.array([own], pa.binary())], names=["shard", "src", "answer"])


def _scores(g: dict, contexts: np.ndarray, tables: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            for docs, vocab, tokens, answers in zip(*(batch.column(c).to_pylist() for c in ("docs", "vocab", "tokens", "answers"))):
                docs, vocab, tokens = unpack(docs), np.frombuffer(vocab, np.uint64), unpack(tokens)["tokens"].astype(np.int64)
                parts = [unpack(a["answer"]) for a in sorted(answers, key=lambda a: a["shard"])]
                a = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                keys, place, _ = _pairs(docs, vocab, tokens)
                word, context = keys // CLASSES, keys % CLASSES
                p = np.maximum(len(tables) * a["count"].astype(np.float64) - g["discount"] * a["tables"], 0)
                for k, sums in enumerate(tables):
                    p += (g["strength"] + g["discount"] * sums[context]) * parent(g, sums, a[f"w_customers{k}"], a[f"w_tables{k}"])[word]
                model = np.log10(p / len(tables) / (g["strength"] + contexts[context]))
                base = np.log10((a["w_count"] + 1.0) / (g["tokens"] + g["vocabulary"] + 1.0))
                lens = docs["lens"].astype(np.int64)
                at = np.cumsum(lens) - lens
                ids = pa.array(docs["ids"].astype(np.uint64).view(np.int64), mask=docs["null"] == 1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(docs["held"] == 1), pa.array(lens), pa.array(np.add.reduceat((a["w_count"] > 0)[tokens].astype(np.int64), at)), pa.array(np.full(len(lens), int(g["tokens"]), np.int64)), pa.array(np.add.reduceat(base[tokens], at)), pa.array(np.add.reduceat(model[place], at))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, held_out: F.Column, sweeps: int = 3, samples: int = 2, strength: float = 1.0, seed: int = 5, batch_tokens: int = 1_500_000, shard_bytes: int = 1 << 24, fan_in: int = 128) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows that aren't held out train."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), "text")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    batches = common.bucketed(rows.mapInArrow(_batches(batch_tokens), "src long, docs binary, vocab binary, tokens binary"), "batches", "src")
    n_batches, n_bytes = batches.agg(F.count("*"), F.sum(F.octet_length("tokens") * 2)).first()
    if not n_batches:
        return spark.createDataFrame([], schema)
    shards = int(max(1, -(-n_bytes * 2 // shard_bytes)))
    level, levels, n = batches.mapInArrow(_messages(shards), "shard int, src long, message binary"), [], n_batches
    while n > 1 or not levels:
        n = -(-n // fan_in)
        group = F.pmod(F.xxhash64("src", F.lit(len(levels))), F.lit(n)).cast("long")
        level = common.written(level.withColumn("group", group).groupBy("shard", "group").applyInArrow(_merge, "shard int, src long, message binary, members array<binary>"), f"level{len(levels)}")
        levels.append(level.select("shard", "src", "members"))
        level = level.select("shard", "src", "message")
    first = _summed(level.mapInArrow(_shard_sums(None, []), "block int, values binary"))
    contexts, sums, tail = first[:CLASSES], first[CLASSES : 2 * CLASSES + 2], first[2 * CLASSES + 2 :]
    g = {"tokens": tail[0], "vocabulary": tail[1], "strength": strength, "seed": seed}
    g |= {"discount": float(np.clip(tail[2] / max(1, tail[2] + 2 * tail[3]), 0.1, 0.95)), "root_discount": float(np.clip(tail[4] / max(1, tail[4] + 2 * tail[5]), 0.1, 0.95))}
    history = [sums]
    for _ in range(sweeps):
        history.append(_summed(level.mapInArrow(_shard_sums(g, list(history)), "block int, values binary")))
    answers = level.mapInArrow(_answers(g, history, samples), "shard int, src long, answer binary")
    for members in reversed(levels):
        answers = answers.join(members, ["shard", "src"]).select("shard", "answer", "members").mapInArrow(_pass_down, "shard int, src long, answer binary")
    gathered = answers.groupBy("src").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))
    return batches.join(gathered, "src").select("docs", "vocab", "tokens", "answers").mapInArrow(_scores(g, contexts, history[-samples:]), schema)


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), common.fold("doc_id", 7) == 2)
