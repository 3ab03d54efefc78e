"""Operator 10: repeated substrings by depth-limited radix sort of suffixes.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or same document further left).
Equal strings have equal minimisers: the least hash of the `gram`-byte grams inside, at the same offset. So

1. texts are packed into batches of some megabytes, written once to the shared folder, bucketed by the task that made them:
   later joins deal out what belongs to a batch, never the texts;
2. each batch sends its distinct minimisers (about one in 32 bytes, four bytes each) to shards of hashes, which answer one bit
   for each: whether it occurs anywhere else. A minimiser of a third of all texts counts once a batch, and above fan_in batches once
   a group of them, since shards answer in rounds;
3. each batch sorts the suffixes around repeated minimisers. Those that repeat inside the batch are settled there; only the
   first of each goes on to its shard, so a hot string crosses the shuffle once a batch;
4. shards order their suffixes by most-significant-digit passes of eight bytes, only as deep as `length`, and within groups
   that still disagree. Groups left at that depth are exactly the repeated strings; all but the earliest start are marked.
   Above fan_in batches, shards merge in rounds (a tree), so that a hot string meets at most fan_in copies at a time;
5. the marks meet their batches, whose texts lose the bytes covered.

Shards are sized by the input's bytes, nothing is collected.

Defined cases: null text counts as empty; texts under `length` bytes keep everything; a very long text is a batch of its own and
is hashed a piece at a time; a null doc_id is smaller than any other; rows that repeat doc_id and text are one document,
wherever they lie, and each shows its result; rows of one doc_id with different texts are ordered by a hash of the text;
of tied starts the first in this order stays; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .asking import TALK, answers, record
from .textkit import _tables, mix64, slices

LENGTH, GRAM = 100, 36
PIECE = 1 << 20
POS = np.uint64((1 << 24) - 1)
LEAST_ID = -(1 << 63)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _put(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _get(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Minimisers:
    """For each string of LENGTH bytes inside a text: where its minimiser is, and the minimiser's hash."""

    def __init__(self):
        self.value = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)
        self.up, self.down = _tables(PIECE + LENGTH)

    def of(self, a: np.ndarray, ends: np.ndarray):
        """a: texts' bytes end to end; ends: where each ends. Yields (starts, minimiser positions, hashes by position, first position) a piece at a time."""
        for p in range(0, len(a), PIECE):
            x = a[p : p + PIECE + LENGTH - 1]
            n = len(x)
            if n < LENGTH:
                return
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(self.value[x] * self.up[:n], out=total[1:])
                h = mix64((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
            v = (h & ~POS) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
            m = np.minimum(v[:-1], v[1:])
            for step in (2, 4, 8, 16, 32):
                m = np.minimum(m[:-step], m[step:])
            m = np.minimum(m[:-1], v[64:])
            s = np.arange(p, p + len(m))
            inside = s + LENGTH <= ends[np.searchsorted(ends, s, "right")]
            yield s[inside], (m[inside] & POS).astype(np.int64) + p, h, p


def radix_groups(data: bytes, start: np.ndarray, key: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): indexes of the suffixes that have an equal, group by group, and for each the index of its group's first.

    start: where suffixes of at least `length` bytes start in data, in document order; key: equal for equal suffixes (the
    first digit). Passes go from the left, eight bytes at a time; only groups that disagree are sorted again.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)

    def grouped(order: np.ndarray, head: np.ndarray):
        size = np.diff(np.append(np.flatnonzero(head), len(head)))
        many = np.repeat(size > 1, size)
        order, head = order[many], head[many]
        return order, head, np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)

    order, head, lead = grouped(order, head)
    depth = 0
    while depth < length and len(order):
        step = min(8, length - depth)
        wide = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        at = start[order] + (depth if step == 8 else length - 8)  # the last digit overlaps the one before
        digit = wide[at].astype(np.uint64)
        differ = digit != digit[lead]
        if differ.any():
            torn = np.isin(lead, np.unique(lead[differ]))
            rest = np.flatnonzero(torn)
            again = np.lexsort((order[rest], digit[rest], lead[rest]))
            g, d = lead[rest][again], digit[rest][again]
            order[rest] = order[rest][again]
            head[rest] = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
            order, head, lead = grouped(order, head)
        depth += step
    return order, order[lead] if len(order) else order


def _runs(s: np.ndarray) -> np.ndarray:
    """Starts in ascending order to rows [first, last + 1)."""
    edge = np.flatnonzero(np.concatenate([[True], np.diff(s) != 1, [True]])) if len(s) else np.zeros(1, np.int64)
    return np.column_stack([s[edge[:-1]], s[edge[1:] - 1] + 1]) if len(s) else np.zeros((0, 2), np.int64)


_BATCH = "part long, seq int, n_bytes long, ids binary, data binary"


def _batches(size: int):
    """Rows (doc_id, text) to batches of about `size` bytes: documents in order of id, each once, with the number of its rows."""

    def run(batches):
        kept, held, made = [], 0, 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0

        def emit():
            nonlocal made
            rows = sorted(kept, key=lambda r: r[:2])
            kept.clear()
            new = [not i or r[:2] != rows[i - 1][:2] for i, r in enumerate(rows)]
            own = [r for r, first in zip(rows, new) if first]
            ids = np.array([[r[0], r[1], r[2], len(r[3])] for r in own], np.int64).T
            copies = np.bincount(np.cumsum(new) - 1)
            data = b"".join(r[3] for r in own)
            made += 1
            key = (task << 20) + (made - 1) // 8
            row = ([key], [made], [len(data)], [_put(np.vstack([ids, copies[None, :]]).tobytes())], [_put(data)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "seq", "n_bytes", "ids", "data"])

        for batch in slices(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                rid = xxhash.xxh64_intdigest(data, i is None) - (1 << 63)
                kept.append((LEAST_ID if i is None else i, rid, int(i is None), data))
                held += len(data)
                if held >= size or len(kept) >= 100_000:
                    yield emit()
                    held = 0
        if kept:
            yield emit()

    return run


class Batch:
    """An unpacked batch: ids and bytes of its documents, and of their minimisers."""

    def __init__(self, ids: bytes, data: bytes, finder: Minimisers | None):
        self.doc, self.rid, self.null, self.lens, self.copies = np.frombuffer(_get(ids), np.int64).reshape(5, -1)
        self.data, self.ends = _get(data), np.cumsum(self.lens)
        self.begins = self.ends - self.lens
        if finder is None:
            return
        self.starts, self.anchors, spots, hashes = [], [], [], []
        for s, at, h, p in finder.of(np.frombuffer(self.data, np.uint8), self.ends):
            here = np.unique(at)
            if spots and len(here) and len(spots[-1]) and here[0] <= spots[-1][-1]:  # one that the piece before has found
                here = here[here > spots[-1][-1]]
            self.starts.append(s.astype(np.int32 if len(self.data) < 1 << 31 else np.int64))
            self.anchors.append(at.astype(self.starts[-1].dtype))
            spots.append(here)
            hashes.append(h[here - p])
        self.spots = np.concatenate(spots) if spots else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def messages(self, shards: int):
        """Distinct minimisers in order of shard, where each shard's begin, and whether each occurs here more than once."""
        h, count = np.unique(self.hashes, return_counts=True)
        shard = (h % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
        return h[order], shard[edge[:-1]], edge, count[order] > 1


def _hashes(shards: int):
    def run(batches):
        finder = Minimisers()
        for batch in batches:
            for part, seq, ids, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "ids", "data"))):
                h, shard, edge, twice = Batch(ids, data, finder).messages(shards)
                low, n = (h >> np.uint64(32)).astype(np.uint32), len(shard)
                names = [low[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])]
                known = [np.packbits(twice[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:])]
                yield record(TALK, list(zip([1] * n, shard.tolist(), [part] * n, [seq] * n, names, known)))

    return run


def _encoded(doc, rid, h, index, rel, start, n, off, text: bytes) -> bytes:
    """Segments (suffix starts in a row that share a minimiser) of documents doc, rid: each one's document, start there and in its batch, number, distance to the minimiser, and bytes."""
    parts = ((doc, "i8"), (rid, "i8"), (h.view(np.int64), "i8"), (index, "u4"), (rel, "u4"), (start, "u4"), (n, "u1"), (off, "u1"))
    return _put(np.array([len(h), len(doc)], np.int64).tobytes() + b"".join(np.asarray(v).astype(t).tobytes() for v, t in parts) + text)


def _decoded(blob: bytes):
    blob = _get(blob)
    k, w = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at, got = 16, []
    for m, t in ((w, "i8"), (w, "i8"), (k, "i8"), (k, "u4"), (k, "u4"), (k, "u4"), (k, "u1"), (k, "u1")):
        got.append(np.frombuffer(blob, t, m, at).astype(np.int64))
        at += m * int(t[1])
    cut = (np.concatenate([[0], np.cumsum(got[6] + LENGTH - 1)]) + at).tolist()
    return [got[0][got[3]], got[1][got[3]], *got[2:3], *got[4:]], [blob[i:j] for i, j in zip(cut[:-1], cut[1:])]


_MARKS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("part", pa.int64()), ("seq", pa.int32()), ("payload", pa.binary())])
_MARKS_SQL = "kind int, shard int, part long, seq int, payload binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _MARKS.types)], schema=_MARKS)


def _mark(part: int, seq: int, starts: np.ndarray, shards: int) -> tuple:
    """Marked starts (ascending, by place in the batch) as a row of kind 0."""
    return 0, (part * 31 + seq) % shards, part, seq, _put(_runs(starts).astype(np.int64).tobytes())


def _segments(s: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments begin among starts s with minimisers at `at` in documents `of`, and their numbers of starts."""
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(at) != 0) | (np.diff(of) != 0), [True]]))
    return edge[:-1], np.diff(edge)


def _suffixes(shards: int):
    """Batches with their answers to marks (kind 0: settled here) and suffixes (kind 1: the first of each here)."""

    def settled(part: int, seq: int, b: Batch, answers: list[dict]) -> list[tuple]:
        h, shard, edge, again = b.messages(shards)
        begin, again = {s: k for k, s in enumerate(shard.tolist())}, again.copy()
        for a in answers or []:
            i, j = edge[begin[a["shard"]]], edge[begin[a["shard"]] + 1]
            again[i:j] |= np.unpackbits(np.frombuffer(a["own"], np.uint8), count=j - i).astype(bool)
        wanted = np.sort(h[again])
        if not len(wanted):
            return []
        good = np.zeros(len(b.data), bool)
        good[b.spots[wanted[np.minimum(np.searchsorted(wanted, b.hashes), len(wanted) - 1)] == b.hashes]] = True
        keep = [good[a] for a in b.anchors]
        s, at = (np.concatenate([x[k] for x, k in zip(xs, keep)]).astype(np.int64) for xs in (b.starts, b.anchors))
        b.starts = b.anchors = None
        h = b.hashes[np.searchsorted(b.spots, at)]
        with np.errstate(over="ignore"):
            key = mix64(h + (at - s).astype(np.uint64) * _GOLD)
        order, first = radix_groups(b.data, s, key)
        later = np.zeros(len(s), bool)
        later[order[order != first]] = True
        rows = [_mark(part, seq, s[later], shards)] if later.any() else []
        s, at, h = s[~later], at[~later], h[~later]
        of = np.searchsorted(b.ends, s, "right")
        i, n = _segments(s, at, of)
        shard = (h[i] % np.uint64(shards)).astype(np.int64)
        rank = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(shard[rank]) != 0, [True]]))
        for x, y in zip(cut[:-1], cut[1:]):
            seg = rank[x:y]
            k = i[seg]
            text = b"".join(b.data[p : p + w + LENGTH - 1] for p, w in zip(s[k].tolist(), n[seg].tolist()))
            who, index = np.unique(of[k], return_inverse=True)
            rows.append((1, int(shard[seg[0]]), part, seq, _encoded(b.doc[who], b.rid[who], h[k], index, s[k] - b.begins[of[k]], s[k], n[seg], at[k] - s[k], text)))
        return rows

    def run(batches):
        finder = Minimisers()
        for batch in batches:
            for part, seq, ids, data, answers in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "ids", "data", "answers"))):
                yield from _table(settled(part, seq, Batch(ids, data, finder), answers)).to_batches()

    return run


def _sorted_shard(shards: int, last: bool):
    """A shard's suffixes in radix order, to marks by batch (and, before the last round, the first of each); marks that are settled already pass."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        settled, own = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
        shard = table.column("shard")[0].as_py()
        parts, seqs = own.column("part").to_numpy(), own.column("seq").to_numpy()
        columns, texts, src = [], [], []
        for i, blob in enumerate(own.column("payload").to_pylist()):
            cols, pieces = _decoded(blob)
            columns.append(cols)
            texts += pieces
            src.append(np.full(len(pieces), i))
        if not texts:
            return settled.cast(_MARKS)
        doc, rid, h, rel, start, n, off = (np.concatenate(c) for c in zip(*columns))
        src = np.concatenate(src)
        del columns
        rank = np.lexsort((rel, rid, doc))
        doc, rid, h, rel, start, n, off, src = (x[rank] for x in (doc, rid, h, rel, start, n, off, src))
        data = b"".join([texts[i] for i in rank.tolist()])
        del texts
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        seg = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            key = mix64(h[seg].view(np.uint64) + (off[seg] - j).astype(np.uint64) * _GOLD)
        order, first = radix_groups(data, begin[seg] + j, key)
        a, b = seg[order], seg[first]  # a row that repeats is the same document: what it shares with itself is no repeat
        same = (doc[a] == doc[b]) & (rid[a] == rid[b]) & (rel[a] + j[order] == rel[b] + j[first])
        later = np.zeros(len(seg), bool)
        later[order[~same]] = True
        g = np.flatnonzero(later)
        of, place = src[seg[g]], start[seg[g]] + j[g]
        by = np.lexsort((place, of))
        of, place = of[by], place[by]
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
        rows = [_mark(int(parts[of[x]]), int(seqs[of[x]]), place[x:y], shards) for x, y in zip(edge[:-1], edge[1:])]
        if not last:
            rows += _firsts(shard, parts, seqs, src, doc, rid, h, rel, start, off, begin, data, seg, j, later)
        return pa.concat_tables([settled.cast(_MARKS), _table(rows)])

    return run


def _firsts(shard, parts, seqs, src, doc, rid, h, rel, start, off, begin, data, seg, j, gone) -> list[tuple]:
    """The starts that stay, as rows of kind 1 by batch."""
    left = np.flatnonzero(~gone)
    own, i = seg[left], j[left]
    lead = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(i) != 1)])) if len(left) else np.zeros(0, np.int64)
    n = np.diff(np.append(lead, len(left)))
    own, i = own[lead], i[lead]
    rank = np.argsort(src[own], kind="stable")
    own, i, n = own[rank], i[rank], n[rank]
    at = src[own]
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
    rows = []
    for x, y in zip(edge[:-1], edge[1:]):
        k, f, m = own[x:y], i[x:y], n[x:y]
        text = b"".join(data[p : p + w + LENGTH - 1] for p, w in zip((begin[k] + f).tolist(), m.tolist()))
        rows.append((1, shard, int(parts[at[x]]), int(seqs[at[x]]), _encoded(doc[k], rid[k], h[k], np.arange(len(k)), rel[k] + f, start[k] + f, m, off[k] - f, text)))
    return rows


def covered(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of `size` bytes a marked string covers."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, runs[:, 1] - 1 + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(with_text: bool):
    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text]
        for batch in batches:
            for ids, data, marks in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "marks"))):
                b = Batch(ids, data, None)
                runs = [np.frombuffer(_get(m["payload"]), np.int64).reshape(-1, 2) for m in marks or []]
                gone = covered(len(b.data), np.concatenate(runs) if runs else np.zeros((0, 2), np.int64))
                a, rows = np.frombuffer(b.data, np.uint8), []
                n_gone = np.concatenate([[0], np.cumsum(gone)])
                for i, (x, y) in enumerate(zip(b.begins.tolist(), b.ends.tolist())):
                    n, g = int(n_gone[y] - n_gone[x]), gone[x:y]
                    kept = a[x:y][~g].tobytes() if n else b.data[x:y]
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0
                    row = (None if b.null[i] else int(b.doc[i]), y - x, n, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text)
                    rows += [row] * int(b.copies[i])
                yield from pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names).to_batches(max_chunksize=10_000)

    return run


def _of_batches(batches: DataFrame, rows: DataFrame, name: str, column: str) -> DataFrame:
    """batches with the array `name` of structs (shard, column) of their rows; only rows are dealt out."""
    lists = rows.groupBy("part").agg(F.collect_list(F.struct("seq", "shard", column)).alias("_all"))
    mine = F.filter("_all", lambda x: x["seq"] == F.col("seq"))
    return batches.join(lists, "part", "left").withColumn(name, F.transform(mine, lambda x: F.struct(x["shard"].alias("shard"), x[column].alias(column)))).drop("_all")


def remove_repeats(docs: DataFrame, shard_bytes: int = 1 << 24, with_text: bool = False, batch_bytes: int = 1 << 22, least_shards: int = 64, fan_in: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batches = common.bucketed(rows.mapInArrow(_batches(batch_bytes), _BATCH), "texts", "part")
    total, n = batches.agg(F.sum("n_bytes"), F.count("*")).first()
    shards = int(max(least_shards, -(-(total or 0) // shard_bytes)))
    asked = batches.select("part", "seq", "ids", "data").mapInArrow(_hashes(shards), TALK)
    told = _of_batches(batches.drop("n_bytes"), answers(asked, n, fan_in, False), "answers", "own")
    found = told.mapInArrow(_suffixes(shards), _MARKS_SQL)
    while n > fan_in:
        n = -(-n // fan_in)
        found = found.withColumn("_group", F.pmod(F.xxhash64("part", "seq", F.lit(n)), F.lit(n))).groupBy("shard", "_group").applyInArrow(_round(shards), _MARKS_SQL)
    marks = common.written(found.groupBy("shard").applyInArrow(_sorted_shard(shards, True), _MARKS_SQL).select("shard", "part", "seq", "payload"), "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return _of_batches(batches.drop("n_bytes"), marks, "marks", "payload").mapInArrow(_cut(with_text), schema)


def _round(shards: int):
    one = _sorted_shard(shards, False)
    return lambda key, table: one(table.drop(["_group"]))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir))
