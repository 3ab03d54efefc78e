"""Operator 11: repeated passages by level-wise doubling of word windows.

A word goes if a window of `length` words that covers it also starts in a document with a smaller doc_id. Windows of `seed`
words come first; only those found in two documents are extended to twice their length, and so on (the last step overlaps: a
window of 13 is one of 8 here and one of 8 five words on), until `length` is reached or no candidate survives. So

1. texts are packed into batches of some megabytes, written once to the shared folder and bucketed by the task that made them:
   later joins deal out what belongs to a batch, never the texts;
2. at each level a batch sends its distinct candidates to shards of hashes, 32 bits each and whether two documents of the batch
   have it; a window of a third of all documents counts once a batch. Shards answer one bit: found in two documents;
3. survivors whose neighbour one step on survives too become the next level's candidates, named by their halves. From the
   second level on, candidates alone are carried, without texts; their names have 96 bits there (two independent hashes of
   the bytes), so among 10^12 candidates any two different ones share a name with a probability of some 10^-5;
4. at the last level candidates go with the smallest doc_id that has them, and the answer is whether another is smaller;
5. marks meet their batches, whose texts lose the words covered.

Above fan_in batches, shards answer in rounds (a tree of groups of fan_in batches, from each of which a window goes on once), so no
task gathers a hot window from all batches. Shards are sized by the input's bytes; nothing but counts reaches the driver.

Defined cases: null text counts as empty; documents of fewer than `length` words keep all; a very long text is a batch of its own
and is hashed a piece at a time; a null doc_id counts as the least number, so such rows lose nothing; rows that repeat a doc_id
(ties) are not smaller than each other and lose nothing to each other; extra columns, whatever their names, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .asking import TALK, answers, record
from .suffix_dedup import LEAST_ID, _get, _of_batches, _put, _runs
from .textkit import PIECE, WordHasher, grams, mix64, slices

LENGTH, SEED = 13, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BATCH = "part long, seq int, n_bytes long, doc binary, size binary, data binary"
_STATE = "part long, seq int, doc binary, ends binary, pos binary, a binary, b binary"
_MARKS = "shard int, part long, seq int, runs binary"


def levels(length: int = LENGTH, seed: int = SEED) -> list[int]:
    """Window lengths: from seed, doubled, up to length."""
    out = [min(seed, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _batches(size: int):
    """Rows (doc_id, text) to batches of about `size` bytes, documents in order of id."""

    def run(batches):
        kept, held, made = [], 0, 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0

        def packed():
            kept.sort(key=lambda r: r[0])
            doc, sizes = np.array([[r[0], len(r[2])] for r in kept], np.int64).T
            null = np.array([r[1] for r in kept])
            data = b"".join(r[2] for r in kept)
            sizes = np.where(null, -1 - sizes, sizes)  # negative: the doc_id is null
            return ((task << 20) + made // 8, made, len(data), _put(doc.tobytes()), _put(sizes.tobytes()), zstandard.ZstdCompressor(level=3).compress(data))

        for batch in slices(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                kept.append((LEAST_ID if i is None else i, i is None, data))
                held += len(data)
                if held >= size or len(kept) >= 100_000:
                    yield record(_BATCH, [packed()])
                    kept, held, made = [], 0, made + 1
        if kept:
            yield record(_BATCH, [packed()])

    return run


def _rows(batch: pa.RecordBatch):
    """Rows as dictionaries, one at a time: one of them may be megabytes."""
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """doc_ids of a batch, whether each is null, and the texts."""
    size = np.frombuffer(_get(row["size"]), np.int64)
    null = size < 0
    ends = np.cumsum(np.where(null, -1 - size, size)).tolist()
    data = _get(row["data"])
    return np.frombuffer(_get(row["doc"]), np.int64), null, [data[i:j] for i, j in zip([0, *ends[:-1]], ends)]


class Level:
    """A batch's candidates of one length: place of the first word, name (a, and b at the last level), and doc_id of each."""

    def __init__(self, doc, ends, pos, a, b):
        self.doc, self.ends, self.pos, self.a, self.b = doc, ends, pos, a, b

    @classmethod
    def first(cls, row: dict, hashers: list[WordHasher], seed: int, wide: bool):
        """All windows of seed words of a batch of texts."""
        doc, _, texts = _unpacked(row)
        words, at = hashers[0].encoded(texts)
        pos = np.arange(max(0, len(words) - seed + 1))
        inside = pos + seed <= at[1:][np.searchsorted(at[1:], pos, "right")] if len(pos) else pos > 0
        pos = pos[inside]
        out = cls(doc, at[1:], pos, grams(words, seed)[inside], None)
        if wide:
            out.widen(texts, hashers[1], seed)
        return out

    @classmethod
    def read(cls, row: dict):
        kinds = {"doc": np.int64, "ends": np.int64, "pos": np.int32, "a": np.uint64, "b": np.uint32}
        doc, ends, steps, a, b = (np.frombuffer(row[c], k) for c, k in kinds.items())
        return cls(doc, ends, np.cumsum(steps, dtype=np.int64), a, b)

    def widen(self, texts: list[bytes], hasher: WordHasher, seed: int) -> None:
        self.b = (grams(hasher.encoded(texts)[0], seed)[self.pos] >> np.uint64(32)).astype(np.uint32)

    def of(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which documents candidates i lie in."""
        return np.searchsorted(self.ends, self.pos[i], "right")

    def messages(self, shards: int, last: bool):
        """Per distinct name, in order: names, the smallest doc_id and whether there are others; each candidate's index in that
        order; and shards (ranges of a) and where they begin."""
        order = np.argsort(self.a, kind="stable") if not last else np.lexsort((self.b, self.a))  # places, and with them doc_ids, ascend within a name
        a = self.a[order]
        new = np.ones(len(order), bool)
        new[1:] = a[1:] != a[:-1]
        if last:
            b = self.b[order]
            new[1:] |= b[1:] != b[:-1]
        head = np.flatnonzero(new)
        index = np.empty(len(order), np.int32)
        index[order] = np.cumsum(new, dtype=np.int32) - 1
        names = a[head], b[head] if last else None
        tail = np.append(head[1:], len(order))[: len(head)] - 1
        least, most = self.doc[self.of(order[head])], self.doc[self.of(order[tail])]
        s = ((names[0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
        return names, least, least != most, index, s[edge[:-1]].astype(np.int64), edge

    def answered(self, heard: list[dict], shards: int, last: bool) -> np.ndarray:
        """Each candidate's answer: whether another document has it (at the last level: one of smaller doc_id)."""
        _, least, more, index, shard, edge = self.messages(shards, last)
        yes = np.zeros(len(least), bool) if last else more.copy()
        begin = dict(zip(shard.tolist(), zip(edge[:-1].tolist(), edge[1:].tolist())))
        for x in heard:
            i, j = begin[x["shard"]]
            yes[i:j] |= np.unpackbits(np.frombuffer(x["own"], np.uint8), count=j - i).astype(bool)
        return yes[index] | (self.doc[self.of()] > least[index]) if last else yes[index]

    def extended(self, good: np.ndarray, size: int, to: int) -> "Level":
        """Candidates of `to` words: survivors of `size` words whose neighbour to - size words on survives in the same document."""
        where = np.flatnonzero(good)
        p = self.pos[where]
        i = np.searchsorted(p, p + (to - size))
        ok = i < len(p)
        ok[ok] = p[i[ok]] == p[ok] + (to - size)
        ok[ok] = p[ok] + to <= self.ends[np.searchsorted(self.ends, p[ok], "right")]
        x, y = where[ok], where[i[ok]]
        with np.errstate(over="ignore"):
            a, b = (mix64(h[x].astype(np.uint64) + mix64(h[y].astype(np.uint64) * _ODD + np.uint64(to))) for h in (self.a, self.b))
        return Level(self.doc, self.ends, self.pos[x], a, (b >> np.uint64(32)).astype(np.uint32))

    def row(self, part: int, seq: int) -> tuple:
        steps = np.diff(self.pos, prepend=0).astype(np.int32)
        return part, seq, *(np.ascontiguousarray(v).tobytes() for v in (self.doc, self.ends, steps, self.a, self.b))


def _hashers() -> list[WordHasher]:
    """Two hashers of words as they are, which share their tables."""
    one = WordHasher(11, lower=False)
    one.up, one.down = one.up[: PIECE + 4096].copy(), one.down[: PIECE + 4096].copy()
    two = WordHasher(12, lower=False)
    two.up, two.down = one.up, one.down
    return [one, two]


def _asking(size: int, from_text: bool, last: bool, shards: int):
    """Batches or states to messages (kind 1): low name bits and `more` bits; at the last level whole names and doc_ids."""

    def run(batches):
        hashers = _hashers()
        for row in chain.from_iterable(map(_rows, batches)):
            lev = Level.first(row, hashers, size, last) if from_text else Level.read(row)
            (a, b), least, more, _, shard, edge = lev.messages(shards, last)
            rows = []
            for s, i, j in zip(shard.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
                if last:
                    own, with_it = a[i:j].tobytes() + b[i:j].tobytes(), least[i:j].tobytes()
                else:
                    own, with_it = a[i:j].astype(np.uint32).tobytes(), np.packbits(more[i:j]).tobytes()
                rows.append((1, s, row["part"], row["seq"], own, with_it))
            yield record(TALK, rows)

    return run


def _extending(size: int, to: int, from_text: bool, shards: int):
    """Batches or states with their answers to the states of the next level; batches without candidates end here."""

    def run(batches):
        hashers = _hashers()
        for row in chain.from_iterable(map(_rows, batches)):
            lev = Level.first(row, hashers, size, False) if from_text else Level.read(row)
            good = lev.answered(row["answers"] or [], shards, False)
            if not good.any():
                continue
            if from_text:
                lev = Level(lev.doc, lev.ends, lev.pos[good], lev.a[good], None)
                lev.widen(_unpacked(row)[2], hashers[1], size)
                good = np.ones(len(lev.pos), bool)
            lev = lev.extended(good, size, to)
            if len(lev.pos):
                yield record(_STATE, [lev.row(row["part"], row["seq"])])

    return run


def _marking(size: int, from_text: bool, shards: int):
    """The last level's candidates with their answers to runs of words that go, [first, end) in the batch."""

    def run(batches):
        hashers = _hashers()
        for row in chain.from_iterable(map(_rows, batches)):
            lev = Level.first(row, hashers, size, True) if from_text else Level.read(row)
            start = lev.pos[lev.answered(row["answers"] or [], shards, True)]
            if len(start):
                runs = _runs(start)
                runs[:, 1] += size - 1
                yield record(_MARKS, [(0, row["part"], row["seq"], runs.astype(np.int64).tobytes())])

    return run


def _cutting(with_text: bool):
    """Batches with their marks to one row a document."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches):
        for row in chain.from_iterable(map(_rows, batches)):
            doc, null, texts = _unpacked(row)
            runs = [np.frombuffer(m["runs"], np.int64).reshape(-1, 2) for m in row["marks"] or []]
            runs = np.concatenate(runs) if runs else np.zeros((0, 2), np.int64)
            top, out, at = (runs[:, 1].max() if len(runs) else 0), [], 0
            change = np.zeros(top + 1, np.int64)
            np.add.at(change, runs[:, 0], 1)
            np.add.at(change, runs[:, 1], -1)
            gone = np.cumsum(change) > 0
            for i, text in enumerate(texts):
                words = text.split()  # of bytes: at space and U+0009 to U+000D only
                own = gone[at : at + len(words)]
                at, n = at + len(words), int(own.sum())
                if n:
                    words = [*compress(words, (~own).tolist()), *words[len(own) :]]
                kept = b" ".join(words)
                out.append((None if null[i] else int(doc[i]), len(words) + n, n, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "surrogatepass")] * with_text))
            yield record(schema, out)

    return run, schema


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False, shard_bytes: int = 1 << 24, batch_bytes: int = 3 << 20, least_shards: int = 64, fan_in: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = common.bucketed(rows.mapInArrow(_batches(batch_bytes), _BATCH), "passages", "part")
    total, n = texts.agg(F.sum("n_bytes"), F.count("*")).first()
    shards = int(max(least_shards, -(-(total or 0) // shard_bytes)))
    texts = texts.drop("n_bytes")
    state, sizes, marks = texts, levels(length, seed), None
    for k, size in enumerate(sizes):
        from_text, last = k == 0, k == len(sizes) - 1
        asked = state.mapInArrow(_asking(size, from_text, last, shards), TALK)
        told = _of_batches(state, answers(asked, n, fan_in, last), "answers", "own")
        if last:
            marks = common.written(told.mapInArrow(_marking(size, from_text, shards), _MARKS), "marks")
        else:
            state = common.bucketed(told.mapInArrow(_extending(size, sizes[k + 1], from_text, shards), _STATE), f"level{k}", "part", "zstd")
            if state.isEmpty():
                marks = docs.sparkSession.createDataFrame([], _MARKS)
                break
    run, schema = _cutting(with_text)
    return _of_batches(texts, marks, "marks", "runs").mapInArrow(run, schema)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir))


#: DuckDB: windows as texts, each with the smallest document that has it.
ORACLE_OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS least FROM w) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at FROM hit
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.at) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM d) e
  LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at
  WHERE g.at IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
