"""What operators 10 and 11 share: batches ask shards of hashes which of their names others have too, in rounds of groups of batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds: 0 answers (own: a bit for each name asked), 1 what a batch asks (own: names, least: what it knows of each), 2 what goes on
#: for a group of batches. own holds names of 32 bits with a bit of `least` for each that the batch has twice; at a last level, names of
#: 96 bits (all a, then all b) with the smallest doc_id that has each.
TALK = "kind int, shard int, part long, seq int, own binary, least binary"


def record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _told(row: dict, last: bool) -> tuple:
    """A message's names a (and b), doc_ids, `more`, places among what its batch asked, and how many that were. Before the last level
    names have 32 bits and no doc_ids."""
    if row["kind"] == 2:  # passed on by an earlier round
        total = int(np.frombuffer(row["least"], np.int64)[0])
        v = np.frombuffer(row["own"], np.int64).reshape(5, -1)
        place = v[4].astype(np.int32)
        return (v[0].view(np.uint64), v[1].astype(np.uint32), v[2], None, place, total) if last else (v[0].astype(np.uint32), None, None, v[3] > 0, place, total)
    if last:
        n = len(row["own"]) // 12
        a, b, least = np.frombuffer(row["own"], np.uint64, n), np.frombuffer(row["own"], np.uint32, n, 8 * n), np.frombuffer(row["least"], np.int64)
        return a, b, least, None, np.arange(n, dtype=np.int32), n
    a = np.frombuffer(row["own"], np.uint32)
    return a, None, None, np.unpackbits(np.frombuffer(row["least"], np.uint8), count=len(a)).astype(bool), np.arange(len(a), dtype=np.int32), len(a)


def _verdicts(told: list[tuple], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of all names of a shard's messages, in order: whether others have it too (at the last level, whether another's doc_id is
    smaller), and whether it goes on for the group."""
    a = np.concatenate([t[0] for t in told])
    if last:
        b, least = (np.concatenate([t[k] for t in told]) for k in (1, 2))
        order = np.lexsort((least, b, a))
    else:
        order = np.argsort(a, kind="stable")
    a = a[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if last:
        b, least = b[order], least[order]
        new[1:] |= b[1:] != b[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(new)))
    if last:
        first = np.repeat(least[head], size)
        yes, on = least > first, least == first  # ties all go on: each must hear of a smaller one
    else:
        more = np.concatenate([t[3] for t in told])[order]
        yes, on = np.repeat((size > 1) | np.logical_or.reduceat(more, head), size), new
    said, goes = np.zeros(len(order), bool), np.zeros(len(order), bool)
    said[order], goes[order] = yes, on
    return said, goes


def _judged(last: bool, last_round: bool):
    """A shard's messages (kinds 1 and 2) to answers (kind 0: one bit for each name asked) and, before the last round, to what
    goes on for the whole group (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "shard", "part", "seq", "own", "least"]).to_pylist()
        out = [tuple(r.values()) for r in rows if r["kind"] == 0]
        asked = [r for r in rows if r["kind"] > 0 and r["own"]]
        if not asked:
            return pa.Table.from_batches([record(TALK, out)])
        told = [_told(r, last) for r in asked]
        said, goes = _verdicts(told, last)
        at = 0
        for r, (a, b, least, _, place, total) in zip(asked, told):
            yes, on = said[at : at + len(a)], goes[at : at + len(a)]
            at += len(a)
            where = r["shard"], r["part"], r["seq"]
            if yes.any():
                bits = np.zeros(total, bool)
                bits[place[yes]] = True
                out.append((0, *where, np.packbits(bits).tobytes(), None))
            if not last_round and on.any():
                none = np.zeros(int(on.sum()), np.int64)
                whole = a[on].view(np.int64) if last else a[on].astype(np.int64)
                passed = np.stack([whole, b[on].astype(np.int64) if last else none, least[on] if last else none, yes[on].astype(np.int64), place[on].astype(np.int64)])
                out.append((2, *where, passed.tobytes(), np.array([total]).tobytes()))
        return pa.Table.from_batches([record(TALK, out)])

    return run


def answers(asked: DataFrame, n: int, fan_in: int, last: bool) -> DataFrame:
    """shard, part, seq, own: answers to messages of n batches, in rounds of groups of fan_in batches."""
    while n > fan_in:
        n = -(-n // fan_in)
        group = F.pmod(F.xxhash64("part", "seq", F.lit(n)), F.lit(n)).alias("_group")
        asked = asked.select("*", group).groupBy("shard", "_group").applyInArrow(_judged(last, False), TALK)
    return asked.groupBy("shard").applyInArrow(_judged(last, True), TALK).where("kind = 0").select("shard", "part", "seq", "own")
