"""Operator 13: vector codes by small codebooks, whose nearest entries a VA-file filter finds.

Vectors of integers are cut into parts; each part has a codebook. The entries' coordinates are quantised to a few bits: in each
dimension, entries fall into cells of neighbouring values, of which the ends are kept. A query's tables give, by
dimension and cell, the least and the greatest squared distance to what the cell may hold; summed over dimensions by an entry's
cells they bound its distance from below and above. Only entries whose lower bound doesn't exceed the least upper bound are
measured, in integers. So the nearest entry is exact, ties to the lower index.

Vectors are packed in blocks and written once; each round is one pass that returns counts and sums by entry, of a size that
doesn't depend on the number of vectors. Codebooks go to the tasks with the function. Sums are of integers, so results don't depend
on how rows are dealt out.

Defined cases: rows with a null vector, or with null or non-finite components, are left out; likewise empty vectors, those of
another length than most have, and those with components too great for 64-bit squares. A length that `parts` doesn't
divide gives parts that differ by one. A null vec_id comes last, rows that repeat a vec_id are ordered by their vectors; fewer rows than
entries give fewer entries; entries that no vector is nearest to stay (of equal ones all but the first); null labels are one group;
extra columns, whatever their names, are not read; texts are none here, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors
from .vectors import blocks

SCALE, PARTS, ENTRIES, ROUNDS, CELL_BITS = 4096, 8, 16, 6, 3


class VAFile:
    """A codebook's entries with their quantised coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = np.asarray(entries, np.int64)
        k, d = self.entries.shape
        cells = min(1 << bits, k)
        order = np.argsort(self.entries, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(k)[:, None], axis=0)
        self.cell = rank * cells // k
        self.low, self.high = np.empty((d, cells), np.int64), np.empty((d, cells), np.int64)
        for c in range(cells):
            inside = self.cell == c
            self.low[:, c] = np.where(inside, self.entries, np.iinfo(np.int64).max).min(axis=0)
            self.high[:, c] = np.where(inside, self.entries, np.iinfo(np.int64).min).max(axis=0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of queries to all entries, from tables by dimension and cell."""
        to_low, to_high = self.low[None] - q[:, :, None], q[:, :, None] - self.high[None]
        near = np.maximum(np.maximum(to_low, to_high), 0) ** 2
        far = np.maximum(np.abs(to_low), np.abs(to_high)) ** 2
        k, d = self.cell.shape
        lower, upper = np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int64)
        for j in range(d):
            lower += near[:, j, self.cell[:, j]]
            upper += far[:, j, self.cell[:, j]]
        return lower, upper

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each query's nearest entry, its squared distance, and how many distances were measured."""
        lower, upper = self.bounds(q)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = q[row] - self.entries[entry]
        distance = (gap * gap).sum(axis=1)
        order = np.lexsort((entry, distance, row))
        first = order[np.searchsorted(row, np.arange(len(q)))] if len(q) else order
        return entry[first], distance[first], len(row)


def bounds_of(d: int, parts: int) -> list[tuple[int, int]]:
    """Where parts begin and end."""
    return [(i * d // parts, (i + 1) * d // parts) for i in range(parts)]


def _sums(books: list[np.ndarray], d: int):
    """Adds counts (first column) and sums by part, entry and position of a block."""
    spans = bounds_of(d, len(books))
    files = [VAFile(b) for b in books]

    def add(total: np.ndarray, x: np.ndarray) -> None:
        for p, (i, j) in enumerate(spans):
            entry, _, _ = files[p].nearest(x[:, i:j])
            total[p, :, 0] += np.bincount(entry, minlength=total.shape[1])
            np.add.at(total[p, :, 1 : 1 + j - i], entry, x[:, i:j])

    return add


def fit(packs: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """Codebooks by part after `rounds` passes, starting with the parts of the vectors `first`."""
    d = first.shape[1]
    spans = bounds_of(d, parts)
    books = [first[:, i:j].copy() for i, j in spans]
    width = 1 + max(j - i for i, j in spans)
    for _ in range(rounds):
        total = vectors.summed(packs, d, (parts, len(first), width), np.int64, _sums(books, d))
        for p, (i, j) in enumerate(spans):
            n = total[p, :, 0]
            used = n > 0
            books[p][used] = total[p, used, 1 : 1 + j - i] // n[used, None]
    return books


def _coded(books: list[np.ndarray], d: int):
    spans, digits = bounds_of(d, len(books)), np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        files = [VAFile(b) for b in books]
        for x, row in blocks(batches, d):
            found = [f.nearest(x[:, i:j]) for f, (i, j) in zip(files, spans)]
            error = sum(f[1] for f in found)
            code = ["".join(c) for c in digits[np.column_stack([f[0] for f in found])]]
            columns = [row["vec_id"].values, pa.array(code), pa.array(error), row["label"].values]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "code", "error", "label"])

    return run


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for b in books for v in b.ravel().tolist())


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """rows: vec_id, vector, label. One row per usable vector: vec_id, code, error, label_error, codebooks_sha256."""
    assert entries <= 256, "a code has two hex digits a part"
    good, d = vectors.usable(rows, scale)
    if not d:
        return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    start = good.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    first = np.floor(np.array([r.vector for r in start], np.float64) * scale).astype(np.int64)
    packs = vectors.packed(good, d, scale, 0, {"vec_id": "long", "label": "string"}, "vectors")
    books = fit(packs, first, parts, rounds)
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    coded = common.written(packs.mapInArrow(_coded(books, d), "vec_id long, code string, error long, label string"), "codes")
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), "label")).alias("_label")
    coded = coded.select("vec_id", "code", "error", key)
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    out = common.join_groups(coded, sums, "_label", "_n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(vectors.embeddings(spark, sf_dir))


def _oracle() -> str:
    """DuckDB: the rounds as chained tables, all distances measured."""
    steps = [
        """
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), u AS MATERIALIZED (
  SELECT vec_id, p, x[p * len(x) // 8 + 1 : (p + 1) * len(x) // 8] AS q FROM v, (SELECT unnest(range(8)) AS p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM u QUALIFY e < 16
)"""
    ]
    near = """
SELECT vec_id, p, unnest(min_by(struct_pack(e := e, dist := dist), dist * 16 + e)) FROM (
  SELECT u.vec_id, u.p, u.q, b.e, CAST(list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS BIGINT) AS dist
  FROM u JOIN {book} b ON u.p = b.p) GROUP BY vec_id, p"""
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(book=f'b{k}')})")
        steps.append(
            f"""b{k + 1} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM b{k} o LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / m) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT a.p, a.e, i, sum(q[i])::DOUBLE AS s, count(*) AS m
      FROM a{k} a JOIN u ON u.vec_id = a.vec_id AND u.p = a.p, (SELECT unnest(range(1, (SELECT max(len(q)) FROM u) + 1)) AS i)
      WHERE i <= len(q) GROUP BY a.p, a.e, i) GROUP BY p, e) n ON n.p = o.p AND n.e = o.e
)"""
        )
    steps.append(f"z AS MATERIALIZED ({near.format(book=f'b{ROUNDS}')})")
    steps.append("r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM z GROUP BY vec_id)")
    steps.append(f"t AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), t"


ORACLE_OP13 = _oracle()
