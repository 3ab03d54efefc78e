"""Operator 6: quality by ordinal cumulative-link regression on graded ratings.

Texts are hashed to byte-trigram frequencies; one weight vector serves all grades, and ordered thresholds turn its score
into P(grade <= k) = sigmoid(threshold_k - score). The fit takes at most max_labels rated texts (whole, by order of a hash of
doc_id); scoring covers all rows, holds one Arrow batch in memory and needs no shuffle.

Defined cases: null text counts as empty; a text of under three bytes has no trigram and scores by the thresholds alone; a very
long text is hashed whole, a piece at a time; null ratings are ignored, several ratings of one doc_id count as their lowest;
ratings of fewer than two grades: every document gets the only grade (or `grades - 1` without ratings) with certainty, and the
same rule selects by it; a null doc_id is scored and can't be rated; rows that repeat a doc_id are scored each, and all
train with its rating; a probability of exactly `tail` (a tie) selects; extra columns, whatever their names, are not read by quality()
and kept by select(); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textkit import slices

DIMS = 1 << 14


def trigrams(text: bytes, dims: int = DIMS) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    h = (a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)) * np.uint32(2654435761)
    return (h >> np.uint32(18)).astype(np.int64) % dims


def _pieces(text: str | None, size: int = 1 << 20):
    """Hashed trigrams of the whole text, a piece at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    for i in range(0, max(1, len(data) - 2), size):
        yield trigrams(data[i : i + size + 2])


def _sparse(batches):
    for batch in slices(batches):
        index, value = [], []
        for text in batch.column("text").to_pylist():
            c = sum((np.bincount(t, minlength=DIMS) for t in _pieces(text)), np.zeros(DIMS, np.int64))
            at = np.flatnonzero(c)
            index.append(at.astype(np.int32).tobytes())
            value.append((c[at] / max(1, c.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_grade"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "_grade", "_index", "_value"])


def fit(rows: list[tuple[bytes, bytes]], grades: np.ndarray, n_grades: int, steps: int = 250, rate: float = 0.05, ridge: float = 2e-3) -> dict:
    """Adam on the exact likelihood; features are scaled by their root mean square over the sample."""
    index = [np.frombuffer(i, np.int32) for i, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(i) for i in index])
    col = np.concatenate(index).astype(np.int64)
    val = np.concatenate([np.frombuffer(v, np.float32) for _, v in rows]).astype(np.float64)
    scale = np.sqrt(np.bincount(col, val * val, DIMS) / len(rows)) + 1e-4
    val = val / scale[col] / np.sqrt(200)
    w, cut = np.zeros(DIMS), np.linspace(-1, 1, n_grades - 1)
    par = [w, np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])]
    mom = [[np.zeros_like(p), np.zeros_like(p)] for p in par]
    hot = np.arange(n_grades)[None, :] == grades[:, None]
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([par[1][:1], np.exp(par[1][1:])]))
        s = np.bincount(row, val * par[0][col], len(rows))
        upper = np.column_stack([1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -30, 30))), np.ones(len(s))])
        lower = np.column_stack([np.zeros(len(s)), upper[:, :-1]])
        p = np.maximum((upper - lower)[hot], 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        gs = -(-(du[hot] - dl[hot]) / p) / len(s)
        g_theta = np.array([-(du[:, k] * hot[:, k] / p - dl[:, k + 1] * hot[:, k + 1] / p).sum() for k in range(n_grades - 1)]) / len(s)
        g_cut = np.array([g_theta.sum()] + [g_theta[k:].sum() * np.exp(par[1][k]) for k in range(1, n_grades - 1)])
        for j, g in enumerate((np.bincount(col, val * gs[row], DIMS) + ridge * par[0], g_cut)):
            m, v = mom[j]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            par[j] = par[j] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta = np.cumsum(np.concatenate([par[1][:1], np.exp(par[1][1:])]))
    return {"weights": par[0] / scale / np.sqrt(200), "theta": theta}


def _score(model: dict, n_grades: int):
    def run(batches):
        for batch in slices(batches):
            s = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                n = 0
                for t in _pieces(text):
                    s[i] += model["weights"][t].sum()
                    n += len(t)
                s[i] /= max(1, n)
            tails = [1 - 1 / (1 + np.exp(-np.clip(t - s, -30, 30))) for t in model["theta"]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sum(tails)), *map(pa.array, tails)], names=["doc_id", "expected_grade", *[f"p_ge{k}" for k in range(1, n_grades)]])

    return run


def fitted(docs: DataFrame, ratings: DataFrame, n_grades: int, max_labels: int) -> dict | int:
    """The model, or the only grade there is."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("_grade"))
    few = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").mapInArrow(_sparse, "doc_id long, _grade int, _index binary, _value binary").orderBy("doc_id", "_index").collect()
    seen = sorted({r._grade for r in rows})
    if len(seen) < 2:
        return seen[0] if seen else n_grades - 1
    return fit([(r._index, r._value) for r in rows], np.array([r._grade for r in rows]), n_grades)


def quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, at_least: int = 1, tail: float = 0.5, max_labels: int = 3000) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, p_ge1..., selected (P(grade >= at_least) >= tail). ratings: doc_id, grade in 0..n_grades-1."""
    model = fitted(docs, ratings, n_grades, max_labels)
    names = [f"p_ge{k}" for k in range(1, n_grades)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if isinstance(model, int):
        out = rows.select("doc_id", F.lit(float(model)).alias("expected_grade"), *[F.lit(float(model >= k)).alias(n) for k, n in enumerate(names, 1)])
        return out.withColumn("selected", F.col(f"p_ge{at_least}") >= tail)
    schema = ", ".join(f"{n} double" for n in ["expected_grade", *names])
    out = rows.mapInArrow(_score(model, n_grades), f"doc_id long, {schema}")
    return out.withColumn("selected", F.col(f"p_ge{at_least}") >= tail)


def _keep(model: dict, at_least: int, tail: float):
    """Filters rows in place, so that texts aren't shuffled."""

    def run(batches):
        score = _score({"weights": model["weights"], "theta": model["theta"]}, len(model["theta"]) + 1)
        for batch in slices(batches):
            scored = next(score(iter([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])])))
            yield batch.filter(pa.array(scored.column(f"p_ge{at_least}").to_numpy() >= tail))

    return run


def select(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, at_least: int = 1, tail: float = 0.5, max_labels: int = 3000) -> DataFrame:
    """The rows of docs that quality() selects, with all their columns."""
    model = fitted(docs, ratings, n_grades, max_labels)
    if isinstance(model, int):
        return docs if float(model >= at_least) >= tail else docs.where("false")
    return docs.mapInArrow(_keep(model, at_least, tail), docs.schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 low quality, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1), 2)
    return labels.select("doc_id", grade.alias("grade"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir), ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
