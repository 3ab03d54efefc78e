"""Operator 8: mixing sources to target weights by pivotal dependent rounding.

Targets come from water-filling over the aggregated sources. Every document of a source starts with the same expected
number of copies, target / source size; its fraction is rounded by pairing: two fractional documents exchange words, in
a direction drawn so that neither's expectation changes, until one is integral. An exchange keeps the pair's expected
words, so a source's taken words differ from its target by less than one document. Pairing runs first within cells of
about cell_rows (1000) documents (hashed by doc_id and text, so a hot source is spread and reruns agree), then the one residual
of each cell is paired with others in rounds of fan_in cells: a reduction tree over one row per cell. Rows that are equal in
doc_id, source and text are paired with each other first, which needs no drawing: they go on as one row with a count, of which as
many as their common fraction fills take a copy more, and one is left fractional.

Defined cases: null text has size 0, as have empty ones; documents of size 0 take 0 words; a very long text is one document,
counted by the scan, and may leave its source off by up to its own size; null source is a source of its own, last in
order; a source of size 0 has target 0; a null doc_id keeps its row and comes after all ids; ids of any size stay exact;
documents of one size are paired in order of doc_id (ties: of a hash of the text); rows that repeat a doc_id with
another text are rounded on their own, equal ones share their copies (they differ by one at most); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
EQUAL = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, source_docs (rows of sizes, which stand for _n documents each), target. The windows run over one row per source, never over documents.

    With sources in order of most * size / weight, the level shared by all but the first k is (budget - what the first k
    take at most) / remaining weight; it rises while the k-th source is capped and falls after, so the level is the maximum.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.count("*").alias("source_docs"))
    ordered = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ordered.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    up_to = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("source_size").over(up_to), F.lit(0)) * most) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(up_to), F.lit(0.0)))
    leveled = weighted.withColumn("_level", level)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.max("_level").over(everything) * F.col("_w"))
    return leveled.select("source", "source_size", "source_docs", target.alias("target"))


def settle(sizes: list, probs: list, draws: np.ndarray) -> tuple[list, int]:
    """Rounds probs in order, pairing the carried document with the next; returns them and the place of the one left fractional (-1: none)."""
    p, carry = list(probs), -1
    for j, q in enumerate(p):
        if q <= 0.0 or q >= 1.0:
            continue
        if carry < 0:
            carry = j
            continue
        i, pi, si, sj = carry, p[carry], sizes[carry], sizes[j]
        full_i, empty_j, empty_i, full_j = (1 - pi) * si, q * sj, pi * si, (1 - q) * sj
        to_i, to_j = min(full_i, empty_j), min(empty_i, full_j)
        if draws[j] * (to_i + to_j) < to_j:
            p[i], p[j] = (1.0 if full_i <= empty_j else pi + to_i / si), (0.0 if empty_j <= full_i else q - to_i / sj)
        else:
            p[i], p[j] = (0.0 if empty_i <= full_j else pi - to_j / si), (1.0 if full_j <= empty_i else q + to_j / sj)
        carry = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return p, carry


_CELL = "doc_id long, source string, _n long, _ones long, _docs long, _cell long, _salt long, size long, source_size long, target double, _whole long, _p double, _left boolean"


def _settle_cell(level: int, seed: int, last: bool):
    def one(key: tuple, table: pa.Table) -> pa.Table:
        ids, sizes, salt = table.column("doc_id"), table.column("size").to_numpy(), table.column("_salt").to_numpy()
        null = ids.is_null().to_numpy()
        order = np.lexsort((salt, ids.fill_null(0).to_numpy(), null, -sizes))  # integers throughout: ids are never floats
        source, cell = key[0].as_py(), key[1].as_py()
        draws = np.random.default_rng(xxhash.xxh64_intdigest(repr((level, seed, source, cell)))).random(len(order))
        probs = table.column("_p").to_numpy()
        settled, left = settle(sizes[order].tolist(), probs[order].tolist(), draws)
        if last and left >= 0:
            settled[left], left = float(draws[0] < settled[left]), -1
        p, mark = np.empty(len(order)), np.zeros(len(order), bool)
        p[order] = settled
        if left >= 0:
            mark[order[left]] = True
        out = table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p))
        return out.set_column(out.schema.get_field_index("_left"), "_left", pa.array(mark))

    return one


def mix(docs: DataFrame, cell_rows: int = 1000, fan_in: int = 16, seed: int = 7, weights: tuple = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    salt = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), salt.alias("_salt"))
    sizes = common.written(sizes.groupBy("doc_id", "source", "size", "_salt").agg(F.count("*").alias("_n")), "sizes")
    targets = common.written(source_targets(sizes, weights, budget, most), "targets")
    total = sizes.count()
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    placed = common.join_groups(sizes.withColumn("_s", named), targets.withColumn("_s", named).drop("source"), "_s", "source_docs", total).drop("_s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cells = F.ceil(F.col("source_docs") / cell_rows)
    share = F.when(F.col("size") > 0, expected - F.floor(expected)).otherwise(F.lit(0.0)) * F.col("_n")
    share = F.when(F.abs(share - F.rint(share)) < 1e-9, F.rint(share)).otherwise(share)
    rows = placed.select(
        "doc_id", "source", "_n", F.floor(share).alias("_ones"), F.col("source_docs").alias("_docs"), F.pmod("_salt", cells).alias("_cell"), "_salt", "size", "source_size", "target",
        F.floor(expected).alias("_whole"), (share - F.floor(share)).alias("_p"), F.lit(False).alias("_left"),
    )
    most_cells = int(targets.agg(F.max(F.ceil(F.col("source_docs") / cell_rows))).first()[0] or 1)
    done, level = [], 0
    while True:
        settled = common.written(rows.groupBy("source", "_cell").applyInArrow(_settle_cell(level, seed, most_cells <= 1), _CELL), f"settled{level}")
        done.append(settled.where("not _left"))
        if most_cells <= 1:
            break
        rows = settled.where("_left").withColumn("_cell", F.floor(F.col("_cell") / fan_in))
        most_cells, level = -(-most_cells // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    ones = (F.col("_ones") + F.col("_p").cast("long")).alias("_ones")
    out = out.select("doc_id", "source", "size", "source_size", "target", "_whole", "_n", ones)
    kinds = F.array(F.struct(F.col("_ones").alias("n"), (F.col("_whole") + 1).alias("copies")), F.struct((F.col("_n") - F.col("_ones")).alias("n"), F.col("_whole").alias("copies")))
    parts = out.select("doc_id", "source", "size", "source_size", "target", F.explode(F.filter(kinds, lambda k: k["n"] > 0)).alias("k"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) > EQUAL:  # many equal rows are written out by several tasks
        starts = F.sequence(F.lit(0).cast("long"), F.col("k.n") - 1, F.lit(EQUAL).cast("long"))
        parts = parts.select("*", F.explode(starts).alias("_at")).hint("rebalance")
        parts = parts.withColumn("k", F.struct(F.least(F.col("k.n") - F.col("_at"), F.lit(EQUAL)).alias("n"), F.col("k.copies").alias("copies")))
    each = parts.select("doc_id", "source", "size", "source_size", "target", F.col("k.copies").alias("copies"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("k.n"))))
    return each.drop("col").withColumn("taken", F.col("size") * F.col("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
