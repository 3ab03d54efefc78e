"""Operator 2: exact de-duplication by two passes over a blocked Bloom filter [native].

Pass one sets, for each text's digest, k bits of one 64-bit word and keeps the bits that at least two rows set; pass two
probes every row. A row with a bit that nobody else set has no equal, so it passes straight through. Only the others
are shuffled by digest and compared exactly.

Digests are written bucketed by the task that made them. So a task's equal (word, bits) are counted before anything crosses the
shuffle, which then carries one row of two numbers for each that differs: under one a document. The filter has 16 bits a row. It
is broadcast, so one filter has at most filter_blocks blocks of 4 KB (64 MB, some 33 million rows); more rows take several
rounds, each over the digests of its own share of hashes, with a filter of its own.

Defined cases: null text counts as empty; empty texts equal each other; very long texts are digested by the scan like any other;
of equal texts the one with the most code points, then the smallest doc_id (null last), then the smallest hash of the
text stays, and of rows that repeat all of these one: exactly one row of each group is kept; extra columns, whatever their
names, are kept by distinct_documents() and not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_BITS = 32768  # what bitmap_construct_agg holds: 512 words
PROBES = 3
BITS_PER_ROW = 16
FILTER_BLOCKS = 16384


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text without white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), common.WHITE, "").cast("binary"), 256)


def _probes(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The digest's block, word of the block and bits of the word (as a mask)."""
    h, g = F.xxhash64(sha), F.xxhash64(sha, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(h, F.lit(blocks)).cast("int"), F.shiftrightunsigned(g, 40).bitwiseAND(F.lit(511)).cast("int"), mask


def repeat_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """Blocks (_block, _bitmap) with the bits that two rows or more set. digests (_part, _sha) lie by _part."""
    block, word, mask = _probes(F.col("_sha"), blocks)
    keyed = digests.select("_part", block.alias("_block"), word.alias("_word"), mask.alias("_mask"))
    in_task = keyed.groupBy("_part", "_block", "_word", "_mask").agg(F.count("*").alias("_n")).drop("_part")
    counted = in_task.repartition("_block", "_word").groupBy("_block", "_word", "_mask").agg(F.sum("_n").alias("_n"))
    words = counted.groupBy("_block", "_word").agg(F.collect_list(F.struct("_mask", "_n")).alias("_l"))  # of different masks
    start = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))
    none = F.lit(0).cast("long")

    def seen(a: Column, x: Column) -> Column:
        again = a["once"].bitwiseAND(x["_mask"]).bitwiseOR(F.when(x["_n"] > 1, x["_mask"]).otherwise(none))
        return F.struct(a["once"].bitwiseOR(x["_mask"]).alias("once"), a["twice"].bitwiseOR(again).alias("twice"))

    twice = words.select("_block", "_word", F.aggregate("_l", start, seen)["twice"].alias("_twice")).where("_twice <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("_twice"), i).bitwiseAND(F.lit(1)) == 1)
    # bytes of a word go from the highest to the lowest, as hex() reads them
    place = (F.col("_word") * 64 + F.col("_i").bitwiseXOR(F.lit(56))).cast("long")
    return twice.select("_block", "_word", F.explode(bits).alias("_i")).groupBy("_block").agg(F.bitmap_construct_agg(place).alias("_bitmap"))


def maybe_repeated(rows: DataFrame, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """rows (with _sha) plus _maybe; the side that is broadcast has at most `blocks` rows of 4 KB."""
    block, word, mask = _probes(F.col("_sha"), blocks)
    probed = rows.withColumn("_block", block).withColumn("_word", word).withColumn("_mask", mask).join(F.broadcast(bitmaps), "_block", "left")
    own = F.conv(F.hex(F.substring(F.col("_bitmap"), F.col("_word") * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return probed.withColumn("_maybe", F.coalesce(own.bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_block", "_word", "_mask", "_bitmap")


def filters(table: DataFrame, n_rows: int, filter_blocks: int = FILTER_BLOCKS) -> tuple[int, int]:
    """How many rounds, and how many blocks in each round's filter."""
    rounds = max(1, -(-n_rows * BITS_PER_ROW // (BLOCK_BITS * filter_blocks)))
    return rounds, max(1, -(-n_rows * BITS_PER_ROW // (BLOCK_BITS * rounds)))


def in_round(sha: Column, rounds: int, k: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(2)), F.lit(rounds)) == k


def digests_of(docs: DataFrame) -> DataFrame:
    """_part, doc_id, _chars, _text (a hash of it), _sha, _row (one number a row), written and bucketed by _part."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id"), F.char_length(text).alias("_chars"), F.xxhash64(text).alias("_text"), digest(F.col("text")).alias("_sha"))
    rows = rows.withColumn("_part", F.spark_partition_id().cast("long")).withColumn("_row", F.monotonically_increasing_id())
    return common.bucketed(rows, "digests", "_part", "zstd")


def _first(row: str = "_row") -> Column:
    """Sorts the row that stays first."""
    return F.struct((-F.col("_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("_text").alias("d"), F.col(row).alias("e"))


def duplicate_groups(docs: DataFrame, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    table = digests_of(docs)
    n = table.count()
    rounds, blocks = filters(table, n, filter_blocks)
    out = None
    for k in range(rounds):
        mine = table.where(in_round(F.col("_sha"), rounds, k)) if rounds > 1 else table
        probed = common.written(maybe_repeated(mine, common.written(repeat_filter(mine, blocks), "filter"), blocks).drop("_part"), "probed")
        again = probed.where("_maybe")
        groups = common.written(again.groupBy("_sha").agg(F.count("*").alias("group_size"), F.min(_first()).alias("_keep")), "groups")
        found = common.join_groups(again.select("doc_id", "_sha", "_row"), groups, "_sha", "group_size", n)
        found = found.select("doc_id", F.col("_keep.c").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep.e")).alias("kept"), F.col("_sha").alias("text_sha256"))
        alone = probed.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
        both = alone.unionByName(found)
        out = both if out is None else out.unionByName(both)
    return out


def distinct_documents(docs: DataFrame, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that the filter clears aren't shuffled; the others meet after map-side reduction."""
    names = docs.columns
    table = digests_of(docs)
    rounds, blocks = filters(table, table.count(), filter_blocks)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_whole"), F.char_length(text).alias("_chars"), digest(F.col("text")).alias("_sha"), "doc_id", F.xxhash64(text).alias("_text"), F.lit(0).alias("_row")
    )
    out = None
    for k in range(rounds):
        mine = table.where(in_round(F.col("_sha"), rounds, k)) if rounds > 1 else table
        bitmaps = common.written(repeat_filter(mine, blocks), "filter")
        probed = maybe_repeated(rows.where(in_round(F.col("_sha"), rounds, k)) if rounds > 1 else rows, bitmaps, blocks)
        again = probed.where("_maybe").groupBy("_sha").agg(F.min_by("_whole", _first()).alias("_whole"))
        both = probed.where("not _maybe").select("_whole").unionByName(again.select("_whole"))
        out = both if out is None else out.unionByName(both)
    return out.select("_whole.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(common.documents(spark, sf_dir))


ORACLE_OP2 = r"""
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept,
       h AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
      FROM documents)
"""
