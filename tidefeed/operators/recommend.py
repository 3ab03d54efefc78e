"""Item-based collaborative filtering with exponential time decay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions.scoring import Params, decay_weight, event_weight, rounded
from tidefeed.session import cut


def matrix(ix: DataFrame, asof: str, p: Params = Params()) -> DataFrame:
    """user_id, article_id, w: summed decayed weights."""
    w = decay_weight(F.col("created_at"), F.lit(asof).cast("timestamp"), p.decay) * event_weight(F.col("event_type"), p)
    return ix.where("user_id is not null and article_id is not null").groupBy("user_id", "article_id").agg(F.sum(w).alias("w"))


def _tasks(rows: int | None, each: int = 4_000_000) -> int:
    """How many tasks share that many joined rows. The number is set since adaptive execution would go by the few bytes that enter the join."""
    return min((rows or 0) // each + 1, 20_000)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs item_a < item_b of the entries (user_id, article_id, w) that share a reader, with their product."""
    a, b = left.alias("a"), right.alias("b")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.article_id") < F.col("b.article_id")))
    return pairs.select(F.col("a.article_id").alias("item_a"), F.col("b.article_id").alias("item_b"), (F.col("a.w") * F.col("b.w")).alias("dot"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct("item_a", "item_b"), F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"))))
    return pairs.select(both.alias("e"), "sim").select("e.item_a", "e.item_b", "sim")


def similarity(m: DataFrame, p: Params = Params(), block: int = 2000, report: dict | None = None) -> DataFrame:
    """item_a, item_b, sim, both directions, sim above the minimum. Items without a common reader have no similarity.

    Weights are divided by their item's norm, so a similarity is a sum of products. Readers of up to `block` items yield their
    pairs, one direction only. A hotter reader's items don't: for pairs that share hot readers, an exact threshold join
    follows (`_hot_pairs`), which pairs only items whose weights allow a similarity above the minimum. report gets the numbers
    of pairs of either kind.
    """
    norms = m.groupBy("article_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = m.join(norms, "article_id").select("user_id", "article_id", F.try_divide("w", "norm").alias("w")).where("w <> 0")
    counts = m.groupBy("user_id").agg(F.count("*").alias("n"))
    sizes = counts.where(F.col("n") > block)
    most, squares = counts.agg(F.max("n"), F.sum(F.col("n") * F.col("n"))).first()
    if (most or 0) <= block:
        dealt = unit.repartition(_tasks((squares or 0) // 2), "user_id")
        dots = _pairs(dealt, dealt)
        if report is not None:
            report["ordinary"], report["hot"] = dots.count(), 0
        sims = dots.groupBy("item_a", "item_b").agg(F.sum("dot").alias("sim"))
        return _both_ways(sims.where(F.col("sim") > p.min_sim))
    return _both_ways(_with_hot_readers(cut(unit), sizes, p.min_sim, report))


def _with_hot_readers(unit: DataFrame, sizes: DataFrame, least: float, report: dict | None) -> DataFrame:
    """item_a < item_b, sim: pairs above `least`, where `sizes` are the hot readers.

    1. A pair that shares an ordinary reader has its sum over ordinary readers; its hot part is at most the product of both items'
       hot norms, so only pairs which that could lift above the minimum are completed.
    2. A pair that shares hot readers only needs a hot sum above the minimum: those come from the threshold join.
    """
    hot_ids = sizes.select("user_id", "n")
    marked = unit.join(hot_ids, "user_id", "left")
    warm, hot = cut(marked.where("n is null").drop("n")), cut(marked.where("n is not null"))
    dots = cut(_pairs(warm, warm).groupBy("item_a", "item_b").agg(F.sum("dot").alias("warm"), F.count("*").alias("n")))
    rest = hot.groupBy("article_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rest"))
    bounded = dots.join(rest.select(F.col("article_id").alias("item_a"), F.col("rest").alias("ra")), "item_a", "left").join(rest.select(F.col("article_id").alias("item_b"), F.col("rest").alias("rb")), "item_b", "left")
    hopeful = bounded.where(F.col("warm") + F.coalesce(F.col("ra") * F.col("rb"), F.lit(0.0)) > least * (1 - 1e-9)).select("item_a", "item_b")
    candidates = cut(_hot_candidates(hot, least))
    wanted = cut(hopeful.unionByName(candidates).distinct())
    x, y = hot.select(F.col("article_id").alias("item_a"), "user_id", F.col("w").alias("wa")), hot.select(F.col("article_id").alias("item_b"), "user_id", F.col("w").alias("wb"))
    shared = wanted.join(x, "item_a").join(y, ["item_b", "user_id"]).groupBy("item_a", "item_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("hot"))
    if report is not None:
        report["ordinary"], report["hot"] = dots.agg(F.sum("n")).first()[0] or 0, candidates.count()
    both = wanted.join(dots.drop("n"), ["item_a", "item_b"], "left").join(shared, ["item_a", "item_b"], "left")
    sim = F.coalesce("warm", F.lit(0.0)) + F.coalesce("hot", F.lit(0.0))
    return both.select("item_a", "item_b", sim.alias("sim")).where(F.col("sim") > least)


def _hot_candidates(hot: DataFrame, least: float, part: int = 2000) -> DataFrame:
    """Pairs of items whose sum over hot readers may exceed `least`; none that does is missing.

    Hot readers have one order, the hottest last. An item's tail is the longest run of last readers that can't make `least` alone: its
    norm there, or the sum of its weights times the greatest weight that any item has for the reader, is below. If two items share
    readers only where one's tail is, their sum is within that tail's bound; so pairs need a shared reader that lies before both tails,
    and only those entries are paired. A reader that still holds many has its pairs made in parts.
    """
    most = hot.groupBy("user_id").agg(F.max("w").alias("most"))
    from_last = Window.partitionBy("article_id").orderBy(F.col("n").desc(), F.col("user_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tailed = hot.join(most, "user_id").withColumn("_norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(from_last))).withColumn("_sum", F.sum(F.col("w") * F.col("most")).over(from_last))
    front = cut(tailed.where(F.least("_norm", "_sum") > least * (1 - 1e-9)).select("user_id", "article_id", "w"))
    parts = front.groupBy("user_id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    sized = front.join(parts, "user_id")
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("article_id"), F.col("parts")).cast("int")).alias("a")
    repeated = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.article_id") < F.col("b.article_id"))
    return dealt.join(repeated, same).select(F.col("a.article_id").alias("item_a"), F.col("b.article_id").alias("item_b")).distinct()


def _scored_locally(m: DataFrame, lists: DataFrame, chunks: int, parts: int, exclude_seen: bool) -> list[DataFrame]:
    """user_id, cand, score by chunks of candidates: readers are dealt once and meet the broadcast lists of a chunk, so that products are summed
    where they are made and never shuffled. An item that its reader has seen marks itself in the same pass."""
    dealt = m.select("user_id", "article_id", "w").repartition(parts, "user_id")
    out = []
    for chunk in range(chunks):
        mine = lists.where(F.col("chunk") == chunk).select(F.col("item_a").alias("article_id"), "similar")
        none = F.array().cast("array<struct<item_b:bigint,sim:double>>")
        found = F.coalesce("similar", none)
        if exclude_seen:
            found = F.concat(found, F.array(F.struct(F.col("article_id").alias("item_b"), F.lit(None).cast("double").alias("sim"))))
        rows = dealt.join(F.broadcast(mine), "article_id", "left" if exclude_seen else "inner").select("user_id", "w", F.explode(found).alias("s"))
        sums = rows.groupBy("user_id", F.col("s.item_b").alias("cand")).agg(F.sum(F.col("s.sim") * F.col("w")).alias("score"), F.count("s.sim").alias("_n"), F.count("*").alias("_all"))
        out.append(sums.where("_n > 0 and _n = _all").select("user_id", "cand", "score"))
    return out


def scores(m: DataFrame, sims: DataFrame, block: int = 100_000) -> DataFrame:
    """user_id, cand, score: the sum of similarity times weight over what a reader has read.

    An item of over `block` readers has them dealt to parts, and its list of similar items repeated for each, so no task holds a whole
    item: the product is made by blocks of readers and items, and sums are merged before they are shuffled.
    """
    sizes = m.groupBy("article_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    left = m.select("user_id", "article_id", "w")
    if sizes.isEmpty():
        joined = left.join(sims, left.article_id == sims.item_a)
    else:
        part = F.pmod(F.xxhash64("user_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
        left = left.join(sizes, "article_id", "left").select("user_id", "article_id", "w", part)
        right = sims.join(sizes.withColumnRenamed("article_id", "item_a"), "item_a", "left")
        right = right.select("item_a", "item_b", "sim", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("_part"))
        joined = left.join(right, (F.col("article_id") == F.col("item_a")) & (F.col("part") == F.col("_part")))
    return joined.groupBy("user_id", F.col("item_b").alias("cand")).agg(F.sum(F.col("sim") * F.col("w")).alias("score"))


def _best(m: DataFrame, sims: DataFrame, top_n: int, exclude_seen: bool, block: int, chunk: int, reader: int) -> DataFrame:
    """user_id, cand, score, rank of each reader's top_n scored candidates.

    Similarities go to every task in chunks of candidates (up to eight chunks of some `chunk` rows); more of them, and readers of over
    `reader` items, take the way of scores(), whose sums are shuffled. A chunk passes on top_n rows a reader.
    """
    best = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "cand")

    def top(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)

    def shuffled(rows: DataFrame) -> DataFrame:
        scored = scores(rows, sims, block)
        return top(scored.join(rows.select("user_id", F.col("article_id").alias("cand")), ["user_id", "cand"], "left_anti") if exclude_seen else scored)

    chunks = -(-sims.count() // chunk)
    if chunks > 8:
        return shuffled(m)
    chunks = max(chunks, 1)
    lists = sims.groupBy("item_a", F.pmod(F.xxhash64("item_b"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct(F.col("item_b").cast("long").alias("item_b"), "sim")).alias("similar"))
    lists = cut(lists)
    lengths = lists.groupBy("item_a").agg(F.sum(F.size("similar")).alias("length"))
    per_reader = m.join(lengths, F.col("article_id") == F.col("item_a"), "left").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("length", F.lit(0)) + 1).alias("rows"))
    ordinary = F.col("n") <= reader
    rows, hot = per_reader.agg(F.sum(F.when(ordinary, F.col("rows"))), F.count(F.when(~ordinary, 1))).first()
    many = m.groupBy("user_id").agg(F.count("*").alias("n")).where(~ordinary).select("user_id")
    found = [top(s) for s in _scored_locally(m.join(many, "user_id", "left_anti") if hot else m, lists, chunks, _tasks(rows), exclude_seen)]
    merged = reduce(DataFrame.unionByName, found)
    if chunks > 1:
        merged = top(merged.drop("rank"))
    return merged.unionByName(shuffled(m.join(many, "user_id", "left_semi"))) if hot else merged


def recommend(
    m: DataFrame, sims: DataFrame, top_n: int = 10, exclude_seen: bool = True, popularity: DataFrame | None = None, block: int = 100_000, chunk: int = 1_000_000, reader: int = 100_000
) -> DataFrame:
    """user_id, article_id, score, rank. Users without any scored candidate get unseen items by popularity at score 0.01.

    Ranks are limited where scores are made (a task passes on top_n rows a reader), and computed once.
    """
    seen = m.select("user_id", F.col("article_id").alias("cand"))
    ranked = cut(_best(m, sims, top_n, exclude_seen, block, chunk, reader))
    popular = (popularity if popularity is not None else m).groupBy("article_id").agg(F.sum("w").alias("pop"))
    cold = m.select("user_id").distinct().join(ranked.select("user_id").distinct(), "user_id", "left_anti")
    # a user's unseen popular items are among the top_n + (items seen) most popular: that many are paired with cold users only
    counts = m.groupBy("user_id").agg(F.count("*").alias("n_seen"))
    order = Window.orderBy(F.col("pop").desc(), "article_id")
    mine = cold.join(counts, "user_id")
    most = (mine.agg(F.max("n_seen")).first()[0] or 0) + top_n  # no cold user looks further down, so no more are numbered
    top = popular.orderBy(F.col("pop").desc(), "article_id").limit(most)
    listed = top.withColumn("place", F.row_number().over(order)).select("place", F.col("article_id").alias("cand"))
    wanted = mine.select("user_id", F.explode(F.sequence(F.lit(1), (F.col("n_seen") + top_n).cast("int"))).alias("place"))
    offered = wanted.join(listed, "place")
    if exclude_seen:
        offered = offered.join(seen, ["user_id", "cand"], "left_anti")
    fallback = offered.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("place"))).where(F.col("rank") <= top_n).select("user_id", "cand", F.lit(0.01).alias("score"), "rank")
    return ranked.select("user_id", "cand", "score", "rank").unionByName(fallback).select("user_id", F.col("cand").alias("article_id"), rounded(F.col("score"), 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def similar_items(sims: DataFrame, article_id: int, top_n: int = 5) -> DataFrame:
    return sims.where(F.col("item_a") == article_id).orderBy(F.col("sim").desc(), "item_b").limit(top_n).select(F.col("item_b").alias("article_id"), rounded(F.col("sim"), 4).alias("similarity"))


def cached(recs: DataFrame) -> DataFrame:
    """One row per user: article_ids and scores as JSON arrays in rank order."""
    rows = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "score"))).alias("r"))
    return rows.select("user_id", F.to_json(F.transform("r", lambda x: x["article_id"])).alias("article_ids"), F.to_json(F.transform("r", lambda x: x["score"])).alias("scores"))


def decoded(cache: DataFrame, top_n: int = 10) -> DataFrame:
    """The cache's arrays zipped by position."""
    both = F.arrays_zip(F.slice(F.from_json("article_ids", "array<bigint>"), 1, top_n).alias("article_id"), F.slice(F.from_json("scores", "array<double>"), 1, top_n).alias("score"))
    return cache.select("user_id", F.posexplode(both)).select("user_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("col.article_id"), F.col("col.score"))


def serve(asked: DataFrame, cache: DataFrame, m: DataFrame, sims: DataFrame, users: DataFrame, top_n: int = 10) -> DataFrame:
    """user_id, origin, rank, article_id, score for the users asked for: from the cache where it has a row, else computed now.

    A user without interactions has no row; one that doesn't exist has one row of origin `unknown`.
    """
    known = asked.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    hit = decoded(cache.join(known, "user_id", "left_semi"), top_n).withColumn("origin", F.lit("cache"))
    missing = known.join(cache.select("user_id"), "user_id", "left_anti")
    live = recommend(m.join(missing, "user_id", "left_semi"), sims, top_n, popularity=m).withColumn("origin", F.lit("live"))
    columns = ("user_id", "origin", "rank", "article_id", "score")
    none = asked.join(known, "user_id", "left_anti").select("user_id", F.lit("unknown").alias("origin"), *[F.lit(None).cast(k).alias(c) for c, k in zip(columns[2:], ("long", "long", "double"))])
    return hit.select(*columns).unionByName(live.select(*columns)).unionByName(none)


def score_share(recs: DataFrame) -> DataFrame:
    top = F.greatest(F.max("score").over(Window.partitionBy("user_id")), F.lit(0.0001))
    return recs.withColumn("share_pct", F.round(F.col("score") / top * 100).cast("long"))


def split(ix: DataFrame, test_ratio: float = 0.2, least: int = 5) -> DataFrame:
    """ix with is_test: the latest fifth of each reader's events; readers of fewer than `least` events are left out."""
    mine = Window.partitionBy("user_id")
    n = F.count("*").over(mine)
    last = F.greatest(F.lit(1), F.floor(n * F.lit(1 - test_ratio)))
    return ix.withColumn("_n", n).withColumn("_r", F.row_number().over(mine.orderBy("created_at", "id"))).withColumn("is_test", F.col("_r") > last).where(F.col("_n") >= least).drop("_n", "_r")


def evaluate(ix: DataFrame, asof: str, k: int = 10, test_ratio: float = 0.2, p: Params = Params()) -> DataFrame:
    """One row: status, n_users_evaluated, precision, recall, map.

    As served: similarities come from the whole history, training weights are the full ones of items that occur in
    training, precision divides by the number of recommendations, average precision by min(k, distinct test items), a
    test item that also trains can't be hit, readers without recommendations are skipped.
    """
    m = cut(matrix(ix, asof, p))
    sims = cut(similarity(m, p))
    parts = cut(split(ix, test_ratio).select("user_id", "article_id", "is_test"))  # this and what can be used are read several times
    train = parts.where("not is_test").select("user_id", "article_id").distinct()
    test = parts.where("is_test").select("user_id", "article_id").distinct()
    sizes = test.groupBy("user_id").agg(F.count("*").alias("n_test"))
    usable = cut(m.join(train, ["user_id", "article_id"]).join(sizes.select("user_id"), "user_id", "left_semi"))
    recs = recommend(usable, sims, k, popularity=m)
    hits = recs.join(test.withColumn("hit", F.lit(1)), ["user_id", "article_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    per_user = hits.withColumn("_ap", F.col("hit") * so_far / F.col("rank")).groupBy("user_id").agg(F.sum("hit").alias("h"), F.count("*").alias("n"), F.sum("_ap").alias("ap")).join(sizes, "user_id")
    out = per_user.agg(F.count("*").alias("n_users_evaluated"), rounded(F.avg(F.col("h") / F.col("n")), 4).alias("precision"), rounded(F.avg(F.col("h") / F.col("n_test")), 4).alias("recall"), rounded(F.avg(F.col("ap") / F.least(F.lit(k), F.col("n_test"))), 4).alias("map"))
    return out.withColumn("status", F.when(F.col("n_users_evaluated") > 0, "ok").otherwise("insufficient_data"))


def model_size(ix: DataFrame, m: DataFrame, sims: DataFrame) -> DataFrame:
    a = m.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("article_id").alias("n_items"))
    b, c = ix.agg(F.count("*").alias("n_interactions")), sims.agg(F.count("*").alias("n_sim_pairs"))
    return a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").join(c.withColumn("_", F.lit(1)), "_").drop("_")
