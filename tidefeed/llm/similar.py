"""Operator 4 on sets of five-word shingles: documents whose Jaccard similarity is 0.8 or more, by SimHash search and exact verification.

Each document's set of shingles gets a 128-bit SimHash. Candidates differ in at most `bits` of the first 64 bits, found by the
generalised pigeonhole of `simhash.plan` (every fingerprint is indexed under its value and probes all values within each
partition's threshold), in at most `bits_2` of the others, and in size by no more than the similarity allows; nor may the
cells of hash values that only one of them has show that they are less similar (which is never wrong). Whether
two candidates are linked is decided by their exact sets alone. Components of links are groups.

No group is ever collected and copies don't yield all their pairs: in each round every document asks each of its buckets for
the first candidate of smaller id that isn't in its own component yet and that it hasn't asked before (the last one asked tells
that), the first answer is verified, and links join components. Candidates are asked in order of id in 64 groups, nearest
fingerprints first within a group, so most are granted. Documents without any neighbour leave after the first round. Each
further round asks for four times as many candidates, which only those need that were refused; rounds go on until
nobody has a candidate, so no link between candidates is lost.

What candidates lose, by calculation: a pair of similarity 0.8 differs in 9.7 of 64 bits on average (deviation 2.9), so 16 bits
miss 1 in 100 of such pairs, 1 in 1,000 at 0.85 and none to speak of from 0.9 on; 24 of the other 64 bits miss none.
What they cost: at so wide a radius any partition lets a fixed share of random pairs through, so comparisons of two
fingerprints (some 3 ns each) grow with the square of the number of documents of like size; signatures don't.

Defined cases: words are lower-cased (A-Z); a text of fewer than five words is one shingle; null text counts as empty, and texts
without words are equal to each other; very long texts are hashed a piece at a time and compared whole; rows without a
doc_id stay and take no part; a component keeps its smallest doc_id; rows that repeat a doc_id go together, the one
whose text has the smallest hash speaks for them; extra columns, whatever their names, are kept and not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected
from .simhash import _flips, plan
from .textkit import WordHasher, grams, mix64, slices

SHINGLE, SIMILARITY = 5, 0.8
BITS, BITS_2 = 16, 24
GROUPS = 64
CELLS = 512


def shingle_sets(hasher: WordHasher, texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    words, at = hasher.words(texts)
    out = []
    for i in range(len(texts)):
        w = words[at[i] : at[i + 1]]
        out.append(np.unique(grams(w, min(shingle, len(w)))) if len(w) else np.zeros(1, np.uint64))
    return out


def set_print(members: np.ndarray) -> int:
    """64 bits; each is set if it is in over half of the members."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(members), 1 << 16):
        votes += np.unpackbits(members[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(members), bitorder="little").view(np.uint64)[0])


def cells_of(members: np.ndarray) -> bytes:
    """Which of CELLS cells of hash values the members fall in, as bits."""
    bits = np.zeros(CELLS, bool)
    bits[(mix64(members) % np.uint64(CELLS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _prints(shingle: int):
    def run(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            sets = shingle_sets(hasher, batch.column("text").to_pylist(), shingle)
            with np.errstate(over="ignore"):
                fp = [np.array([set_print(f(s)) for s in sets], np.uint64).view(np.int64) for f in (lambda s: s, lambda s: mix64(s + np.uint64(0x9E3779B97F4A7C15)))]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            cells = pa.array([cells_of(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(fp[0]), pa.array(fp[1]), sizes, cells], names=["doc_id", "rid", "fp", "fp2", "n", "cells"])

    return run


_NODE = {"id": "long", "fp": "long", "fp2": "long", "n": "long", "cells": "binary", "root": "long", "asked": "long", "far": "long"}
_FIRST = tuple(_NODE)[:5]


def _signatures(parts: list[tuple[list[int], int]], similarity: float, names: tuple):
    """Nodes to rows (h, probe, node): indexed under its own value of each partition, and probing those within its threshold.

    Buckets are further told apart by size: sizes fall into classes of ratio 1 / similarity, and each node is in the bucket between
    its class and the next lower and in the one between its class and the next higher, so similar ones share one.
    """

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            columns = [batch.column(c) for c in names]
            size = np.floor(np.log(batch.column("n").to_numpy()) / -np.log(similarity) + 1e-9).astype(np.uint64)
            for i, (part, radius) in enumerate(parts):
                own = fp & np.uint64(sum(1 << b for b in part))
                for flip in _flips(part, radius):
                    for step in (0, 1):
                        with np.errstate(over="ignore"):
                            h = mix64((own ^ flip) + mix64(np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15) + size + np.uint64(step)))
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(fp), flip != 0)), *columns], names=["h", "probe", *names])

    return run


def _group(ids: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Ids fall into GROUPS groups in order; candidates of one group are asked before those of the next, nearest first."""
    return np.minimum((ids - span[0]) // span[1], GROUPS)


def _may_be(x: dict, a: np.ndarray, y: dict, b: np.ndarray, similarity: float, block: int = 1 << 16) -> np.ndarray:
    """False where two sets are surely less similar: a cell that only one has holds a member that the other lacks."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), block):
        p, q = a[i : i + block], b[i : i + block]
        c, d = x["cells"][p], y["cells"][q]
        shared = np.minimum(x["n"][p] - np.bitwise_count(c & ~d).sum(axis=1, dtype=np.int64), y["n"][q] - np.bitwise_count(d & ~c).sum(axis=1, dtype=np.int64))
        out[i : i + block] = shared >= similarity * (x["n"][p] + y["n"][q] - shared) - 1e-9
    return out


def _asked(index: dict, rows: dict, bits: int, bits_2: int, similarity: float, most: int, block: int = 1 << 21):
    """(place in rows, place in index, distance) of each row's `most` first admissible candidates in order of group, distance
    and id, and which rows have any neighbour. index is in order of id."""
    n, close = np.zeros(len(rows["id"]), np.int64), np.zeros(len(rows["id"]), bool)
    left, ends = np.arange(len(n)), np.append(np.flatnonzero(np.diff(index["g"])) + 1, len(index["id"]))
    ys, xs, ds, i = [], [], [], 0
    for end in ends.tolist():
        if end - i < 64 and end < len(index["id"]):
            continue
        for k in range(i, end, 64):
            x = {c: v[k : min(end, k + 64)] for c, v in index.items()}
            for j in range(0, len(left), block // 64):
                y = left[j : j + block // 64]
                b, a = np.nonzero(np.bitwise_count(rows["fp"][y][:, None] ^ x["fp"][None, :]) <= bits)
                b = y[b]
                second = np.bitwise_count(x["fp2"][a] ^ rows["fp2"][b])
                sizes = x["n"][a], rows["n"][b]
                ok = (second <= bits_2) & (x["id"][a] != rows["id"][b]) & (np.minimum(*sizes) >= similarity * np.maximum(*sizes) - 1e-9)
                a, b, second = a[ok], b[ok], second[ok]
                ok = _may_be(x, a, rows, b, similarity)
                a, b, second = a[ok], b[ok], second[ok]
                close[b] = True
                d = second.astype(np.int64) + np.bitwise_count(x["fp"][a] ^ rows["fp"][b])
                g, old, far = x["g"][a], rows["asked"][b], rows["far"][b]
                later = (g > rows["asked_g"][b]) | ((g == rows["asked_g"][b]) & ((d > far) | ((d == far) & (x["id"][a] > old))))
                good = later & (x["id"][a] < rows["id"][b]) & (x["root"][a] != rows["root"][b])
                ys.append(b[good])
                xs.append(k + a[good])
                ds.append(d[good])
                n += np.bincount(ys[-1], minlength=len(n))
        i = end
        left = left[n[left] < most]
        if not len(left):
            break
    empty = np.zeros(0, np.int64)
    y, x, d = (np.concatenate(v) if v else empty for v in (ys, xs, ds))
    order = np.lexsort((index["id"][x], d, index["g"][x], y))
    y, x, d = y[order], x[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if len(y) else empty
    take = np.arange(len(y)) - np.repeat(new, np.diff(np.append(new, len(y)))) < most
    return y[take], x[take], d[take], close


def _answers(names: tuple, span: tuple[int, int], bits: int, bits_2: int, similarity: float, most: int, chunk: int = 200_000):
    """Rows sorted by (h, id) to (y, g, d, x): each node's `most` first candidates in each bucket; x is null for nodes with neighbours but no candidate."""

    def buckets(t: pa.Table):
        h, probe = t.column("h").to_numpy(), t.column("probe").to_numpy()
        node = {c: t.column(c).to_numpy() for c in names if c != "cells"}
        node["cells"] = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.uint64).reshape(-1, CELLS // 64)
        for c in ("fp", "fp2"):
            node[c] = node[c].view(np.uint64)
        node.setdefault("root", node["id"])
        node["g"] = _group(node["id"], span)
        none = np.full(len(h), -1)
        node["asked_g"] = np.where(node["far"] >= 0, _group(node["asked"], span), -1) if "far" in node else none
        node.setdefault("asked", none)
        node.setdefault("far", none)
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        out: list[tuple] = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if j - i == 1 or probe[i:j].all():
                continue
            rows = {c: v[i:j] for c, v in node.items()}
            index = {c: v[~probe[i:j]] for c, v in rows.items()}
            # a component that fills much of the bucket isn't compared with itself
            roots, count = np.unique(index["root"], return_counts=True)
            big = roots[count > max(32, len(index["id"]) // 20)]
            for r in [*big.tolist(), None]:
                mine = rows["root"] == r if r is not None else ~np.isin(rows["root"], big)
                others = {c: v[index["root"] != r] for c, v in index.items()} if r is not None else index
                if not mine.any() or not len(others["id"]):
                    continue
                own = {c: v[mine] for c, v in rows.items()}
                y, x, d, close = _asked(others, own, bits, bits_2, similarity, most)
                close[y] = False
                rest = np.full(int(close.sum()), -1)
                out += [(own["id"][y], others["g"][x], d, others["id"][x]), (own["id"][close], rest, rest, rest)]
        y, g, d, x = (np.concatenate(v) for v in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(y), *[pa.array(v, mask=d < 0) for v in (g, d, x)]], names=["y", "g", "d", "x"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.argmax(h == h[-1]))  # the last bucket may go on
            if cut:
                yield buckets(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), 0
        if held:
            yield buckets(pa.Table.from_batches(held))

    return run


def _sets(shingle: int):
    def run(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            sets = shingle_sets(hasher, batch.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])

    return run


def _verified(similarity: float):
    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("mx").to_pylist(), batch.column("my").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(shared >= similarity * (len(a) + len(b) - shared) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("y").filter(keep), batch.column("x").filter(keep)], names=["a", "b"])

    return run


def components(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bits: int = BITS, bits_2: int = BITS_2, sample: int = 4000, growth: int = 4) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its group) of each doc_id that isn't alone."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"), "text")
    rows = common.written(texts.mapInArrow(_prints(shingle), "doc_id long, rid long, fp long, fp2 long, n long, cells binary"), "setprints")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("rid", "fp", "fp2", "n", "cells")).alias("s")).select(F.col("doc_id").alias("id"), "s.*")
    nodes = common.written(one, "nodes")
    few = np.array([r.fp for r in nodes.select("fp").distinct().orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64).view(np.uint64)
    parts = plan(few, nodes.count(), bits, pair=0.0002, share=0.25)
    low, high = nodes.agg(F.min("id"), F.max("id")).first()
    span = (low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // GROUPS)))
    links = sets = comps = None
    names, most = _FIRST, 1
    while True:
        signed = nodes.select(*names).mapInArrow(_signatures(parts, similarity, names), "h long, probe boolean, " + ", ".join(f"{c} {_NODE[c]}" for c in names))
        answered = signed.repartition(F.col("h")).sortWithinPartitions("h", "id").mapInArrow(_answers(names, span, bits, bits_2, similarity, most), "y long, g long, d long, x long")
        firsts = F.slice(F.array_sort(F.collect_set(F.when(F.col("x").isNotNull(), F.struct("g", "d", "x")))), 1, most)
        found = common.written(answered.groupBy("y").agg(firsts.alias("xs")), "found")
        pairs = found.select("y", F.explode("xs").alias("c")).select("y", F.col("c.x").alias("x"))
        if pairs.isEmpty():
            break
        if sets is None:  # from now on only nodes with neighbours
            nodes = common.written(nodes.join(found.select(F.col("y").alias("id")), "id"), "open")
            own = nodes.select(F.col("id").alias("doc_id"), "rid")
            close = common.narrowed(texts, own, "doc_id", nodes.count()).where("_in").drop("_in")
            close = close.join(own, ["doc_id", "rid"], "left_semi").dropDuplicates(["doc_id", "rid"])
            sets = common.written(close.select("doc_id", "text").mapInArrow(_sets(shingle), "id long, members binary"), "sets")
            nodes = nodes.drop("rid")
        held = pairs.join(sets.select(F.col("id").alias("y"), F.col("members").alias("my")), "y").join(sets.select(F.col("id").alias("x"), F.col("members").alias("mx")), "x")
        more = common.written(held.mapInArrow(_verified(similarity), "a long, b long"), "links")
        if comps is None or not more.isEmpty():
            links = more if links is None else common.written(links.unionByName(more), "links")
            comps = common.written(connected(links), "components")
        if "far" not in nodes.columns:
            nodes = nodes.withColumn("asked", F.lit(-1).cast("long")).withColumn("far", F.lit(-1).cast("long"))
        state = nodes.select("id", "fp", "fp2", "n", "cells", "asked", "far").join(found.select(F.col("y").alias("id"), F.array_max("xs").alias("_now")), "id", "left")
        state = state.join(comps.withColumnRenamed("node", "id"), "id", "left")
        asked, far = F.coalesce("_now.x", "asked").alias("asked"), F.coalesce("_now.d", "far").alias("far")
        nodes, names = common.written(state.select("id", "fp", "fp2", "n", "cells", F.coalesce("root", "id").alias("root"), asked, far), "asked"), tuple(_NODE)
        most *= growth
    if comps is None:
        return nodes.where("false").select(F.col("id").alias("doc_id"), F.col("id").alias("component_id"))
    return comps.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is their component's; rows without a doc_id stay. Only rows that may go are shuffled."""
    gone = common.written(components(docs, **options).where("doc_id <> component_id").select("doc_id"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), F.col("doc_id").cast("long").alias("doc_id"))
    probed = common.narrowed(rows, gone, "doc_id", gone.count())
    rest = probed.where("_in").join(gone, "doc_id", "left_anti")
    return probed.where("not _in").select("_whole").unionByName(rest.select("_whole")).select("_whole.*")
