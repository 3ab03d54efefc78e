"""Operator 3: toxicity by compression distance.

Two zstandard dictionaries are trained, one on pieces that toxic training texts use more than ordinary ones, one on pieces that
they don't. A text is cut into windows of WINDOW words that overlap by half. A window is coded word by word, so its length
under a dictionary is the sum of its words' lengths, and what the toxic dictionary saves on each word (against the
ordinary one alone) counts by calibrated log-odds of that saving. The windows' sums are the evidence: the strongest windows and
the number of words decide through a calibrated logistic curve, so that a toxic passage isn't averaged away by the
ordinary text around it. Each byte of a word is widened with two bytes that depend on it and its predecessors, so that
short words yield whole bytes, and words end in padding, because zstandard looks for no matches in the last bytes of a block.

Log-odds and curve are calibrated on texts that the dictionaries used for it have not seen, by cross-fitting in FOLDS parts at
every size; the dictionaries that score are then trained on all training texts.

The fit uses at most max_toxic and max_ordinary labelled texts (by order of a hash of doc_id) of at most max_bytes together,
whole; everything else covers all rows. Only the lower-cased text enters a score.

Defined cases: null text counts as empty; an empty text has no window and scores the fitted curve at zero evidence; a very
long text is scored by all its windows; no usable labels of either class: every score is the share of toxic labels (0
without labels); a doc_id with several labels counts as toxic if one is; null labels and labels of null ids are
ignored; rows that repeat are scored each, and a doc_id trains once; texts that share a shingle minimum with an earlier one
(copies) don't train again; ties don't arise (scores are continuous); extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
from collections import Counter
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textkit import slices

TAIL = bytes(range(128, 148))
BINS, SHIFT = 40, 5
PREFIXES = (6, 9)
WINDOW, FOLDS = 64, 3


def widened(words: list[bytes]) -> list[bytes]:
    """Each word with its borders, every byte followed by two that depend on it and the two before it, and padding."""
    if not words:
        return []
    a = np.frombuffer(b"  " + b"  ".join(words) + b"  ", np.uint8).astype(np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    a = a[1:-1]  # " w1  w2 ... wn " : each word has a blank on either side of its own
    p, q = np.empty_like(a), np.empty_like(a)
    p[1:], q[2:] = a[:-1], a[:-2]
    starts = ends - lens
    p[starts], q[starts], q[starts + 1] = 0, 0, 0
    one = ((a * np.uint32(2654435761) + p * np.uint32(3928491)) >> np.uint32(8)) & np.uint32(255)
    two = ((a * np.uint32(2246822519) + p * np.uint32(3266489917) + q * np.uint32(668265263)) >> np.uint32(11)) & np.uint32(255)
    buf = np.stack([a, one, two], 1).astype(np.uint8).tobytes()
    return [buf[3 * s : 3 * e] + TAIL for s, e in zip(starts.tolist(), ends.tolist())]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _pieces(words: list[bytes]) -> set[bytes]:
    """The words with their borders, and long words' beginnings."""
    found = set()
    for w in set(words):
        x = b" " + w
        found.add(x + b" ")
        found.update(x[:k] for k in PREFIXES if len(x) > k)
    return found


def _originals(docs: list[list[bytes]], shingle: int = 5, keys: int = 4) -> list[list[bytes]]:
    """docs without those that share a minimum of hashed five-word shingles with an earlier one: copies would count their words many times."""
    seen, kept = set(), []
    for d in docs:
        parts = [b" ".join(d[i : i + shingle]) for i in range(max(1, len(d) - shingle + 1))] if d else []
        mine = {(k, min(xxhash.xxh64_intdigest(p, k) for p in parts)) for k in range(keys)} if parts else {(0, 0)}
        if not mine & seen:
            kept.append(d)
        seen |= mine
    return kept


def _dictionary(samples: list[bytes], size: int, k: int, group: int) -> bytes:
    packed = [b"".join(samples[i : i + group]) for i in range(0, len(samples), group)]
    try:
        trained = zstandard.train_dictionary(size, packed, k=k, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        trained = b""
    return trained or b"".join(samples)[-size:]


class Coder:
    """Bytes that the toxic dictionary saves on each word."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int):
        def compressor(content: bytes):
            par = zstandard.ZstdCompressionParameters.from_level(level, source_size=64, dict_size=len(content), write_checksum=0, write_content_size=0, write_dict_id=0, min_match=5, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=par)

        cut = max(0, len(ordinary) - 200)
        self.plain = compressor(ordinary or b" " * 16).compress
        self.both = compressor((ordinary[:cut] + toxic + ordinary[cut:]) or b" " * 16).compress
        self.memo: dict[bytes, int] = {}

    def savings(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.memo) > 400_000:
            self.memo.clear()
        new = list({w for d in docs for w in d if w not in self.memo})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, x in zip(part, widened(part)):
                self.memo[w] = len(self.plain(x)) - len(self.both(x))
        get = self.memo.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]


def evidence(saved: np.ndarray, odds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Each window's summed log-odds; windows begin every half window, the last ends with the text."""
    total = np.concatenate([[0.0], np.cumsum(odds[np.clip(saved + SHIFT, 0, BINS - 1)])])
    if not len(saved):
        return np.zeros(0)
    begin = np.arange(0, max(1, len(saved) - window // 2), window // 2)
    return total[np.minimum(begin + window, len(saved))] - total[begin]


def _features(saved: list[np.ndarray], odds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(saved), 4))
    for i, s in enumerate(saved):
        e = -np.sort(-evidence(s, odds))
        out[i] = (1.0, np.tanh(e[0] / 20) * 4 if len(e) else 0.0, np.tanh(e[:4].sum() / 40) * 4 if len(e) else 0.0, np.log1p(len(s)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return b


def _coder(train: list[list[list[bytes]]], toxic_size: int, ordinary_size: int, level: int, least_z: float, least_lift: float) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of training texts (toxic, ordinary)."""
    seen = [Counter(w for d in side for w in _pieces(d)) for side in train]
    n1, n0 = len(train[0]), len(train[1])
    samples: tuple[list, list] = ([], [])
    for w in sorted(seen[0].keys() | seen[1].keys()):
        a, b = seen[0][w], seen[1][w]
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        if z >= least_z and a >= 2 and a * (n0 + 2) >= least_lift * (b + 0.5) * n1:
            samples[0].extend([w] * a)
        elif z < 1 and b >= 3:
            samples[1].extend([w] * max(1, round(sqrt(b))))  # else the commonest words would leave no room for others
    for side in samples:
        random.Random(1).shuffle(side)

    def wide(side: list[bytes]) -> list[bytes]:  # a piece has its borders already; beginnings have no right one
        return [x[:-3] if w[-1:] != b" " else x for w, x in zip(side, (y[: -len(TAIL)] for y in widened([w[1:].rstrip(b" ") for w in side])))]

    return _dictionary(wide(samples[1]), ordinary_size, 96, 8), _dictionary(wide(samples[0]), toxic_size, 48, 4)


def fit(toxic: list[str], ordinary: list[str], toxic_size: int = 8192, ordinary_size: int = 32768, level: int = 6, least_z: float = 5.0, least_lift: float = 4.0) -> dict:
    """Dictionaries, log-odds per saved byte and the curve."""
    docs = [_originals([words_of(t) for t in side]) for side in (toxic, ordinary)]
    sizes = (toxic_size, ordinary_size, level, least_z, least_lift)
    saved: list[list[np.ndarray]] = [[], []]
    for k in range(FOLDS):
        train = [[d for i, d in enumerate(side) if i % FOLDS != k] or side for side in docs]  # a class of one text has no other
        coder = Coder(*_coder(train, *sizes), level)
        for own, side in zip(saved, docs):
            own += coder.savings([d for i, d in enumerate(side) if i % FOLDS == k])
    counts = [1.0 + sum((np.bincount(np.clip(s + SHIFT, 0, BINS - 1), minlength=BINS) for s in side), np.zeros(BINS)) for side in saved]
    odds = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    x = np.concatenate([_features(side, odds) for side in saved])
    y = np.concatenate([np.ones(len(saved[0])), np.zeros(len(saved[1]))])
    dict0, dict1 = _coder(docs, *sizes)
    return {"toxic": dict1, "ordinary": dict0, "odds": odds, "curve": _logistic(x, y), "level": level}


def _score(model: dict):
    def run(batches):
        coder = Coder(model["ordinary"], model["toxic"], model["level"])
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            score = np.zeros(0)
            for i in range(0, len(texts), 50):
                x = _features(coder.savings([words_of(t) for t in texts[i : i + 50]]), model["odds"])
                score = np.concatenate([score, 1 / (1 + np.exp(-np.clip(x @ model["curve"], -30, 30)))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, train: F.Column, max_toxic: int, max_ordinary: int, max_bytes: int = 1 << 26) -> tuple[list[str], list[str]]:
    """Texts of at most so many labelled documents of either class, in order of a hash of doc_id, as long as they have at most
    max_bytes together: the bound on what the driver gets, half for each class. A text of over a sixteenth of its class's half is left
    out whole, so it can't end the sample for those after it."""
    marked = labels.where("doc_id is not null and toxic is not null").where(train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    order = F.xxhash64("doc_id")
    few = marked.where("_toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(marked.where("_toxic = 0").orderBy(order, "doc_id").limit(max_ordinary))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))
    own = F.coalesce(F.octet_length("text"), F.lit(0))
    size = F.sum(own).over(Window.partitionBy("_toxic").orderBy(order, "doc_id"))
    rows = rows.where(own <= max_bytes // 32).withColumn("_size", size).where(F.col("_size") <= max_bytes // 2).orderBy(order, "doc_id").collect()
    return [r.text for r in rows if r._toxic == 1], [r.text for r in rows if r._toxic == 0]


def toxicity(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, threshold: float = 0.7, max_toxic: int = 2000, max_ordinary: int = 4000) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted. train: which labels may be learnt from."""
    toxic, ordinary = labelled_sample(docs, labels, F.lit(True) if train is None else train, max_toxic, max_ordinary)
    if toxic and ordinary:
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(fit(toxic, ordinary)), "doc_id long, score double")
    else:
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1.0 if toxic else 0.0).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity(common.documents(spark, sf_dir), labels, common.fold("doc_id", 3) != 1)
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
