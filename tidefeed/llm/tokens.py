"""Operator 7: token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are laid out as one ragged numpy array of symbols. Each step looks up the rank of every
adjacent pair, takes each sequence's lowest, and merges it in all sequences at once; finished sequences leave the array
and what survives is counted. All occurrences of a sequence's lowest pair merge in one step, except where the merged
symbol could pair at a lower rank: there only the first merges, which is what the sequential library does.

Sequences of over `LONG` symbols go rank by rank instead, all of them at once: each step takes the lowest rank there is, merges
its pairs wherever they are, and looks up only the pairs that this has made, so a word's work is nearly linear in its length.

The file may be any byte-level BPE file of the library. Its own normaliser and splitter are used, but for ASCII text under
the settings that FILE has, where a plain pattern does the same; files of other kinds are refused.

Defined cases: null text counts as empty (0 tokens); special tokens' strings inside a text count one token each, as the
library has it by default; texts are never cut and may be one word of any length; of tied ranks the leftmost goes first; rows
that repeat (doc_id null or not) are counted each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .textkit import slices

FILE = "word_bpe_49k.json"
LONG = 256
#: For ASCII text under the settings of FILE, which then needs no normal form.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\f\ra-z0-9]+")
# FILE's normaliser and splitter, for which ASCII_SPLIT stands.
ASCII_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.iinfo(np.int64).max


class MergeCounter:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        if data[:1] != b"{":
            raise ValueError(f"{path} is no file of the tokenizers library")
        spec = json.loads(data)
        model, splitter = spec["model"], json.dumps(spec.get("pre_tokenizer"))
        odd = [k for k in ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        if model.get("type") != "BPE" or odd or '"ByteLevel"' not in splitter or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path} is no plain byte-level BPE file (type {model.get('type')}, {odd})")
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        usual = (spec.get("normalizer") or {}).get("normalizers") == ASCII_NORMALIZERS and first.get("pattern") == {"Regex": ASCII_PATTERN}
        self.ascii_split = usual and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.size = len(vocab)
        self.first, self.last = np.full(1024, -1, np.int64), np.full(1024, -1, np.int64)
        for s, i in vocab.items():
            if len(s) == 1 and ord(s) < 1024:
                self.first[ord(s)] = i
                self.last[ord(s)] = vocab.get(s + suffix, i)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order, made
        lowest = np.full(self.size, NONE)
        np.minimum.at(lowest, left, np.arange(len(made)))
        np.minimum.at(lowest, right, np.arange(len(made)))
        self.at_once = lowest[made] > np.arange(len(made))  # the new symbol pairs only at higher ranks
        self.library = Tokenizer.from_file(path)
        self.byte_chars = _byte_chars()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []) if t["special"]) or r"(?!)")
        self.memo: dict[str, int] = {}

    def laid_out(self, words: list[str], lens: np.ndarray):
        """Symbols end to end, whose they are, and where words end."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym, ends = self.first[chars], np.cumsum(lens) - 1
        sym[ends] = self.last[chars[ends]]
        return sym, np.repeat(np.arange(len(words)), lens), ends

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(left) or not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merged_by_rank(self, words: list[str]) -> np.ndarray:
        """merged() for long words: linked symbols, and for each rank the places where its pair has come up."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym, owner, ends = self.laid_out(words, lens)
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        after[ends], before[ends[:-1] + 1] = -1, -1
        before[0] = -1
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.ranks(sym[at], sym[after[at]])
            known = rank < NONE
            at, rank = at[known], rank[known]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1], [True]])) if len(rank) else np.zeros(1, np.int64)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                r = int(rank[i])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(at[i:j])

        put(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at]]
            at = at[after[at] >= 0]
            at = at[self.ranks(sym[at], sym[after[at]]) == r]
            if not len(at):
                continue
            fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])  # of pairs in a row every other one merges
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run) % 2 == 0
            if not self.at_once[r]:  # what comes of the first in a word may go before the next
                take &= np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
            hit, rest = at[take], at[~take]
            gone = after[hit]
            sym[hit] = self.made[r]
            after[hit] = after[gone]
            alive[gone] = False
            tail = after[hit] >= 0
            before[after[hit][tail]] = hit[tail]
            left = before[hit]
            put(np.unique(np.concatenate([left[left >= 0], hit, rest[alive[rest]]])))
        return np.bincount(owner[alive], minlength=len(words))

    def merged(self, words: list[str]) -> np.ndarray:
        """Number of symbols that survive for each word (of byte characters)."""
        counts = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        if (lens > LONG).any():
            far = lens > LONG
            counts[far] = self.merged_by_rank([words[i] for i in np.flatnonzero(far).tolist()])
            counts[~far] = self.merged([words[i] for i in np.flatnonzero(~far).tolist()])
            return counts
        sym, owner, _ = self.laid_out(words, lens)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.full(len(sym), NONE)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            done = lowest == NONE
            counts[owner[starts[done]]] = sizes[done]
            low = np.repeat(lowest, sizes)
            hit = np.flatnonzero((rank == low) & (low < NONE))
            if len(hit):
                fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])  # of hits in a row every other one merges
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                first = np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])
                hit = hit[((np.arange(len(hit)) - run) % 2 == 0) & (self.at_once[rank[hit]] | first)]
                sym[hit] = self.made[rank[hit]]
            keep = np.repeat(~done, sizes)
            keep[hit + 1] = False
            sym, owner = sym[keep], owner[keep]
        return counts

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, in byte characters."""
        if self.ascii_split and text.isascii():
            found = ASCII_SPLIT.findall(text.lower())
            return found if text.isprintable() else [w if w.isprintable() else w.translate(self.byte_chars) for w in found]
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memo) > 500_000:
            self.memo.clear()
        parts = []
        for text in texts:
            segments = self.special.split(text)
            parts.append(([w for s in segments if s for w in self.pieces(s)], len(segments) - 1))
        new = list({w for words, _ in parts for w in words if w not in self.memo})
        self.memo.update(zip(new, self.merged(new).tolist()))
        get = self.memo.__getitem__
        return [sum(map(get, words)) + special for words, special in parts]


def _byte_chars() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100 on."""
    out, n = {}, 0
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            out[b] = chr(256 + n)
            n += 1
    return out


def _count(path: str, limit: int):
    def run(batches):
        counter = MergeCounter(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [c for i in range(0, len(texts), 100) for c in counter.count(texts[i : i + 100])]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. path: a tokenizer file that every executor has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_count(path or public_tokenizers.path(FILE), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir))
