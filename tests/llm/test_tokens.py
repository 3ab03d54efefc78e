import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidefeed.llm import tokens as T

PATH = public_tokenizers.path(T.FILE)
LIBRARY = Tokenizer.from_file(PATH)
OURS = T.MergeCounter(PATH)
TRICKY = ["", " ", "a", "aaaaaaaa" * 50, "Hello, WORLD's they'll 've", "<|endoftext|>", "x<|startoftext|><|endoftext|> y", "<|endoftext", "ΣΑΣ İ ß ﬁ", "é   x", "漢字かな 🙂👍🏽", "1234 ½ ²", "\x00\x1c\x7f\x85", "a\nb\tc\r\n", "don't'S'", "abcabcabc" * 200, "!!!???###", "가", "​﻿"]


def want(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_tricky_texts():
    assert OURS.count(TRICKY) == want(TRICKY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcth 'sLE\n.1<|>éΣ漢"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_random_texts(texts):
    assert OURS.count(texts) == want(texts)


def test_operator(make, texts):
    rows = [(i, t, "s") for i, t in enumerate([*texts, *TRICKY, "word " * 3000])]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(make(rows)).collect()}
    n = want([t or "" for _, t, _ in rows])
    assert got == {i: (len((t or "").encode()), c, c > 2048) for (i, t, _), c in zip(rows, n)}
    assert T.token_counts(make(["a"]).where("false")).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "eth", "a"])
def test_one_long_word(letters):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for n in (257, 700, 5000, 30_000)]
    assert OURS.count(texts) == want(texts)


def test_a_million_letters_take_seconds():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.process_time()
    assert OURS.count([text]) == want([text])
    assert time.process_time() - began < 60


def test_other_files():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = T.MergeCounter(path), Tokenizer.from_file(path)
    texts = [*TRICKY, "Some Ordinary  Text, with 123 numbers\n\n and more", "x" * 900]
    assert ours.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        T.MergeCounter(public_tokenizers.path("piece_bpe_32k.model"))
