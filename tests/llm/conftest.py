import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts or (doc_id, text, source) rows, with columns whose names operators use inside."""

    def build(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r, f"s{i % 3}") for i, r in enumerate(rows)]
        full = [(i, t, "en", s, len(t or ""), "x", 1, "y") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA + ", _sha string, fp int, score string").repartition(parts)

    return build


@pytest.fixture(scope="session")
def texts():
    """Texts with exact copies, near copies, shared passages, nulls and blanks."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    passage = prose(40)
    out = [prose(rnd.randint(5, 120)) for _ in range(40)]
    out += [out[3], out[3], out[4] + " ", out[5].replace(" ", "\n", 1), out[6] + " extra", "", None, " \t\n", "one two", "One  TWO", "é ü 漢字 " + prose(20)]
    out += [prose(10) + " " + passage + " " + prose(10) for _ in range(6)] + ["ab" * 400, "x" * 300, "x" * 99, prose(3000)]
    long = out[20].split()
    out += [" ".join(long[:k] + ["zz"] + long[k:]) for k in (2, 9)]
    return out
