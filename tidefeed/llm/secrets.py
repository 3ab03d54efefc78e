"""Operator 5: secret scan with a random forest that removes false positives [native].

Candidates are all runs of the secret alphabet inside words: those of at least min_length characters with a digit, those
of a known shape (access keys, tokens with their makers' prefixes) and those of at least MIXED letters that change between cases
three times, digits or not, and values of at least keyed_length characters that are assigned to a key word (in the same word,
as in JSON, or by the words before). Each gets numeric features by SQL functions: length, shares of character classes, transitions between
classes, distinct characters, share of it that dictionary words cover, its path (the document's source) and the text before
and after. The dictionary is a few technical words and the most frequent words of all documents. A random forest is fitted
on labelled findings and compiled to CASE expressions, so that scoring stays inside the query: no shuffle, no Python.

The forest is fitted on the driver from at most max_findings labelled findings a class (their features only, by order of
a hash); all candidates of all whole texts are scored. Findings may be given with labels (doc_id, position, is_secret and
perhaps part); without, findings that a structural rule settles either way (known key shapes and keyed assignments; mail and
network addresses, plain numbers, dates) serve as labels, and the forest decides the rest as it decides those.

Defined cases: null text counts as empty and has no candidates; a very long text is split like any other; a null source is an
empty path; a word or row that repeats is a finding each time; rows with a null doc_id are scanned and can't be labelled;
labels of one class or none: that class (none: not secret) for all; of tied splits the first tried stays; extra columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words that make a candidate less random, besides the documents' own.
DICTIONARY = (
    "password", "passwd", "token", "secret", "key", "mail", "example", "http", "https", "www", "com", "org", "net", "test", "user", "name",
    "version", "page", "html", "json", "data", "file", "path", "the", "and", "for", "with",
)
KEYWORDS = r"(?i)(pass(word|wd)?|pwd|secret|token|api|key|auth|bearer|credential)"
SHAPE = r"[A-Za-z0-9_+/=.@:\-]"
KEYED = rf"{KEYWORDS}[A-Za-z0-9_\-]*[\"']?\s*[=:]\s*[\"']?"
#: Runs that are candidates without a digit: prefixes of common tokens, and letters that change case often.
SHAPES = r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp|gho|ghs|glpat|xox[abp]|sk|pk|rk)[_\-][A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{16,}"
MIXED = 20
CASES = rf"(?=[A-Za-z]{{{MIXED}}})[A-Za-z]*?(?:[a-z]+[A-Z]+){{3}}"
FEATURES = (
    "f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_transitions", "f_distinct", "f_hex", "f_covered", "f_path_test", "f_path_depth",
    "f_key_before", "f_key_inside", "f_equals", "f_quoted", "f_key_after",
)


def frequent_words(docs: DataFrame, most: int = 300, least_length: int = 4) -> list[str]:
    """The most frequent words of letters in all texts; at most `most` reach the driver."""
    runs = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+")
    words = docs.select(F.explode(F.filter(runs, lambda w: F.length(w).between(least_length, 12) & ~w.rlike("[0-9]"))).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def candidates(docs: DataFrame, min_length: int = 12, keyed_length: int = 8) -> DataFrame:
    """doc_id, position (of the word), part (the candidate's place among the word's runs), core (without trailing marks), word, before, after, path."""
    long, value = rf"{SHAPE}{{{min_length},}}", rf"{SHAPE}{{{keyed_length},}}"
    split = docs.where("text is not null").select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), F.split(F.col("text"), r"[\x20\x09-\x0D]+").alias("_w"))

    def word(i: Column | int) -> Column:
        return F.coalesce(F.get(F.col("_w"), F.lit(i) if isinstance(i, int) else i), F.lit(""))

    def worth(w: Column, i: Column) -> Column:
        before = F.concat(word(i - 4), F.lit(" "), word(i - 3), F.lit(" "), word(i - 2))
        return w.rlike(value) & ((w.rlike(long) & (w.rlike(r"[0-9]") | (w.rlike(rf"[A-Za-z]{{{MIXED}}}") & w.rlike(CASES)) | w.rlike(SHAPES))) | w.rlike(KEYED) | before.rlike(KEYED + "$"))

    at = F.filter(F.transform("_w", lambda w, i: F.when(F.length(w) >= keyed_length, F.when(worth(w, i + 1), i + 1))), lambda i: i.isNotNull())
    found = split.select("doc_id", "path", "_w", F.explode(at).alias("_i"))
    around = F.concat_ws(" ", *[word(F.col("_i") - 1 - k) for k in (3, 2, 1)])
    runs = found.select("doc_id", "path", F.col("_i").cast("long").alias("position"), word(F.col("_i") - 1).alias("word"), around.alias("_around"), word(F.col("_i")).alias("after"))
    runs = runs.withColumn("_runs", F.regexp_extract_all("word", F.lit(SHAPE + "+"), F.lit(0)))
    each = runs.select("*", F.posexplode("_runs").alias("_p", "_run"))
    inside = F.array_join(F.slice("_runs", F.greatest(F.col("_p") - 2, F.lit(1)), F.least(F.col("_p"), F.lit(3))), " ")
    each = each.select(
        "doc_id", "path", "position", (F.col("_p") + 1).cast("long").alias("part"), F.regexp_replace("_run", r"[.:\-]+$", "").alias("core"), "word",
        F.concat_ws(" ", "_around", F.when(F.col("_p") > 0, inside)).alias("before"), "after",
    )
    core = F.col("core")
    keyed = core.rlike(KEYED + value) | (core.rlike("^" + value) & (F.col("before").rlike(KEYED + "$")))
    return each.where((core.rlike(long) & (core.rlike(r"[0-9]") | core.rlike(CASES) | core.rlike(SHAPES))) | keyed)


def featured(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    core, known = F.col("core"), {*DICTIONARY, *(words or [])}
    n = F.greatest(F.length(core), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(core, F.lit(pattern)) / n

    changes = [r"[A-Za-z](?=[0-9])", r"[0-9](?=[A-Za-z])", r"[a-z](?=[A-Z])", r"[A-Z](?=[a-z])"]
    covered = (n - F.length(F.regexp_replace(F.lower(core), "(" + "|".join(sorted(known, key=lambda w: (-len(w), w))) + ")", ""))) / n

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    columns = {
        "f_length": n, "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_marks": share("[^A-Za-z0-9]"),
        "f_transitions": sum((F.regexp_count(core, F.lit(p)) for p in changes), F.lit(0)) / n,
        "f_distinct": F.size(F.array_distinct(F.split(core, ""))) / n,
        "f_hex": flag(F.regexp_extract(core, r"([0-9a-fA-F]{16,})", 1) != ""), "f_covered": covered,
        "f_path_test": flag(F.col("path").rlike("(?i)test|example|sample|doc")),
        "f_path_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "f_key_before": flag(F.col("before").rlike(KEYWORDS)), "f_key_inside": flag(core.rlike(KEYWORDS)),
        "f_equals": flag(F.concat_ws(" ", "before", core).rlike(r"[=:]\s*\S*$")), "f_quoted": flag(F.col("word").rlike("[\"'].*[\"']")),
        "f_key_after": flag(F.col("after").rlike(KEYWORDS)),
    }
    return found.withColumns(columns)


def settled() -> Column:
    """1 or 0 where a structural rule is sure, else null."""
    core = F.col("core")
    keyed = core.rlike(rf"{KEYWORDS}[=:][^=]{{8,}}$") | (F.col("before").rlike(KEYED + "$") & core.rlike(r"^[A-Za-z0-9_+/=\-]{8,}$"))
    return (
        F.when(core.rlike(rf"^(?:{SHAPES})$") | keyed, 1)
        .when(core.rlike(r"@[A-Za-z0-9\-]+\.") | core.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}") | core.rlike(r"^[0-9.:/\-]+$") | core.rlike(r"(?i)^https?:"), 0)
    )


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
    """(feature, threshold, left, right) or a leaf's share of secrets."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (_gini(y) - 1e-9, None, None)
    for f in rng.choice(x.shape[1], max(2, round(x.shape[1] ** 0.5) + 1), replace=False):
        values = np.unique(x[:, f])
        if len(values) > 32:
            values = np.unique(np.quantile(values, np.linspace(0, 1, 33)))
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            k = int(low.sum())
            if least <= k <= len(y) - least:
                g = (k * _gini(y[low]) + (len(y) - k) * _gini(y[~low])) / len(y)
                if g < best[0]:
                    best = (g, int(f), float(t))
    if best[1] is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, least: int = 3, seed: int = 11) -> list:
    rng = np.random.default_rng(seed)
    return [_grow(x[i], y[i], rng, depth, least) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def compiled(tree) -> str:
    """A tree as SQL."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, t, low, high = tree
    return f"CASE WHEN {FEATURES[f]} <= {t!r}D THEN {compiled(low)} ELSE {compiled(high)} END"


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, min_length: int = 12, keyed_length: int = 8, max_findings: int = 2000, trees: int = 15) -> DataFrame:
    """One row per candidate: doc_id, position, part, candidate (its first four characters and length), candidate_sha256, rule, score, is_secret."""
    rows = featured(candidates(docs, min_length, keyed_length), frequent_words(docs)).withColumn("rule", settled())
    rows = common.written(rows.drop("word", "before", "after", "path"), "candidates")
    if findings is None:
        known = rows.withColumn("_y", F.col("rule")).where("_y is not null")
    else:
        keys = ["doc_id", "position", *(["part"] if "part" in findings.columns else [])]
        marks = findings.where("is_secret is not null").groupBy(*keys).agg(F.max(F.col("is_secret").cast("int")).alias("_y"))
        known = rows.join(marks, keys)
    sample: list = []
    for y in (0, 1):
        sample += known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id", "position", "core"), "doc_id", "position", "part").limit(max_findings).select("_y", *FEATURES).collect()
    y = np.array([r[0] for r in sample], float)
    if len(y) and y.min() < y.max():
        grown = forest(np.array([r[1:] for r in sample], float), y, trees)
        score = F.expr("(" + " + ".join(f"({compiled(t)})" for t in grown) + f") / {float(trees)}D")
    else:
        score = F.lit(float(y[0]) if len(y) else 0.0)
    return rows.select(
        "doc_id", "position", "part", F.concat(F.substring("core", 1, 4), F.lit("*"), F.length("core").cast("string")).alias("candidate"),
        F.sha2(F.col("core").cast("binary"), 256).alias("candidate_sha256"), "rule", F.round(score, 6).alias("score"),
    ).withColumn("is_secret", F.col("score") >= threshold)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
