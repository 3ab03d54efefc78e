"""Every registered query of this subpackage runs at the smallest scale, with its contract's columns and rows; those with SQL equal it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidefeed.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
DOCUMENTS, VECTORS = 200, 500
COLUMNS = {
    "op1": ("doc_id held_out n_tokens n_known train_tokens base_score score", DOCUMENTS),
    "op2": ("doc_id keep_id group_size kept text_sha256", DOCUMENTS),
    "op3": ("doc_id held_out score predicted", DOCUMENTS),
    "op4": ("doc_id fingerprint component_id", DOCUMENTS),
    "op5": ("doc_id position part candidate_sha256 score is_secret", None),
    "op6": ("doc_id expected_grade p_ge1 p_ge2 selected", DOCUMENTS),
    "op7": ("doc_id n_bytes n_tokens over_limit", DOCUMENTS),
    "op8": ("doc_id size source_size target taken", DOCUMENTS),
    "op9": ("doc_id", DOCUMENTS),
    "op10": ("doc_id n_bytes n_removed n_spans kept_sha256", DOCUMENTS),
    "op11": ("doc_id n_words n_removed kept_sha256", DOCUMENTS),
    "op12": ("vec_id component n deviation whitened explained identity_error", 8 * VECTORS),
    "op13": ("vec_id code error label_error codebooks_sha256", VECTORS),
    "pipeline": ("doc_id taken", None),
}


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted(COLUMNS) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    columns, n = COLUMNS[name.split("_")[0]]
    assert set(columns.split()) <= set(df.columns) and (len(rows) == n if n else 0 < len(rows))


def plain(rows):
    return sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(want.fetchall())
