"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest

from marlstone.plans import company_queries, model_queries, source_queries  # noqa: F401  register their queries
from marlstone.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.sql(f"create view {f.stem} as select * from '{f}'")
    return db


def cells(rows):
    return sorted(tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_noise_headings_are_judged_whole(spark, tmp_path):
    values = {0: "1.2.3 Risk report\n12\n\nText", 1: "1.2.3\nRisk", 2: "12345 shares", 3: "3 / 14", 4: "- \n--", 5: "", 6: None, 7: "2025 outlook\n1.2.3.4\n1.2.3.45"}
    spark.createDataFrame(list(values.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.noise, r.n_noise) for r in QUERIES["text_flags"](spark, str(tmp_path)).collect()}

    def noise(line):
        h = line.strip()
        return h in ("", ":", "-", "--") or bool(re.fullmatch(r"\d{1,3}(\s*/\s*\d{1,3})?", h)) or bool(re.fullmatch(r"\d+(\.\d+){1,3}", h)) and len(h) <= 7

    want = {i: [noise(x) for x in (t or "").split("\n")] for i, t in values.items()}
    assert got == {i: (flags[0], sum(flags)) for i, flags in want.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in order)).collect()
    if name in ORACLE_SQL:
        want = sql.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == order
        assert cells(got) == cells(want.select(*(f'"{c}"' for c in order)).fetchall())
    else:
        assert got
