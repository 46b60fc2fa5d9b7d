"""Registered queries against their SQL; the layering of the package."""

from __future__ import annotations

import ast
import decimal
from pathlib import Path

import pytest

from quillspark.plans.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(repr({k: plain(v) for k, v in sorted(zip(columns, r, strict=True))}) for r in cursor.fetchall())
    got = sorted(repr({k: plain(v) for k, v in sorted(r.asDict().items())}) for r in QUERIES[name](spark, sf_dir).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""


def test_layers():
    files = [p for p in (ROOT / "quillspark").rglob("*.py") if "llm" not in p.parts]
    assert len(files) > 15
    for p in files:
        own = list(imports(p))
        assert not any(m.startswith("quillspark.llm") for m in own), p
        if p.parts[-2] in ("functions", "operators"):
            assert not any(m.startswith(("quillspark.sources", "quillspark.plans", "quillspark.streaming")) for m in own), p
