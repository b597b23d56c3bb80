"""Registered queries against their SQL at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from lexmeta.plans import catalog

SMALL = os.environ.get("LEXMETA_TEST_DIR", "/root/testdata/sf0.001")
SLOW = {"d7_meta_correlation", "d5_r_hum"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.execute(catalog.oracle_sql()[name])
    at = [[x[0] for x in rel.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_core_stands_without_the_text_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "lexmeta"
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        names = [a.name for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.Import) for a in n.names]
        names += [n.module or "" for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.ImportFrom)]
        assert not any("llm" in x for x in names), f
