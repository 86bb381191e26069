"""Every registered query against its oracle on the smallest tables; and the package's import rules."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tindra.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    if (sql := registry.oracle_sql().get(name)) is None:
        return
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == order
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports():
    """Zones import downwards only, and nothing but the entry imports the optional subpackage."""
    for path in (ROOT / "tindra").rglob("*.py"):
        if "llm" in path.parts:
            continue
        assert not re.search(r"\bllm\b", path.read_text()), path
    above = {"functions": ("operators", "plans", "sources", "streaming"), "operators": ("plans", "streaming")}
    for low, highs in above.items():
        for path in (ROOT / "tindra" / low).glob("*.py"):
            assert not any(f"from ..{h}" in path.read_text() for h in highs), path
