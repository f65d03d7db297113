"""Queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from kohesion import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows):
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


SLOW = {"consensus_pairs", "consensus_pair_scores"}


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - SLOW))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = duck.execute(queries.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    have = [tuple(r[c] for c in columns) for r in df.collect()]
    a, b = normal(have), normal(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == pytest.approx(q, abs=2e-5) if isinstance(p, float) else p == q for p, q in zip(x, y, strict=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_training_data_operators():
    """Nothing outside the subpackage names it, but for the driver's entry."""
    from pathlib import Path

    root = Path(__file__).parents[1]
    for file in root.glob("kohesion/**/*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "llm" not in file.read_text(), file
