"""Every registered query over the given tables, against its SQL where there is one."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

# Long fits without SQL; what they do is tested in test_models and test_end_to_end.
LONG = {"topic_words_learned_prior", "topic_chain", "analyze_posts_trained"}


@pytest.fixture(scope="module")
def con(data_dir):
    con = duckdb.connect()
    for path in sorted(Path(data_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def as_bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def test_registration():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(queries()) - LONG))
def test_query(spark, data_dir, con, name):
    df = queries()[name](spark, data_dir)
    rows = df.collect()
    if name not in oracle_sql():
        assert rows
        return
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = as_bag(names, cursor.fetchall())
    got = as_bag(df.columns, rows)
    assert sorted(names) == sorted(df.columns)
    assert list((got - want).items())[:3] == [] and list((want - got).items())[:3] == []


def test_entry(spark, data_dir):
    rows = entry(spark).collect()
    assert rows
    sizes = [sum(r["temp_counts"].values()) for r in rows]
    assert sizes == sorted(sizes, reverse=True)
    for r in rows:
        shares = [float(t.split("(")[1].rstrip("%)")) for t in r["temp_percentages"].values()]
        assert math.isclose(sum(shares), 100, abs_tol=0.1 * len(shares))
