"""Every query with SQL gives the rows that the SQL gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(map(repr, (tuple(plain(r[k]) for k in order) for r in found)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_turns_are_aligned(spark, con):
    """Alignment and synchronisation have a page for each turn that has words, and each of its tokens."""
    want = {p: n for p, n in con.execute(r"SELECT conv_id || '/' || turn, len(regexp_extract_all(text, '\S+')) FROM conversations WHERE regexp_matches(text, '\S')").fetchall()}
    assert any(not p.endswith("/0") for p in want)
    tokens = {r.page_id: r.n for r in catalog.queries()["align_turns"](spark, SF).where("ref_idx IS NOT NULL").groupBy("page_id").agg({"ref_idx": "count"}).toDF("page_id", "n").collect()}
    assert tokens == want
    assert {r.page_id for r in catalog.queries()["align_stats"](spark, SF).collect()} == set(want)
    assert {r.page_id for r in catalog.queries()["sync"](spark, SF).collect()} == set(want)
    assert {r.page_id for r in catalog.queries()["aligned_words"](spark, SF).select("page_id").distinct().collect()} == set(want)
