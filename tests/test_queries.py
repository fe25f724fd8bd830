"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from gleanframe.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    import verify

    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    want = sorted((tuple(verify.plain(r[names.index(k)]) for k in key) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(verify.plain(r[k]) for k in key) for r in df.collect()), key=repr) == want


def test_suffixes_by_comparing_each_path_with_each_file(spark, con):
    sql = catalogue.oracle_sql()["suffix_matches"]
    at = sql.index("t AS (SELECT path, split")
    whole = sql[:at] + "m AS (SELECT path, count(file) AS n, min(file) AS f FROM q LEFT JOIN d ON ends_with(path, '/' || file) GROUP BY 1) SELECT path, CASE WHEN n = 1 THEN f END AS file, n AS matches FROM m"
    cur = con.execute(whole)
    at = [[d[0] for d in cur.description].index(c) for c in ("path", "file", "matches")]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r) for r in catalogue.queries()["suffix_matches"](spark, SF).select("path", "file", "matches").collect()), key=repr)
    assert got == want and len(got) == con.execute("SELECT count(DISTINCT path) FROM photos JOIN shoots USING (shoot)").fetchone()[0]


def test_replies_name_every_candidate(spark, con):
    ids = [r[0] for r in con.execute("SELECT DISTINCT id FROM candidates WHERE id IS NOT NULL").fetchall()]
    rows = catalogue.queries()["parsed_replies"](spark, SF).collect()
    assert sorted(r["id"] for r in rows) == sorted(ids) and max(r["place"] for r in rows) <= 11
