"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from fieldsong.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return str(sorted(v.asDict().items()))
    if isinstance(v, dict):
        return str(sorted(v.items()))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(str(plain(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE:
        assert len(df.columns) == len(set(df.columns))
        return
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table_of(df.columns, rows) == table_of(want.columns, want.fetchall())


def test_all_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_whole_jobs_leave_no_recorder_out(spark, sf_dir):
    rows = lambda name: QUERIES[name](spark, sf_dir).collect()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    recorders = {r.user_id for r in events.select("user_id").distinct().collect()}
    user = {r.event_id: r.user_id for r in events.select("event_id", "user_id").collect()}
    assert {user[r.ord] for r in rows("sheet_rows")} == recorders
    assert {r.rec % 2 for r in rows("annotation_diff")} == {0, 1}
    hours = rows("discretise_presence")
    assert {r.rec for r in hours} == recorders
    assert any(r.present and r.bin >= 72 for r in hours)
