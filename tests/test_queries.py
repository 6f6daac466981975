import math

import duckdb
import pytest

import __spark_entry__ as entry
from restora.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall()], key=repr)
    assert sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_mediation_interval_has_all_draws(spark):
    row = queries.QUERIES["d23_mediation_interval"](spark, SF).first()
    assert row.DRAWS == 5000 and row.LOW < row.HIGH


def test_scored_sessions_come_in_parts(spark, monkeypatch):
    """Where sessions are scored their parts follow from the number of rows, and are not merged by bytes."""
    monkeypatch.setattr(queries.study_views, "PART", 100)
    parts = -(-spark.read.parquet(f"{SF}/events.parquet").count() // 100)
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count(f", {parts}), REPARTITION_BY_NUM")
    assert dealt(queries.scores(spark, SF)) == 1 and dealt(queries.idle_scores(spark, SF)) == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_weekly_usage_of_odd_events(spark, tmp_path):
    """Times in the last half second of a week, ids that users share, repeated events, and events without id or time."""
    c, name = duckdb.connect(), "k01_windowed_usage"
    c.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar)")
    late, early = "2024-01-10 23:59:59.7", "2024-01-11 00:00:00"
    rows = [(1, late, 5, "view"), (2, early, 5, "view"), (1, late, 6, "view"), (1, early, 6, "view"), (None, late, 6, "view"), (3, None, 6, "view"), (1, late, 6, "click")]
    c.executemany("insert into events values (?, ?, ?, ?)", rows)
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select("PATIENT_ID", "PROTOCOL_ID", "WEEK", "USAGE").collect()]
    assert sorted(got) == sorted(c.execute(queries.ORACLES[name]).fetchall()) == [(6, "view", 2818, 1), (6, "view", 2819, 1), (7, "click", 2818, 1), (7, "view", 2818, 1)]
