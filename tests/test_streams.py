"""Streams of positions against their SQL, on times that lie within one second or just a gap apart."""

import collections
import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from notecheck.plans.registry import ORACLES

AT = datetime.datetime(2024, 1, 1, 10, 0, 0)
#: Per ship the times in seconds: twice in a second; a gap of 3600 whole seconds but of less by the clock; of 3599 but of more; of 3600 and 3599 sharp; and of 3600 up to the watermark.
TIMES = {1: [0.1, 0.9], 2: [0.9, 3600.2], 3: [0.0, 3599.9], 4: [0.1, 3600.1, 7200.0], 5: [0.0, 3600.0, 7199.0], 6: [5.5, 3605.4, 7205.3], 7: [80000.7, 72800.9], 8: [72800.7], 9: [72799.9]}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    rows = [(u, s) for u, ss in TIMES.items() for s in ss]
    made = [(i, AT + datetime.timedelta(seconds=s), u, "click", 100.0 + i, "{}") for i, (u, s) in enumerate(rows)]
    frame = spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("name", ["sm_01_distinct_positions", "sm_02_interval_statistics", "sm_03_sessions"])
def test_times_within_a_second(spark, events, name):
    got = entry.queries()[name](spark, events)
    cols = sorted(got.columns)
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{events}/events.parquet')")
    want = duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    at = [names.index(c) for c in cols]
    assert collections.Counter(tuple(r[c] for c in cols) for r in got.collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())
