"""Features from arrays of shared tracks against those from a row for each point of each delivery, and how many rows are shuffled for them."""

import math
import random

import pytest

from notecheck.operators import tracks

DELIVERY = "id long, vessel_mmsi string, barge_mmsi string, start_s long, end_s long, quantity_mt double"
POSITION = "mmsi string, ts long, seq long, lat double, lon double, speed double, heading double"
DAY = 86400


def made(spark, ships, deliveries, points, seed=3):
    r = random.Random(seed)
    maybe = lambda x, share=0.1: None if r.random() < share else x
    p = [(maybe(f"s{r.randrange(ships)}", 0.02), maybe(r.randrange(-3 * DAY, 40 * DAY), 0.02), i, maybe(1 + r.random() / 100), maybe(103 + r.random() / 100), maybe(r.random() * 6), maybe(float(r.choice([0.1, 90, 359])))) for i in range(points)]
    p += [("still", 9 * DAY + i, 10**6 + i, 1.1, 103.1, 0.1, 0.1) for i in range(7)] + [("still", 9 * DAY, 10**6 + 50, 1.2, 103.2, 0.1, 0.1)]
    d = []
    for i in range(deliveries):
        start = r.randrange(-2 * DAY, 38 * DAY)
        d.append((i, maybe(f"s{r.randrange(ships)}"), maybe(f"s{r.randrange(ships)}"), maybe(start), maybe(start + r.choice([-DAY, 0, 3600, DAY, 4 * DAY, 20 * DAY, 60 * DAY])), maybe(r.random() * 900)))
    d += [(10**6, "still", "still", 9 * DAY, 9 * DAY + 5, 1.0), (10**6 + 1, "still", "none", 9 * DAY, 9 * DAY + 5, 1.0), (10**6 + 2, "none", "still", 9 * DAY, 9 * DAY + 5, 1.0)]
    return spark.createDataFrame(d, DELIVERY), spark.createDataFrame(p, POSITION)


def rows(df):
    return {r.id: r.asDict() for r in df.collect()}


@pytest.mark.parametrize(("options", "limits"), [({}, {"wide": 100}), ({"clip": True}, {"dense": 60, "wide": 100}), ({"fetch_barge": False}, {"wide": 10})])
def test_arrays_equal_points(spark, options, limits):
    d, p = made(spark, 5, 300, 1500)
    got, want = rows(tracks.build_features(d, p, **options, **limits)), rows(tracks.build_features(d, p, **options, dense=-1, wide=-1))
    assert got.keys() == want.keys() and len(got) == 303
    for i, w in want.items():
        for c, v in w.items():
            assert got[i][c] == v or math.isclose(got[i][c], v, rel_tol=1e-6, abs_tol=1e-6), (i, c, got[i][c], v)
    assert sum(w["pairs"] > 1 for w in want.values()) > (100 if options == {} else -1)


def shuffled(plan):
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() and "Exchange" in plan.nodeName() else 0) + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_points_are_not_shuffled_for_each_delivery(spark):
    d, p = made(spark, 2, 2000, 1000)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        f = tracks.build_features(d.where("end_s < start_s + 5 * 86400"), p)
        points = sum(r.n_vessel + r.pairs for r in f.collect())
        assert points > 40_000 and shuffled(f._jdf.queryExecution().executedPlan()) < 6_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
