"""Literal cases of text, time, score and track functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from notecheck.functions import numbers as N
from notecheck.functions import text as X
from notecheck.operators import anomaly, history, resolve, rules, tracks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def at(text):
    return int((datetime.datetime.fromisoformat(text) - datetime.datetime(1970, 1, 1)).total_seconds())


@pytest.mark.parametrize(
    ("start", "end", "alongside", "method", "s", "e", "crossed"),
    [
        ("2026-02-03 08:47:15", "2026-02-03 12:45:46", None, "ISO", "2026-02-03 08:47:15", "2026-02-03 12:45:46", False),
        ("11-Feb-2026 18:04:15", "11-Feb-2026 21:10:15", None, "ISO", "2026-02-11 18:04:15", "2026-02-11 21:10:15", False),
        ("02/03/2026 21:22", "03/03/2026 02:00", None, "US_DATE", "2026-03-02 21:22", "2026-03-03 02:00", False),
        ("15:12 hrs. @ 25/11/2025", "18:00 hrs. @ 25/11/2025", None, "HRS_AT", "2025-11-25 15:12", "2025-11-25 18:00", False),
        ("17-11-2025 @ 1000 HRS", "17-11-2025 @ 1400 HRS", None, "DATE_AT_HRS", "2025-11-17 10:00", "2025-11-17 14:00", False),
        ("1850", "1945", "15 FEB 2026 1810", "INHERITED", "2026-02-15 18:50", "2026-02-15 19:45", False),
        ("2350", "0430", "1 MARCH 2026 2300", "INHERITED", "2026-03-01 23:50", "2026-03-02 04:30", True),
    ],
)
def test_pumping_times(spark, start, end, alongside, method, s, e, crossed):
    r = one(spark, X.parse_pumping_times(F.lit(start), F.lit(end), F.lit(alongside).cast("string")))
    assert (r.method, r.start_s, r.end_s, r.crossed) == (method, at(s), at(e), crossed)


def test_failed_times(spark):
    r = one(spark, X.parse_pumping_times(F.lit(""), F.lit("2026-02-03 12:00"), F.lit(None).cast("string")))
    assert (r.method, r.start_s, r.end_s) == ("FAILED", None, None)
    assert one(spark, X.parse_iso(F.lit("2026-02-31 08:00:00"))) is None


@pytest.mark.parametrize(("f", "given", "want"), [(X.to_number, "1,175.25 MT", 1175.25), (X.normalize_density, "991.0", 0.991), (X.to_number, "none", None), (X.normalize_imo, "IMO 9123456", "9123456"), (X.normalize_imo, "12", None), (X.slug, " M/V Old-Name ", "m_v_old_name"), (X.barge_key, "mt sea-star 2", "SEASTAR2"), (X.normalize_vessel_name, "M.V. OCEAN  QUEEN", "Ocean Queen"), (X.normalize_time_only, "2:30 PM", "14:30"), (X.normalize_time_only, "1430 HRS", "14:30"), (X.normalize_timestamp, "11Feb2026", "11 Feb 2026 00:00"), (X.bdn_reference, "BDN No: AB-12/7", "AB-12/7")])
def test_text(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_token_sort_ratio(spark):
    pairs = [("A B", "B A", 100.0), ("LUCKY PIONEER", "LUCKY PIONER", 96.0), ("", "", 100.0), ("X", "", 0.0), ("AB", "CD", 0.0)]
    for a, b, want in pairs:
        assert one(spark, X.token_sort_ratio(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_tracks(spark):
    d = spark.createDataFrame([(1, "v", "b", 0, 7200, 300.0), (2, "x", "y", 0, 3600, 1.0)], "id long, vessel_mmsi string, barge_mmsi string, start_s long, end_s long, quantity_mt double")
    p = spark.createDataFrame([("v", 100, 1, 1.0, 1.0, 1.0, 10.0), ("v", 200, 2, 1.0, 1.0, None, 10.0), ("b", 100, 3, 1.0, 1.0, 1.0, 5.0)], "mmsi string, ts long, seq long, lat double, lon double, speed double, heading double")
    r = {x.id: x for x in tracks.build_features(d, p).collect()}
    assert r[1].pairs == 1 and r[1].colocation_ratio == 1.0 and r[1].heading_correlation == 0 and r[1].quantity_feasible and r[1].vessel_speed_mean == 0.5
    assert r[2].n_vessel == 0 and r[2].colocation_ratio == 0
    assert tracks.build_features(d, p, fetch_barge=False).where("pairs > 0").count() == 0


def test_radius_over_the_date_line(spark):
    a = spark.createDataFrame([(1, 0.0, 179.999), (2, 80.0, 0.0)], "point_id long, lat double, lon double")
    b = spark.createDataFrame([(1, 0.0, -179.999), (2, 80.0, 0.2)], "ship_id long, ship_lat double, ship_lon double")
    got = {(r.point_id, r.ship_id) for r in resolve.within_radius(a, b, 5.0).collect()}
    assert got == {(1, 1), (2, 2)}


def test_scores(spark):
    assert sum(rules.DEFAULT.confidence_weights.values()) == pytest.approx(1) and sum(rules.DEFAULT.score_weights.values()) == pytest.approx(1)
    assert one(spark, N.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.19, abs=0.01)
    assert one(spark, N.quantity_feasibility(F.lit(None).cast("double"), F.lit(1.0))) == 0.5
    assert one(spark, rules.severity(F.lit("BARGE_MISSING"))) == "MEDIUM" and one(spark, rules.severity(F.lit("NEW"))) == "MEDIUM"


def test_duplicates(spark):
    n = spark.createDataFrame([(i, "A", "P", "d") for i in range(8)] + [(9, "a", "p", "d"), (10, None, "P", "d")], "note_id long, vessel_name string, port string, delivery_date string")
    got = {r.note_id: r for r in history.duplicates(n).collect()}
    assert 10 not in got and got[9].duplicates == 8 and got[9].others == [0, 1, 2, 3, 4] and got[0].others == [1, 2, 3, 4, 5]


def test_forest_finds_shifted_rows(spark):
    rows = [(i, (i * 37 % 100) / 100.0, (i * 61 % 100) / 100.0) for i in range(500)] + [(1000, 9.0, 9.0)]
    f = spark.createDataFrame(rows, "id long, a double, b double")
    p = anomaly.ForestParams(trees=20, psi=64)
    s = anomaly.anomaly_scores(anomaly.raw_scores(f, "id", ["a", "b"], anomaly.fit_forest(f, "id", ["a", "b"], p), p), p).collect()
    assert max(s, key=lambda r: r.anomaly_score).id == 1000
    again = anomaly.fit_forest(f.repartition(7), "id", ["a", "b"], p)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, anomaly.fit_forest(f, "id", ["a", "b"], p).collect()))


def test_written_documents_are_bounded(spark):
    from notecheck.plans import rest

    p = spark.range(14000).select(F.when(F.col("id") < 12000, 1).otherwise(2).alias("mmsi"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(3.0).alias("speed"), F.lit(4.0).alias("heading"), (F.col("id") * 20).alias("ts"))
    path = rest._archived(spark, p)
    sizes = [r[0] for r in spark.read.schema("positions array<struct<lat:double>>").json(path).select(F.size("positions")).collect()]
    assert max(sizes) <= 5000 and sum(sizes) == 14000
    v = spark.range(120000).select(F.col("id").cast("string").alias("imo"), F.lit("n").alias("name"))
    docs = spark.read.text(rest._as_documents(spark, v, "vessels-test")).select(F.size(F.from_json("value", "array<struct<imo:string>>")))
    sizes = [r[0] for r in docs.collect()]
    assert max(sizes) <= 6000 and sum(sizes) == 120000


def test_earlier_within(spark):
    """Counts and first ids against all pairs: ties, both ends of the window, null keys and times, a key of many rows."""
    import random

    rng = random.Random(7)
    day = 86400
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["p", "q"]), rng.choice([None, *(90 * day * k + rng.choice([-1, 0, 1, 50 * day]) for k in range(5))])) for i in range(300)] + [(1000 + i, "hot", "p", 7 * i) for i in range(400)]
    got = {r.note_id: (r.earlier, r.others) for r in history.earlier_within(spark.createDataFrame(rows, "note_id long, v string, w string, t long").repartition(5), ["v", "w"], "t", 90, 3).collect()}
    want = {}
    for i, v, w, t in rows:
        found = sorted((u, j) for j, x, y, u in rows if j != i and v is not None and (x, y) == (v, w) and None not in (t, u) and t - 90 * day <= u and (u, j) < (t, i))
        if found:
            want[i] = (len(found), [j for _, j in found[:3]])
    assert got == want and got[1399][0] == 399


def test_repeats_within(spark):
    day = 86400
    notes = spark.createDataFrame([(1, "A", "P", "d", "r1", 0), (2, "a", "p", "d", "R1", 90 * day), (3, "a", "p", "d", "r1", 90 * day + 1), (4, "b", "p", "d", "r1", 90 * day + 2), (5, None, "p", "d", None, 5)], "note_id long, vessel_name string, port string, delivery_date string, bdn_reference string, received_s long")
    got = {r.note_id: tuple(r)[1:] for r in history.repeats_within(notes).collect()}
    assert got == {2: (1, [1], 1, False), 3: (1, [2], 1, False), 4: (0, [], 2, True)}


def test_stored_forest(spark, tmp_path):
    """Fitted once, read back and scoring other batches: the scores of plain walks through the stored nodes."""
    path, columns = f"file://{tmp_path}/model", ["a", "b"]
    p = anomaly.ForestParams(trees=12, psi=32)
    frame = lambda rows: spark.createDataFrame(rows, "id long, a double, b double")
    assert anomaly.load_model(spark, path) is None and [tuple(r) for r in anomaly.score(frame([(1, 0.0, 0.0)]), "id", None).collect()] == [(1, None, 0.5, False)]
    train = [(i, (i * 37 % 100) / 100.0, (i * 61 % 100) / 100.0) for i in range(300)]
    assert anomaly.fit_model(frame(train), "id", columns, path, p).version == 1
    model = anomaly.load_model(spark, path)
    assert (model.columns, model.params, model.version) == (tuple(columns), p, 1)
    nodes = {(n.tree, n.node): n for n in model.nodes.collect()}
    trees = sorted({t for t, _ in nodes})
    norm = anomaly._c(max(n.size for (_, k), n in nodes.items() if k == 0))

    def walk(x):
        total = 0.0
        for t in trees:
            n = nodes[t, 0]
            while n.feature >= 0:
                n = nodes[t, n.left if x[n.feature] < n.cut else n.right]
            total += n.depth + anomaly._c(n.size)
        return 2.0 ** -(total / len(trees) / norm)

    low, high = model.ends
    assert low == pytest.approx(min(walk(r[1:]) for r in train)) and high == pytest.approx(max(walk(r[1:]) for r in train))
    for batch in ([(1, 9.0, 9.0), (2, 0.5, 0.5)], [(i, i / 7.0 - 2, 0.3) for i in range(40)]):
        for r in anomaly.score(frame(batch), "id", model).collect():
            x = next(b[1:] for b in batch if b[0] == r.id)
            want = max(0.0, min(1.0, (walk(x) - low) / (high - low)))
            assert r.raw == pytest.approx(walk(x)) and r.anomaly_score == pytest.approx(want, abs=6e-5) and r.is_anomaly == (r.anomaly_score >= 0.55)
    assert anomaly.fit_model(frame(train[:50]), "id", columns, path, p).version == 2 and anomaly.load_model(spark, path, 1).ends == model.ends and anomaly.load_model(spark, path, 7) is None
    with pytest.raises(ValueError):
        anomaly.score(frame(train).drop("b"), "id", model)


def test_stream_state(spark, tmp_path):
    from notecheck.streaming import jobs

    path, schema, day = f"file://{tmp_path}/seen", "note_id long, received_s long", 86400
    assert jobs.remembered(spark, path, schema, 0, None).count() == 0
    for number, rows in enumerate([[(1, 0), (2, 5 * day)], [(3, 6 * day)], []]):
        jobs.remember(spark.createDataFrame(rows, schema), path, number, "received_s")
    jobs.remember(spark.createDataFrame([(3, 6 * day), (4, 6 * day)], schema), path, 1, "received_s")
    ids = lambda *a: sorted(r.note_id for r in jobs.remembered(spark, path, schema, *a).collect())
    assert ids(1, None) == [1, 2] and ids(2, None) == [1, 2, 3, 4] and ids(2, 5 * day + 7) == [2, 3, 4]
    assert jobs.forget(spark, path, 6 * day) == 2 and ids(9, None) == [3, 4]


def test_repeated_keys(spark):
    """Null keys equal nothing; the rows of a frequent key are dealt and all found."""
    from notecheck.operators import quality

    rows = [(i, "hot", 1) for i in range(500)] + [(1000, None, 1), (1001, None, 1), (1002, "a", None), (1003, "a", None), (1004, "b", 2), (1005, "c", 3), (1006, "c", 3), (1006, "c", 3)]
    d = spark.createDataFrame(rows, "id long, `k.x` string, v int").repartition(3)
    got = sorted((r.id, r.again) for r in quality.repeated(d, ["k.x", "v"], "again", most=50).collect())
    assert got == sorted((i, k == "hot" or i in (1005, 1006)) for i, k, _ in rows)
    assert quality.repeated(d, ["k.x"], "again").columns == ["id", "k.x", "v", "again"]


def test_values(spark):
    from notecheck.operators import extract

    for given, want in [("OP BRAZIL Next Port: X", "OP BRAZIL"), ("Number", None), ("A B C D E", "A B C D"), ("Metering 3", None), ("SEA ; | x", "SEA ; | x"), ("SEA ;| x", "SEA")]:
        assert one(spark, extract.cap_value(F.lit(given), 4)) == want
    assert one(spark, extract.plausible_text(F.lit("29:75"), "start_time")) is None and one(spark, extract.plausible_text(F.lit("09:75"), "start_time")) == "09:75" and one(spark, extract.plausible_text(F.lit("soon"), "end_time")) == "soon"
    assert one(spark, extract.plausible_text(F.lit("LICENCE NO 2"), "supplier")) is None


def test_label_search(spark):
    """Every label of the dictionary finds its field, as it stands and misread; bare labels are no values; prose is no label."""
    from notecheck.operators import extract

    rows = [(i, f"Heading\n{x.title()}: value {i}\nend") for i, (f, x) in enumerate((f, x) for f, xs in extract.LABELS.items() for x in xs)]
    fields = [f for f, xs in extract.LABELS.items() for _ in xs]
    found = {(r.note_id, r.field): r.value for r in extract.find_fuzzy(spark.createDataFrame(rows, "note_id long, raw_text string"), extract.LABELS).collect() if r.score == 100}
    assert all(found.get((i, f)) == f"value {i}" for i, f in enumerate(fields))
    text = "Vessel Name:\nPort:\n\nSingapore\nQuantity Delivered   12.5 MT\nBunker Tanker\nSEA STAR\nSupplier Eastern Fuels\nthe ship is a good ship to be in for the whole of the long day at sea and more\nDnsity\tx"
    got = {r.field: (r.value, r.score) for r in extract.find_fuzzy(spark.createDataFrame([(1, text)], "note_id long, raw_text string"), extract.LABELS, layouts=True).collect()}
    assert "vessel_name" not in got and got["port"] == ("Singapore", 100) and got["quantity_mt"] == ("12.5 MT", 100) and got["barge_name"] == ("SEA STAR", 100) and got["supplier"] == ("Eastern Fuels", 100) and got["density"] == ("x", 85.714)


def test_barges_that_share_a_number(spark):
    n = spark.createDataFrame([(1, "SB1 A"), (2, "SB2B"), (3, None)], "note_id long, barge_sb_number string")
    b = spark.createDataFrame([("SB1A", "X", "1", "1"), ("SB 1a", "Y", "2", "2"), ("SB1A", "X", "3", "3")], "sb_number string, name string, mmsi string, imo string")
    rows = lambda df: sorted((r.note_id, r.sb_hit and r.sb_hit.name) for r in df.collect())
    assert rows(resolve.by_sb_number(n, b, every=True)) == [(1, "X"), (1, "X"), (1, "Y"), (2, None), (3, None)]
    assert rows(resolve.by_sb_number(n, b)) == [(1, "X"), (2, None), (3, None)]


def test_sb_numbers_of_many_suppliers(spark, tmp_path):
    """From 10,000 suppliers on, numbers repeat; the query gives the rows of its SQL."""
    import collections
    import os

    import duckdb

    import __spark_entry__ as entry

    small, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events"):
        os.symlink(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    duck.execute(f"copy (select s.* replace (s_suppkey + 1000 * i as s_suppkey) from read_parquet('/root/testdata/sf0.1/supplier.parquet') s, range(60) r(i)) to '{tmp_path}/supplier.parquet'")
    for t in ("customer", "part", "orders", "lineitem", "events", "supplier"):
        duck.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    got = collections.Counter((r.note_id, r.barge) for r in entry.queries()["jn_05_by_sb_number"](spark, str(tmp_path)).collect())
    want = collections.Counter(duck.execute(f"select note_id, barge from ({entry.oracle_sql()['jn_05_by_sb_number']})").fetchall())
    assert got == want and sum(want.values()) > len({n for n, _ in want})
