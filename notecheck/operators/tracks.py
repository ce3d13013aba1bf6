"""Ship tracks during deliveries: window join, pairing, features and flags.

deliveries: id, vessel_mmsi, barge_mmsi, start_s, end_s, quantity_mt. positions: mmsi, ts (seconds), seq, lat, lon, speed, heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import haversine_km, haversine_m, quantity_feasibility, rounded
from ..functions.text import let
from ..params import DEFAULT, Params
from ..sources.store import spread, staged

DAY = 86400
FEATURES = ["mean_vessel_barge_distance_m", "var_vessel_barge_distance_m", "vessel_speed_mean", "vessel_speed_var", "heading_correlation", "colocation_ratio", "position_drift_rate", "port_distance_km", "quantity_feasibility"]


def day_of(seconds: Column) -> Column:
    return F.floor(seconds / DAY).cast("long")


def window_positions(deliveries: DataFrame, positions: DataFrame, clip: bool = False) -> DataFrame:
    """Positions of vessel and barge on the days of each delivery (clipped to its times if asked): an equi-join on ship and day."""
    asked = deliveries.select("id", "start_s", "end_s", F.explode(F.array(F.struct(F.lit("vessel").alias("role"), F.col("vessel_mmsi").alias("mmsi")), F.struct(F.lit("barge").alias("role"), F.col("barge_mmsi").alias("mmsi")))).alias("s"))
    days = asked.select("id", "start_s", "end_s", "s.role", "s.mmsi", F.explode(F.sequence(day_of(F.col("start_s")), day_of(F.greatest("start_s", "end_s")))).alias("day"))
    track = days.join(positions.withColumn("day", day_of(F.col("ts"))), ["mmsi", "day"])
    if clip:
        track = track.where((F.col("ts") >= F.col("start_s")) & (F.col("ts") <= F.col("end_s")))
    return track.select("id", "role", "mmsi", "ts", "seq", "lat", "lon", "speed", "heading")


def indexed(track: DataFrame) -> DataFrame:
    """With the place of each position in its track."""
    return track.withColumn("rn", F.row_number().over(W.partitionBy("id", "role").orderBy("ts", "seq")))


def paired(track: DataFrame) -> DataFrame:
    """Vessel and barge points of equal place, up to the shorter track; one shuffle, no self-join."""
    point = F.struct("ts", "lat", "lon", "speed", "heading")
    both = indexed(track).groupBy("id", "rn").agg(F.max(F.when(F.col("role") == "vessel", point)).alias("v"), F.max(F.when(F.col("role") == "barge", point)).alias("b"))
    return both.where("v is not null and b is not null")


def paired_asof(track: DataFrame) -> DataFrame:
    """Each vessel point with the barge's latest point at or before it."""
    barge = F.when(F.col("role") == "barge", F.struct("ts", "lat", "lon", "heading"))
    order = W.partitionBy("id").orderBy("ts", "role", "seq").rowsBetween(W.unboundedPreceding, 0)
    return track.withColumn("b", F.last(barge, ignorenulls=True).over(order)).where((F.col("role") == "vessel") & F.col("b").isNotNull())


def pair_distance(p: Params = DEFAULT) -> Column:
    return haversine_m(F.col("v.lat"), F.col("v.lon"), F.col("b.lat"), F.col("b.lon"), p)


def heading_correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation held to -1..1; 0 for fewer than two pairs or no variance."""
    value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def variance(x: Column) -> Column:
    """Aggregate: population variance, 0 for fewer than two values."""
    return F.coalesce(F.when(F.count(x) >= 2, F.var_pop(x)), F.lit(0.0))


def pair_statistics(track: DataFrame, p: Params = DEFAULT) -> DataFrame:
    d = pair_distance(p)
    return paired(track).withColumn("d", d).groupBy("id").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("d").alias("mean_vessel_barge_distance_m"),
        variance(F.col("d")).alias("var_vessel_barge_distance_m"),
        F.avg(F.when(F.col("d") <= p.max_distance_m, 1.0).otherwise(0.0)).alias("colocation_ratio"),
        heading_correlation(F.coalesce(F.col("v.heading"), F.lit(0.0)), F.coalesce(F.col("b.heading"), F.lit(0.0))).alias("heading_correlation"),
    )


def vessel_statistics(track: DataFrame, port_lat: float, port_lon: float, p: Params = DEFAULT) -> DataFrame:
    vessel = track.where("role = 'vessel'").withColumn("at", F.struct("ts", "seq", "lat", "lon"))
    speed = F.coalesce(F.col("speed"), F.lit(0.0))
    s = vessel.groupBy("id").agg(F.count(F.lit(1)).alias("n_vessel"), F.avg(speed).alias("vessel_speed_mean"), variance(speed).alias("vessel_speed_var"), F.min("at").alias("a"), F.max("at").alias("z"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    hours = F.greatest((F.col("z.ts") - F.col("a.ts")) / 3600.0, F.lit(1e-6))
    drift = F.when(F.col("n_vessel") >= 2, haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon"), p) / hours).otherwise(0.0)
    return s.select("id", "n_vessel", "vessel_speed_mean", "vessel_speed_var", "lat", "lon", drift.alias("position_drift_rate"), haversine_km(F.col("lat"), F.col("lon"), F.lit(port_lat), F.lit(port_lon), p).alias("port_distance_km"))


#: Days of a bucket of tracks; points of a ship in a bucket and days of a window up to which tracks are joined as arrays.
BUCKET, DENSE, WIDE = 8, 20_000, 32


def _mean(xs: Column) -> Column:
    """The mean of an array of doubles; null for none."""
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))


def _centred(xs: Column) -> Column:
    """Deviations from the mean. Values are taken from the first of them, so that equal ones deviate by nothing at all."""
    shifted = F.transform(xs, lambda x: x - F.get(xs, F.lit(0)))
    return let(shifted, lambda ys: let(_mean(ys), lambda m: F.transform(ys, lambda y: y - m)))


def _product(xs: Column, ys: Column) -> Column:
    """The mean product of two arrays of doubles."""
    return _mean(F.zip_with(xs, ys, lambda x, y: x * y))


def _features_by_points(deliveries: DataFrame, positions: DataFrame, port_lat: float, port_lon: float, p: Params, clip: bool, fetch_barge: bool) -> DataFrame:
    """Statistics from a row for each point of each delivery: for tracks of any length."""
    track = window_positions(deliveries, positions, clip)
    if not fetch_barge:
        track = track.where("role = 'vessel'")
    return deliveries.join(vessel_statistics(track, port_lat, port_lon, p), "id", "left").join(pair_statistics(track, p), "id", "left")


def _features_by_arrays(deliveries: DataFrame, positions: DataFrame, port_lat: float, port_lon: float, p: Params, clip: bool, fetch_barge: bool) -> DataFrame:
    """The same from arrays: points are shuffled once for each pair of ships and bucket of days, whatever the number of its deliveries."""
    bucket = lambda day: F.floor(day / BUCKET).cast("long")
    first, last = day_of(F.col("start_s")), day_of(F.greatest("start_s", "end_s"))
    barge = F.col("barge_mmsi") if fetch_barge else F.lit(None).cast("string")
    # Deliveries without a vessel or a time find no track: their keys are spread.
    key = F.when(F.col("vessel_mmsi").isNotNull() & first.isNotNull(), bucket(first)).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(4096)))
    asked = deliveries.select("id", "start_s", "end_s", "quantity_mt", first.alias("first"), last.alias("last"), F.col("vessel_mmsi").alias("vessel"), F.coalesce(barge, F.lit("")).alias("barge"), barge.isNotNull().alias("with_barge"), key.alias("bucket"))
    pair = ["vessel", "barge", "with_barge", "bucket"]
    ships = F.array(F.struct(F.lit(True).alias("own"), F.col("vessel").alias("mmsi")), F.struct(F.lit(False).alias("own"), F.when(F.col("with_barge"), F.col("barge")).alias("mmsi")))
    pairs = asked.where("vessel is not null and first is not null").groupBy(*pair).agg(F.min("first").alias("low"), F.max("last").alias("high"))
    needed = pairs.select(*pair, "low", "high", F.explode(ships).alias("s")).select(*pair, "low", "high", "s.*", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("part")).where("mmsi is not null")
    points = F.array_sort(F.collect_list(F.struct("ts", "seq", "lat", "lon", "speed", "heading")))
    tracks = positions.where("ts is not null").groupBy("mmsi", bucket(day_of(F.col("ts"))).alias("part")).agg(points.alias("points")).select("mmsi", "part", F.transform("points", lambda x: F.struct(x["ts"].alias("ts"), x["lat"].alias("lat"), x["lon"].alias("lon"), x["speed"].alias("speed"), x["heading"].alias("heading"))).alias("points"))
    within = lambda x, a, z: (x["ts"] >= F.col(a) * DAY) & (x["ts"] < (F.col(z) + 1) * DAY)
    held = needed.join(tracks, ["mmsi", "part"]).select(*pair, F.struct("own", "part", F.filter("points", lambda x: within(x, "low", "high")).alias("points")).alias("t"))
    track = lambda own: F.flatten(F.transform(F.array_sort(F.filter("ts", lambda t: t["own"] == own)), lambda t: t["points"]))
    arrays = held.groupBy(*pair).agg(F.collect_list("t").alias("ts")).select(*pair, track(True).alias("v"), track(False).alias("b"))
    timed = lambda x: (x["ts"] >= F.col("start_s")) & (x["ts"] <= F.col("end_s")) if clip else F.lit(True)
    own = lambda c: F.coalesce(F.filter(c, lambda x: within(x, "first", "last") & timed(x)), F.array().cast(arrays.schema["v"].dataType))
    x = spread(asked, *pair).join(arrays, pair, "left").select("id", "start_s", "end_s", "quantity_mt", own("v").alias("v"), own("b").alias("b"))
    both = F.least(F.size("v"), F.size("b"))
    distance = lambda a, z: haversine_m(a["lat"], a["lon"], z["lat"], z["lon"], p)
    some = lambda xs: F.filter(xs, lambda v: v.isNotNull())
    heading = lambda c: _centred(F.transform(F.slice(c, F.lit(1), both), lambda v: F.coalesce(v["heading"], F.lit(0.0))))
    x = x.select(
        *["id", "start_s", "end_s", "quantity_mt"],
        F.size("v").cast("long").alias("n_vessel"),
        both.cast("long").alias("pairs"),
        F.transform("v", lambda v: F.coalesce(v["speed"], F.lit(0.0))).alias("speeds"),
        _mean(some(F.transform("v", lambda v: v["lat"]))).alias("lat"),
        _mean(some(F.transform("v", lambda v: v["lon"]))).alias("lon"),
        F.get("v", F.lit(0)).alias("a"),
        F.get("v", F.size("v") - 1).alias("z"),
        F.zip_with(F.slice("v", F.lit(1), both), F.slice("b", F.lit(1), both), distance).alias("apart"),
        heading("v").alias("hv"),
        heading("b").alias("hb"),
    )
    hours = F.greatest((F.col("z.ts") - F.col("a.ts")) / 3600.0, F.lit(1e-6))
    correlation = F.try_divide(_product(F.col("hv"), F.col("hb")), F.sqrt(_product(F.col("hv"), F.col("hv"))) * F.sqrt(_product(F.col("hb"), F.col("hb"))))
    return x.select(
        *["id", "start_s", "end_s", "quantity_mt", "n_vessel", "pairs"],
        _mean(F.col("speeds")).alias("vessel_speed_mean"),
        let(_centred(F.col("speeds")), lambda s: _product(s, s)).alias("vessel_speed_var"),
        F.when(F.col("n_vessel") >= 2, haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon"), p) / hours).alias("position_drift_rate"),
        haversine_km(F.col("lat"), F.col("lon"), F.lit(port_lat), F.lit(port_lon), p).alias("port_distance_km"),
        let(some(F.col("apart")), _mean).alias("mean_vessel_barge_distance_m"),
        let(_centred(some(F.col("apart"))), lambda s: _product(s, s)).alias("var_vessel_barge_distance_m"),
        F.try_divide(F.size(F.filter("apart", lambda d: d <= p.max_distance_m)).cast("double"), F.col("pairs")).alias("colocation_ratio"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(correlation, F.lit(0.0)))).alias("heading_correlation"),
    )


def build_features(deliveries: DataFrame, positions: DataFrame, port_lat: float = 1.264, port_lon: float = 103.84, p: Params = DEFAULT, clip: bool = False, fetch_barge: bool = True, dense: int = DENSE, wide: int = WIDE) -> DataFrame:
    """Per delivery the nine features and their summary; deliveries without positions keep zeros.

    Deliveries that ask for a ship with more than `dense` points in a bucket of days, or for more than `wide` days, are worked out point by
    point; all others from arrays of that size at most.
    """
    d = staged(deliveries.select("id", "vessel_mmsi", "barge_mmsi", "start_s", "end_s", "quantity_mt"), "deliveries")
    day = F.floor(day_of(F.col("ts")) / BUCKET).cast("long").alias("part")
    crowded = staged(positions.where("ts is not null").groupBy("mmsi", day).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("mmsi", "part"), "dense-tracks")
    first, last = day_of(F.col("start_s")), day_of(F.greatest("start_s", "end_s"))
    args = (positions, port_lat, port_lon, p, clip, fetch_barge)
    long_ = F.coalesce(last - first > wide, F.lit(False))
    heavy = d.where(long_).select("id")
    if not crowded.isEmpty():
        parts = F.sequence(F.floor(first / BUCKET).cast("long"), F.floor(last / BUCKET).cast("long"))
        asked = d.where(~long_).select("id", F.explode(F.array("vessel_mmsi", "barge_mmsi")).alias("mmsi"), parts.alias("parts")).select("id", "mmsi", F.explode("parts").alias("part"))
        heavy = heavy.unionByName(asked.join(crowded, ["mmsi", "part"]).select("id"))
    heavy = staged(heavy.distinct(), "heavy-deliveries")
    if heavy.isEmpty():
        every = _features_by_arrays(d, *args)
    else:
        light, rest = (d.join(heavy, "id", how) for how in ("left_anti", "left_semi"))
        columns = ["id", "start_s", "end_s", "quantity_mt", "n_vessel", "pairs", *[c for c in FEATURES if c != "quantity_feasibility"]]
        every = _features_by_arrays(light, *args).select(columns).unionByName(_features_by_points(rest, *args).select(columns))
    hours = F.greatest((F.col("end_s") - F.col("start_s")) / 3600.0, F.lit(0.0))
    zero = [c for c in FEATURES if c != "quantity_feasibility"]
    f = every.select("id", "start_s", "end_s", F.coalesce("n_vessel", F.lit(0)).alias("n_vessel"), F.coalesce("pairs", F.lit(0)).alias("pairs"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zero], quantity_feasibility(F.col("quantity_mt"), hours, p).alias("quantity_feasibility"), hours.alias("hours"))
    return f.select(
        "*",
        rounded(F.col("colocation_ratio") * 100, 1).alias("overlap_percent"),
        rounded(F.col("mean_vessel_barge_distance_m"), 1).alias("avg_distance_m"),
        rounded(F.col("colocation_ratio") * F.col("hours"), 2).alias("co_location_duration_h"),
        (F.col("port_distance_km") <= p.port_tolerance_km).alias("port_coordinate_match"),
        (F.col("quantity_feasibility") >= 0.99).alias("quantity_feasible"),
    )


def descriptive_flags(p: Params = DEFAULT) -> Column:
    """Flags from feature columns and `pairs`."""
    f = [
        F.when(F.col("pairs") == 0, "barge_ais_missing"),
        F.when(F.col("vessel_speed_mean") > p.max_speed_knots, "vessel_speed_anomaly"),
        F.when(F.col("colocation_ratio") * 100 < p.min_overlap_percent, "co_location_duration_mismatch"),
        F.when(~F.col("port_coordinate_match"), "port_coordinate_mismatch"),
        F.when(F.col("quantity_feasibility") < 0.5, "quantity_infeasible"),
    ]
    return F.filter(F.array(*f), lambda x: x.isNotNull())


def ais_outcome(features: DataFrame, identity: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per delivery: ais_unavailable and flags. identity: id, vessel_identity_unresolved."""
    unresolved, empty = F.coalesce("vessel_identity_unresolved", F.lit(True)), F.col("n_vessel") == 0
    flags = F.when(unresolved, F.array(F.lit("vessel_identity_unresolved"))).when(empty, F.array(F.lit("ais_unavailable"))).otherwise(descriptive_flags(p))
    return features.join(identity, "id", "left").select("id", (unresolved | empty).alias("ais_unavailable"), flags.alias("anomaly_flags"))


def gaps(positions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per ship the number of gaps longer than the limit, and the longest in minutes."""
    gap = (F.col("ts") - F.lag("ts").over(W.partitionBy("mmsi").orderBy("ts", "seq"))) / 60.0
    return positions.withColumn("gap", gap).groupBy("mmsi").agg(F.count_if(F.col("gap") > p.max_gap_minutes).alias("gap_count"), rounded(F.coalesce(F.max("gap"), F.lit(0.0)), 2).alias("longest_gap_min"))
