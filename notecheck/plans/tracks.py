"""Queries over tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import haversine_km, haversine_m, quantity_feasibility, rounded
from ..operators import tracks as T
from ..sources.adapters import frame
from .base import query, sql_km, sql_round

TRACK = """days as (select id, role, mmsi, unnest(range(cast(floor(start_s / 86400) as bigint), cast(floor(end_s / 86400) as bigint) + 1)) as day from
    (select id, 'vessel' as role, vessel_mmsi as mmsi, start_s, end_s from deliveries union all select id, 'barge', barge_mmsi, start_s, end_s from deliveries) x),
  track as (select d.id, d.role, p.* from days d join positions p on p.mmsi = d.mmsi and cast(floor(p.ts / 86400) as bigint) = d.day),
  placed as (select *, row_number() over (partition by id, role order by ts, seq) as rn from track),
  pairs as (select id, rn, max(lat) filter (role = 'vessel') as vlat, max(lon) filter (role = 'vessel') as vlon, max(heading) filter (role = 'vessel') as vh, max(lat) filter (role = 'barge') as blat, max(lon) filter (role = 'barge') as blon, max(heading) filter (role = 'barge') as bh from placed group by id, rn having count(*) = 2)"""
DIST = f"(1000 * {sql_km('vlat', 'vlon', 'blat', 'blon')})"
PAIRSTAT = f"""pairstat as (select id, count(*) as pairs, avg(d) as mean_d, case when count(*) >= 2 then var_pop(d) else 0 end as var_d, avg(case when d <= 200 then 1e0 else 0e0 end) as ratio,
    case when stddev_pop(vh) * stddev_pop(bh) > 0 then greatest(-1e0, least(1e0, covar_pop(vh, bh) / (stddev_pop(vh) * stddev_pop(bh)))) else 0e0 end as corr from (select *, {DIST} as d from pairs) q group by id)"""
VESSELSTAT = f"""vesselstat as (select id, count(*) as n_vessel, avg(speed) as sp_mean, case when count(*) >= 2 then var_pop(speed) else 0 end as sp_var, avg(lat) as lat, avg(lon) as lon,
    min(ts) as t0, max(ts) as t1, arg_min(lat, ts * 10000000 + seq) as lat0, arg_min(lon, ts * 10000000 + seq) as lon0, arg_max(lat, ts * 10000000 + seq) as lat1, arg_max(lon, ts * 10000000 + seq) as lon1 from track where role = 'vessel' group by id)"""
FEAS = "case when h <= 0 then 0.5e0 when quantity_mt / h < 80 then quantity_mt / h / 80 when quantity_mt / h > 250 then 250e0 / (quantity_mt / h) else 1e0 end"
FEATS = f"""feats as (select d.id, coalesce(n_vessel, 0) as n_vessel, coalesce(pairs, 0) as pairs, coalesce(mean_d, 0) as mean_d, coalesce(var_d, 0) as var_d, coalesce(sp_mean, 0) as sp_mean, coalesce(sp_var, 0) as sp_var,
    coalesce(corr, 0) as corr, coalesce(ratio, 0) as ratio, case when n_vessel >= 2 then {sql_km('lat0', 'lon0', 'lat1', 'lon1')} / greatest((t1 - t0) / 3600e0, 1e-6) else 0e0 end as drift,
    coalesce({sql_km('lat', 'lon', '1.264e0', '103.84e0')}, 0) as port_km, {FEAS} as feas, h from (select *, (end_s - start_s) / 3600e0 as h from deliveries) d left join vesselstat using (id) left join pairstat using (id))"""
ALL = f"with {TRACK}, {PAIRSTAT}, {VESSELSTAT}, {FEATS}"
FLAGS = "list_filter([case when pairs = 0 then 'barge_ais_missing' end, case when sp_mean > 3 then 'vessel_speed_anomaly' end, case when ratio * 100 < 70 then 'co_location_duration_mismatch' end, case when port_km > 50 then 'port_coordinate_mismatch' end, case when feas < 0.5 then 'quantity_infeasible' end], lambda x: x is not null)"


def _track(spark: SparkSession, d: str, clip: bool = False) -> DataFrame:
    return T.window_positions(frame(spark, d, "deliveries"), frame(spark, d, "positions"), clip)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return T.build_features(frame(spark, d, "deliveries"), frame(spark, d, "positions"))


@query(f"with {TRACK} select id, role, ts, seq from track")
def jn_12_window_positions(spark: SparkSession, d: str) -> DataFrame:
    return _track(spark, d).select("id", "role", "ts", "seq")


@query(f"with {TRACK} select t.id, t.role, count(*) as n from track t join deliveries d on d.id = t.id and ts >= start_s and ts <= end_s group by t.id, t.role")
def jn_12_clipped(spark: SparkSession, d: str) -> DataFrame:
    return _track(spark, d, clip=True).groupBy("id", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TRACK} select id, role, seq, rn from placed")
def wn_01_track_index(spark: SparkSession, d: str) -> DataFrame:
    return T.indexed(_track(spark, d)).select("id", "role", "seq", "rn")


@query(f"with {TRACK} select id, role, min(ts) as first_ts, max(ts) as last_ts from track group by id, role")
def wn_02_track_ends(spark: SparkSession, d: str) -> DataFrame:
    at = T.indexed(_track(spark, d))
    return at.groupBy("id", "role").agg(F.min_by("ts", "rn").alias("first_ts"), F.max_by("ts", "rn").alias("last_ts"))


@query(f"with {TRACK} select id, rn, {sql_round(DIST, 3)} as distance_m from pairs")
def jn_13_pairs_by_place(spark: SparkSession, d: str) -> DataFrame:
    return T.paired(_track(spark, d)).select("id", "rn", rounded(T.pair_distance(), 3).alias("distance_m"))


@query(f"""with {TRACK}, v as (select * from track where role = 'vessel'), b as (select id as bid, ts as bts, max(seq) as bseq from track where role = 'barge' group by id, ts)
  select v.id, v.seq, b.bts as barge_ts from v asof join b on v.id = b.bid and v.ts >= b.bts""")
def jn_14_pairs_asof(spark: SparkSession, d: str) -> DataFrame:
    return T.paired_asof(_track(spark, d)).select("id", "seq", F.col("b.ts").alias("barge_ts"))


@query(f"select seq, {sql_round(sql_km('lat', 'lon', '1.264e0', '103.84e0'), 5)} as km from positions")
def mth_01_haversine(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "positions").select("seq", rounded(haversine_km(F.col("lat"), F.col("lon"), F.lit(1.264), F.lit(103.84)), 5).alias("km"))


@query(f"select id, {sql_round(FEAS, 6)} as feasibility from (select *, (end_s - start_s) / 3600e0 as h from deliveries) x")
def mth_02_feasibility(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "deliveries").select("id", rounded(quantity_feasibility(F.col("quantity_mt"), (F.col("end_s") - F.col("start_s")) / 3600.0), 6).alias("feasibility"))


@query(f"with {TRACK}, {PAIRSTAT} select d.id, {sql_round('coalesce(mean_d, 0)', 3)} as mean_m from deliveries d left join pairstat using (id)")
def ag_01_mean_distance(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", rounded(F.col("mean_vessel_barge_distance_m"), 3).alias("mean_m"))


@query(f"{ALL} select id, {sql_round('var_d', 0)} as var_m, {sql_round('sp_var', 4)} as var_speed from feats")
def ag_02_variance(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", rounded(F.col("var_vessel_barge_distance_m"), 0).alias("var_m"), rounded(F.col("vessel_speed_var"), 4).alias("var_speed"))


@query(f"{ALL} select id, {sql_round('sp_mean', 5)} as mean_speed from feats")
def ag_03_mean_speed(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", rounded(F.col("vessel_speed_mean"), 5).alias("mean_speed"))


@query(f"{ALL} select id, {sql_round('ratio', 6)} as ratio from feats")
def ag_04_colocation(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", rounded(F.col("colocation_ratio"), 6).alias("ratio"))


@query(f"with {TRACK}, {VESSELSTAT} select id, {sql_round('lat', 6)} as lat, {sql_round('lon', 6)} as lon from vesselstat")
def ag_05_centroid(spark: SparkSession, d: str) -> DataFrame:
    return T.vessel_statistics(_track(spark, d), 1.264, 103.84).select("id", rounded(F.col("lat"), 6).alias("lat"), rounded(F.col("lon"), 6).alias("lon"))


@query(f"{ALL} select id, {sql_round('corr', 5)} as correlation from feats")
def ag_06_heading_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", rounded(F.col("heading_correlation"), 5).alias("correlation"))


@query(f"{ALL} select id, {sql_round('drift', 4)} as drift from feats")
def ag_07_drift(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", rounded(F.col("position_drift_rate"), 4).alias("drift"))


@query(f"{ALL} select id, {sql_round('port_km', 4)} as km from feats")
def ag_08_port_distance(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", rounded(F.col("port_distance_km"), 4).alias("km"))


@query(f"""{ALL} select id, pairs, {sql_round('ratio * 100', 1)} as overlap_percent, {sql_round('mean_d', 1)} as avg_distance_m, {sql_round('ratio * h', 2)} as co_location_duration_h,
  port_km <= 50 as port_coordinate_match, feas >= 0.99 as quantity_feasible, {sql_round('sp_mean', 4)} as speed, {sql_round('corr', 4)} as correlation from feats""")
def ag_09_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", "pairs", "overlap_percent", "avg_distance_m", "co_location_duration_h", "port_coordinate_match", "quantity_feasible", rounded(F.col("vessel_speed_mean"), 4).alias("speed"), rounded(F.col("heading_correlation"), 4).alias("correlation"))


@query(f"{ALL} select id, array_to_string({FLAGS}, ',') as flags from feats")
def rl_07_descriptive_flags(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("id", F.array_join(T.descriptive_flags(), ",").alias("flags"))


@query(f"""{ALL} select id, id % 19 = 0 or n_vessel = 0 as ais_unavailable, case when id % 19 = 0 then 'vessel_identity_unresolved' when n_vessel = 0 then 'ais_unavailable' else array_to_string({FLAGS}, ',') end as flags from feats""")
def rl_08_ais_outcome(spark: SparkSession, d: str) -> DataFrame:
    identity = frame(spark, d, "deliveries").select("id", (F.col("id") % 19 == 0).alias("vessel_identity_unresolved"))
    return T.ais_outcome(_features(spark, d), identity).select("id", "ais_unavailable", F.array_join("anomaly_flags", ",").alias("flags"))


@query(f"""select mmsi, count(*) filter (gap > 60) as gap_count, {sql_round('coalesce(max(gap), 0)', 2)} as longest_gap_min from
  (select mmsi, (ts - lag(ts) over (partition by mmsi order by ts, seq)) / 60e0 as gap from positions) x group by mmsi""")
def wn_09_gaps(spark: SparkSession, d: str) -> DataFrame:
    return T.gaps(frame(spark, d, "positions"))


@query(f"""{ALL} select {', '.join(sql_round(x, 3) + ' as f' + str(i) for i, x in enumerate(('mean_d', 'var_d / 1000', 'sp_mean', 'sp_var', 'corr', 'ratio', 'drift', 'port_km', 'feas')))}, id from feats""")
def ml_04_feature_vector(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).withColumn("vector", F.array(*T.FEATURES))
    return f.select("id", *[rounded(F.get("vector", F.lit(i)) / (1000 if i == 1 else 1), 3).alias(f"f{i}") for i in range(9)])
