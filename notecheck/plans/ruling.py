"""Queries of rules, and the whole pipeline from note to verdict."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import rounded
from ..operators import anomaly as A
from ..operators import extract as E
from ..operators import history as H
from ..operators import resolve as R
from ..operators import rules as U
from ..operators import tracks as T
from ..sources.adapters import frame
from ..sources.store import shared_folder, staged
from .base import query, sql_round


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Extracted fields of notes with the extraction's confidence."""
    return E.extract(frame(spark, d, "notes")).withColumn("extraction_confidence", E.extraction_confidence())


# The fields as the notes were rendered; the clock format decides whether times compare as text.
_F = """f as (select id as note_id, vessel_name, imo, barge_name, doc_type, ocr_confidence, font_variance, id % 17 = 0 as corrected, 300 + id % 500 + 0.5e0 as viscosity, (id % 9) / 10e0 as water, id % 3 <> 0 as sealed,
    regexp_extract(raw_text, 'Commenced Pumping: ([^\\n]*)', 1) as start_time, regexp_extract(raw_text, 'Completed Pumping: ([^\\n]*)', 1) as end_time, 0.7e0 * (7 + case when barge_name is null then 0 else 1 end) / 9 + 0.3e0 * ocr_confidence as ext
    from note_fields join (select note_id, raw_text from notes) n on n.note_id = id)"""
_CRED = f"""{_F}, s as (select *, {sql_round('least(ocr_confidence / 0.85e0, 1e0) * 100', 1)} as s1, {sql_round('(5 + case when barge_name is null then 0 else 1 end) / 6e0 * 100', 1)} as s2,
    greatest(0e0, greatest(0e0, greatest(0e0, 100 - case when corrected then 20e0 else 0 end) - case when viscosity > 700 and viscosity <= 800 then 40e0 else 0 end) - case when water > 0.5 then 40e0 else 0 end) as s3, 100 - case when start_time >= end_time then 25e0 else 0 end as s4,
    100 - case when font_variance >= 350 then 20e0 else 0 end - case when doc_type = 'HANDWRITTEN' then 25e0 else 0 end as s5 from f),
  cred as (select *, {sql_round('s1 * 0.3e0 + s2 * 0.25e0 + s3 * 0.2e0 + s4 * 0.15e0 + s5 * 0.1e0', 1)} as score, array_to_string(list_filter([case when ocr_confidence < 0.85e0 then 'low_ocr_confidence' end, case when {sql_round('ext', 3)} < 0.5 then 'low_extraction_confidence' end, case when barge_name is null then 'missing_required_fields' end,
    case when corrected then 'contains_correction_keywords' end, case when viscosity > 700 and viscosity <= 800 then 'marpol_viscosity_violation' end, case when water > 0.5 then 'marpol_water_content_violation' end, case when start_time >= end_time then 'reversed_timestamps' end,
    case when font_variance >= 350 then 'font_inconsistency' end, case when doc_type = 'HANDWRITTEN' then 'handwritten_document' end, case when not sealed then 'missing_seal_numbers' end], lambda x: x is not null), ',') as flags from s)"""


@query(f"with {_CRED} select note_id, score, flags from cred")
def rl_01_credibility(spark: SparkSession, d: str) -> DataFrame:
    return U.credibility(_fields(spark, d)).select("note_id", F.col("credibility_score").alias("score"), F.array_join("credibility_flags", ",").alias("flags"))


@query(f"with {_F} select note_id, least(6, 5 + case when barge_name is null then 0 else 1 end) as required, 7 + case when barge_name is null then 0 else 1 end as expected from f")
def ag_10_completeness(spark: SparkSession, d: str) -> DataFrame:
    x, count = _fields(spark, d), lambda fs: sum((F.col(c).isNotNull().cast("int") for c in fs), F.lit(0))
    return x.select("note_id", count(("vessel_name", "barge_name", "delivery_date", "start_time", "end_time", "port")).alias("required"), count(E.EXPECTED).alias("expected"))


@query("select id as note_id, case when barge_name is null then 6 else 7 end as present, id % 3 <> 0 as any_seal from note_fields")
def arr_01_present(spark: SparkSession, d: str) -> DataFrame:
    x = _fields(spark, d)
    seven = F.array("vessel_name", "barge_name", "delivery_date", "start_time", "end_time", "port", "imo")
    return x.select("note_id", F.size(F.filter(seven, lambda v: v.isNotNull())).alias("present"), F.coalesce("seal_number_vessel", "seal_number_marpol", "seal_number_barge").isNotNull().alias("any_seal"))


@query(f"""select id as note_id, greatest(0e0, {sql_round('100e0 * (6 + case when barge_name is null then 0 else 1 end) / 7', 1)} - case when id % 7 > 5 then 10 else 0 end - case when 50 + id % 40 < 60 then 10 else 0 end) as score,
  array_to_string(list_filter([case when id % 7 > 5 then 'sulphur_exceeds_limit' end, case when 50 + id % 40 < 60 then 'flashpoint_below_minimum' end], lambda x: x is not null), ',') as flags from note_fields""")
def rl_02_legacy_credibility(spark: SparkSession, d: str) -> DataFrame:
    x = E.normalized(_fields(spark, d))
    return U.legacy_credibility(x).select("note_id", "score", F.array_join("flags", ",").alias("flags"))


@query(f"""with {_CRED}, dup as (select upper(vessel_name) as v, upper(port) as w, floor(from_s / 86400) as d from note_fields group by all having count(*) > 1)
  select note_id, contains(flags, 'zzz') or dup.v is not null as flagged from cred join note_fields nf on nf.id = note_id left join dup on v = upper(nf.vessel_name) and w = upper(nf.port) and d = floor(nf.from_s / 86400)""")
def rl_03_duplicate_flag(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.history import duplicates

    n = frame(spark, d, "note_fields").select(F.col("id").alias("note_id"), "vessel_name", "port", F.floor(F.col("from_s") / 86400).alias("delivery_date"))
    x = _fields(spark, d).join(duplicates(n).select("note_id", F.lit(True).alias("again")), "note_id", "left")
    return U.credibility(x, duplicate=F.col("again")).select("note_id", F.array_contains("credibility_flags", "duplicate_bdn_detected").alias("flagged"))


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """Rows with every stage's outcome, made from plain arithmetic, for the rules alone."""
    o = frame(spark, d, "orders")
    pick = lambda n, *xs: F.array(F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.col("o_orderkey"), F.lit(n)) + 1).cast("int")))
    some = lambda a: F.filter(a, lambda x: x != "")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.lit("A").alias("vessel_name"),
        F.lit("B").alias("barge_name"),
        some(pick(5, "", "vessel_name_mismatch", "vessel_name_fuzzy_match", "vessel_not_in_registry", "missing_vessel_identity")).alias("identity_flags"),
        (F.col("o_orderkey") % 11 == 0).alias("identity_unresolved"),
        some(pick(6, "", "barge_name_missing", "barge_not_found", "barge_name_mismatch", "barge_low_confidence", "")).alias("barge_flags"),
        (F.col("o_orderkey") % 4 == 0).alias("barge_ais_missing"),
        (F.col("o_orderkey") % 13 == 0).alias("is_anomaly"),
        (F.col("o_orderkey") % 3 == 0).alias("ais_unavailable"),
        some(pick(4, "", "ais_unavailable", "barge_ais_missing", "port_coordinate_mismatch")).alias("anomaly_flags"),
        some(pick(7, "", "reversed_timestamps", "quantity_physically_impossible", "contains_correction_keywords", "duplicate_bdn_detected", "missing_seal_numbers", "handwritten_document")).alias("credibility_flags"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("ocr_confidence"),
        ((F.col("o_orderkey") % 90) / 90.0).alias("extraction_confidence"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("identity_confidence"),
        ((F.col("o_orderkey") % 8) / 8.0).alias("barge_confidence"),
        ((F.col("o_orderkey") % 20) / 20.0).alias("anomaly_score"),
    )


_K = "k as (select o_orderkey as id, o_orderkey % 5 as i5, o_orderkey % 6 as i6, o_orderkey % 7 as i7, o_orderkey % 11 = 0 as unres, o_orderkey % 13 = 0 as anom, o_orderkey % 3 = 0 as noais, o_orderkey % 4 as i4 from orders)"
_A = f"""{_K}, a as (select *, list_filter([case when i5 = 4 then 'VESSEL_NOT_FOUND' when unres then 'VESSEL_IDENTITY_UNRESOLVED' when i5 = 1 then 'IMO_MISMATCH' when i5 = 2 then 'NAME_FUZZY_MATCH' when i5 = 3 then 'VESSEL_NOT_FOUND' end,
    case when i6 in (1, 2) then 'BARGE_MISSING' when i6 = 3 then 'BARGE_NAME_MISMATCH' when i6 = 4 then 'BARGE_UNVERIFIED' when i4 = 0 then 'BARGE_AIS_MISSING' end, case when anom then 'EXCESSIVE_DISTANCE' when noais then 'AIS_UNAVAILABLE' end,
    case i7 when 1 then 'INVALID_TIMESTAMPS' when 2 then 'QUANTITY_INFEASIBLE' when 3 then 'SUSPICIOUS_CORRECTIONS' when 4 then 'DUPLICATE_BDN' when 5 then 'MISSING_SEAL_NUMBERS' end], lambda x: x is not null) as al from k),
  b as (select *, case when list_has_any(al, ['VESSEL_NOT_FOUND', 'VESSEL_IDENTITY_UNRESOLVED', 'IMO_MISMATCH', 'EXCESSIVE_DISTANCE', 'DUPLICATE_BDN']) then 'HIGH' when list_has_any(al, ['BARGE_MISSING', 'BARGE_NAME_MISMATCH', 'BARGE_UNVERIFIED', 'INVALID_TIMESTAMPS', 'QUANTITY_INFEASIBLE', 'SUSPICIOUS_CORRECTIONS']) then 'MEDIUM'
    when list_contains(al, 'MISSING_SEAL_NUMBERS') then 'LOW' else 'NONE' end as risk from a)"""
_V = f"""{_A}, c as (select *, {sql_round('(id % 100) / 100e0 * 0.2e0 + (id % 90) / 90e0 * 0.2e0 + (id % 10) / 10e0 * 0.2e0 + case when id % 8 = 0 then 0.5e0 else (id % 8) / 8e0 end * 0.15e0 + case when noais then 0.9e0 else greatest(0e0, 1 - case when id % 20 = 0 then 0.5e0 else (id % 20) / 20e0 end) end * 0.25e0', 3)} as confidence from b),
  v as (select *, case when unres or risk = 'HIGH' or anom then 'HIGH_RISK' when i6 in (1, 2) then 'SUSPICIOUS' when noais and not anom and i4 <> 3 and risk <> 'MEDIUM' then 'REVIEW_REQUIRED' when confidence >= 0.75 then 'VALID' when confidence >= 0.5 then 'SUSPICIOUS' else 'HIGH_RISK' end as label from c)"""


@query(f"with {_A} select id, array_to_string(al, ',') as alert_types, risk from b")
def rl_04_alerts(spark: SparkSession, d: str) -> DataFrame:
    x = U.with_alerts(_staged(spark, d))
    return x.select("id", F.array_join(F.transform("alerts", lambda a: a["alert_type"]), ",").alias("alert_types"), F.col("overall_fraud_risk").alias("risk"))


@query(f"with {_V} select id, confidence, label as classification, risk = 'HIGH' or unres or label in ('HIGH_RISK', 'REVIEW_REQUIRED') as review from v")
def rl_05_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return U.verdicts(U.with_alerts(_staged(spark, d))).select("id", "confidence", "classification", F.col("human_review_required").alias("review"))


@query("select id, case when (select count(*) from orders) > 0 then 5 end as steps, (id % 100) / 100e0 >= 0.85e0 as ocr_passed, not (id % 11 = 0) as vessel_passed from (select o_orderkey as id from orders) x")
def prj_05_report(spark: SparkSession, d: str) -> DataFrame:
    x = U.verdicts(U.with_alerts(_staged(spark, d)))
    report = x.select("id", F.struct("classification", "confidence", "verdict_reason", "fraud_alerts", "info_alerts", "audit_trail").alias("report"))
    step = lambda i: F.get("report.audit_trail", F.lit(i))["passed"]
    return report.select("id", F.size("report.audit_trail").alias("steps"), step(0).alias("ocr_passed"), step(2).alias("vessel_passed"))


@query(f"""with {_V} select id, array_to_string(list_filter([case when label = 'VALID' then 'All checks passed.' end, case when label = 'VALID' and not noais then 'The tracks confirm the delivery.' end, case when label = 'REVIEW_REQUIRED' then 'No positions in the delivery window.' end,
  case when label = 'SUSPICIOUS' and i6 in (1, 2) then 'The barge could not be identified.' end, case when label = 'SUSPICIOUS' and i6 not in (1, 2) then 'Overall confidence is below the threshold.' end, case when label = 'HIGH_RISK' and unres then 'IMO and name conflict.' end,
  case when label = 'HIGH_RISK' and anom then 'The tracks are anomalous.' end, case when label = 'HIGH_RISK' and risk = 'HIGH' then 'High-severity alerts.' end,
  case i7 when 1 then 'Document flags: reversed_timestamps.' when 2 then 'Document flags: quantity_physically_impossible.' when 3 then 'Document flags: contains_correction_keywords.' when 4 then 'Document flags: duplicate_bdn_detected.' when 5 then 'Document flags: missing_seal_numbers.' end], lambda x: x is not null), ' ') as reason from v""")
def str_18_reasons(spark: SparkSession, d: str) -> DataFrame:
    return U.verdicts(U.with_alerts(_staged(spark, d))).select("id", F.col("verdict_reason").alias("reason"))


@query("select severity, count(*) as n from (select case alert_type when 'VESSEL_NOT_FOUND' then 'HIGH' when 'DUPLICATE_BDN' then 'HIGH' when 'MISSING_SEAL_NUMBERS' then 'LOW' when 'AIS_UNAVAILABLE' then 'INFO' else 'MEDIUM' end as severity from alerts) x group by severity")
def map_01_severity(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "alerts").groupBy(U.severity(F.col("alert_type")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select id, case alert_type when 'VESSEL_NOT_FOUND' then 3 when 'DUPLICATE_BDN' then 3 when 'MISSING_SEAL_NUMBERS' then 1 when 'AIS_UNAVAILABLE' then 0 else 2 end as v from alerts)
  select id, count(*) filter (v = 3) as high, count(*) filter (v = 2) as medium, case max(v) when 3 then 'HIGH' when 2 then 'MEDIUM' when 1 then 'LOW' else 'NONE' end as risk from s group by id""")
def ag_11_alert_counts(spark: SparkSession, d: str) -> DataFrame:
    s = frame(spark, d, "alerts").withColumn("s", U.severity(F.col("alert_type")))
    high, medium, low = (F.count_if(F.col("s") == x) for x in ("HIGH", "MEDIUM", "LOW"))
    return s.groupBy("id").agg(high.alias("high"), medium.alias("medium"), F.when(high > 0, "HIGH").when(medium > 0, "MEDIUM").when(low > 0, "LOW").otherwise("NONE").alias("risk"))


@query("select id, array_to_string(list_transform(list_sort(list_distinct(list(alert_type))), lambda x: x), ',') as types from alerts group by id")
def ag_22_distinct_flags(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "alerts").groupBy("id").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("alert_type"))), ",").alias("types"))


@query("""with k as (select o_orderkey as id, case o_orderkey % 4 when 0 then [] when 1 then ['ais_unavailable'] when 2 then ['barge_ais_missing'] else ['port_coordinate_mismatch'] end as a, case o_orderkey % 3 when 0 then ['x'] when 1 then ['ais_unavailable', 'x'] else [] end as b from orders)
  select id, array_to_string(list_concat(a, list_filter(b, lambda x: not list_contains(a, x))), ',') as joined, list_has_any(a, b) as overlap, len(list_filter(a, lambda x: not list_contains(['ais_unavailable', 'barge_ais_missing'], x))) = 0 as only_missing, array_to_string(list_filter(b, lambda x: x <> 'ais_unavailable'), ',') as rest from k""")
def st_01_flag_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection, subset and difference of flag lists (ST-01 to ST-04)."""
    a = F.expr("case o_orderkey % 4 when 0 then array() when 1 then array('ais_unavailable') when 2 then array('barge_ais_missing') else array('port_coordinate_mismatch') end")
    b = F.expr("case o_orderkey % 3 when 0 then array('x') when 1 then array('ais_unavailable', 'x') else array() end")
    k = frame(spark, d, "orders").select(F.col("o_orderkey").alias("id"), a.alias("a"), b.alias("b"))
    missing = F.array(F.lit("ais_unavailable"), F.lit("barge_ais_missing"))
    return k.select("id", F.array_join(F.array_distinct(F.concat("a", "b")), ",").alias("joined"), F.coalesce(F.arrays_overlap("a", "b"), F.lit(False)).alias("overlap"), (F.size(F.array_except("a", missing)) == 0).alias("only_missing"), F.array_join(F.filter("b", lambda x: x != "ais_unavailable"), ",").alias("rest"))


@query(f"""with k as (select o_orderkey as id, o_orderkey % 101 as cred, (o_orderkey % 10) / 10e0 as ic, (o_orderkey % 20) / 20e0 as an from orders), c as (select *, {sql_round('cred / 100e0 * 0.35e0 + ic * 0.25e0 + (1 - case when an = 0 then 0.5e0 else an end) * 0.4e0', 3)} as comb from k)
  select id, comb as confidence, case when id % 11 = 0 or id % 13 = 0 then 'HIGH_RISK' when id % 3 = 0 then case when cred >= 70 and id % 2 = 0 then 'SUSPICIOUS' else 'HIGH_RISK' end when comb >= 0.75 and cred >= 70 and id % 2 = 0 then 'VALID' when comb >= 0.45 then 'SUSPICIOUS' else 'HIGH_RISK' end as classification from c""")
def rl_06_old_matrix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = U.old_verdict((k % 101).cast("double"), (k % 10) / 10.0, (k % 20) / 20.0, k % 11 == 0, k % 2 == 0, k % 3 == 0, k % 13 == 0)
    return frame(spark, d, "orders").select(k.alias("id"), v.alias("v")).select("id", "v.*")


_BADGES = "case when id % 3 = 0 then 'PASS' else 'PASS' end as density, case when id % 7 <= 5 then 'PASS' else 'FAIL' end as sulphur, case when 50 + id % 40 >= 60 then 'PASS' else 'FAIL' end as flashpoint"


@query(f"select id as note_id, {_BADGES}, {sql_round('0.4e0 + case when id % 7 <= 5 then 0.35e0 else 0 end + case when 50 + id % 40 >= 60 then 0.25e0 else 0 end', 2)} as score from note_fields")
def rl_09_compliance(spark: SparkSession, d: str) -> DataFrame:
    x = E.normalized(_fields(spark, d))
    return x.select("note_id", U.compliance(F.col("density"), F.col("sulphur_content"), F.col("flashpoint")).alias("c")).select("note_id", "c.*")


@query("select badge, count(*) as n from (select case when 50 + id % 40 >= 60 then 'PASS' else 'FAIL' end as badge from note_fields) x group by badge")
def rl_10_badges(spark: SparkSession, d: str) -> DataFrame:
    x = _fields(spark, d).select(U.compliance(F.col("density"), F.col("sulphur_content"), F.col("flashpoint"))["flashpoint"].alias("badge"))
    return x.groupBy("badge").agg(F.count(F.lit(1)).alias("n"))


_RULE_CHECKS = "[" + ", ".join(f"['rules', '{n}', case when list_contains(string_split(flags, ','), '{f}') then '{f}' else '' end]" for n, f in U.FLAG_CHECKS.items()) + "]"


@query(f"""with {_CRED}, c as (select note_id, unnest(list_concat([['document', 'vessel_name present', ''], ['document', 'barge_name present', case when barge_name is null then 'missing' else '' end], ['document', 'delivery_date present', ''], ['document', 'start_time present', ''], ['document', 'end_time present', ''], ['document', 'port present', ''], ['document', 'imo present', ''],
  ['document', 'OCR readable', case when ocr_confidence >= 0.85e0 then '' else 'low_ocr_confidence' end], ['document', 'credible', case when score >= 70 and flags = '' then '' when flags = '' then '-' else flags end], ['document', 'quantity given', '']], {_RULE_CHECKS})) as x from cred)
  select note_id, x[1] as category, x[2] as "check", case when x[3] = '' then 'ok' else 'attention' end as status, case when x[3] = '-' then '' else x[3] end as detail from c""")
def rl_11_check_list(spark: SparkSession, d: str) -> DataFrame:
    return U.check_list(U.credibility(_fields(spark, d)))


@query("select id, o6 in (1, 2) as barge_missing from (select o_orderkey as id, o_orderkey % 6 as o6 from orders) x")
def rl_12_barge_missing(spark: SparkSession, d: str) -> DataFrame:
    return U.verdicts(U.with_alerts(_staged(spark, d))).select("id", "barge_missing")


#: Judged notes from plain arithmetic, for the checks alone; both engines read this text.
_JUDGED = """select o_orderkey as note_id, case when o_orderkey % 9 = 0 then '' else 'SEA ' || cast(o_orderkey as string) end as vessel_name, case when o_orderkey % 5 = 0 then null else 'B' end as barge_name, '01/02/2024' as delivery_date, '10:00' as start_time, case when o_orderkey % 8 = 0 then null else '12:00' end as end_time,
  'Singapore' as port, case when o_orderkey % 7 = 0 then null else '1234567' end as imo, cast(o_orderkey % 100 as double) / 100 as ocr_confidence, case when o_orderkey % 13 = 0 then null else cast(o_orderkey % 201 as double) / 2 end as credibility_score, o_orderkey % 3 = 1 as corrected, o_orderkey % 100 < 85 as blurred,
  case when o_orderkey % 4 = 0 then null else 12.5e0 end as quantity_mt, o_orderkey % 6 as located, case when o_orderkey % 2 = 0 then 5 end as highlighted, o_orderkey % 11 = 0 as identity_unresolved, case when o_orderkey % 12 = 0 then null else cast(o_orderkey % 10 as double) / 10 end as identity_confidence,
  case when o_orderkey % 10 < 8 then 'fuzzy' else 'exact' end as identity_method, o_orderkey % 3 = 0 as ais_unavailable, o_orderkey % 5 as flag, cast(o_orderkey % 200 as double) / 2 as overlap_percent, cast(o_orderkey % 77 as double) + 0.5e0 as avg_distance_m,
  o_orderkey % 2 = 0 as port_coordinate_match, case when o_orderkey % 14 = 1 then null else cast(o_orderkey % 8 as double) / 8 end as anomaly_score, o_orderkey % 8 > 5 as is_anomaly, case when o_orderkey % 15 = 0 then null else o_orderkey end as start_s,
  case when o_orderkey % 17 = 0 then null else cast(700 + o_orderkey % 400 as double) / 1000 end as density, case when o_orderkey % 19 = 0 then null else cast(o_orderkey % 9 as double) / 10 end as sulphur_content, cast(40 + o_orderkey % 50 as double) as flashpoint, o_orderkey % 4 = 1 as barge_ais_missing, o_orderkey % 6 = 5 as barge_missing,
  case o_orderkey % 4 when 0 then 'VALID' when 1 then 'SUSPICIOUS' when 2 then 'HIGH_RISK' else 'REVIEW_REQUIRED' end as classification, 'as before' as verdict_reason from """
_FLAGS = ["ais_unavailable", "barge_ais_missing", "vessel_speed_anomaly", "quantity_infeasible", "port_coordinate_mismatch"]


def _judged(spark: SparkSession, d: str) -> DataFrame:
    x = spark.sql(_JUDGED + "{orders}", orders=frame(spark, d, "orders"))
    some = lambda *fs: F.filter(F.array(*fs), lambda f: f.isNotNull())
    flags = some(F.element_at(F.array(*[F.lit(f) for f in _FLAGS]), (F.col("flag") + 1).cast("int")), F.when(F.col("note_id") % 16 == 0, "quantity_infeasible"))
    return x.withColumns({"credibility_flags": some(F.when(F.col("corrected"), "contains_correction_keywords"), F.when(F.col("blurred"), "low_ocr_confidence")), "anomaly_flags": flags})


_J = f"""j as (select *, list_filter([case when corrected then 'contains_correction_keywords' end, case when blurred then 'low_ocr_confidence' end], lambda x: x is not null) as cf, list_filter([['{"', '".join(_FLAGS)}'][flag + 1], case when note_id % 16 = 0 then 'quantity_infeasible' end], lambda x: x is not null) as af from ({_JUDGED} orders) y)"""
_READ = " union all ".join(f"""select note_id, 'document', '{c} read', coalesce({c}, '') <> '', case when coalesce({c}, '') <> '' then 'read: ' || {c} else 'not read' end from j""" for c in ("vessel_name", "barge_name", "delivery_date", "start_time", "end_time", "port", "imo"))


@query(f"""with {_J}, c(note_id, category, "check", ok, detail) as ({_READ}
  union all select note_id, 'document', 'text readable', ocr_confidence >= 0.85e0 and not blurred, 'confidence in percent: ' || cast(floor(ocr_confidence * 100 + 1e-9) as bigint) from j
  union all select note_id, 'document', 'credible', credibility_score >= 70 and len(cf) = 0, 'score ' || credibility_score || case when len(cf) > 0 then '; ' || array_to_string(list_sort(cf), ', ') else '' end from j where credibility_score is not null
  union all select note_id, 'document', 'quantity possible', not list_contains(af, 'quantity_infeasible'), case when list_contains(af, 'quantity_infeasible') then 'too much or too little for the time' else 'fits the time' end from j where quantity_mt is not null
  union all select note_id, 'document', 'fields located', located >= 3, located || ' of 5 found on the page' from j where highlighted is not null
  union all select note_id, 'identity', 'IMO and name agree', not identity_unresolved, case when identity_unresolved then 'a reviewer must decide' else 'one vessel' end from j
  union all select note_id, 'identity', 'identity sure', identity_confidence >= 0.8e0 and not identity_unresolved, cast(floor(identity_confidence * 100 + 1e-9) as bigint) || ' percent by ' || identity_method from j where identity_confidence is not null
  union all select note_id, 'positions', 'positions there', false, 'none for the delivery' from j where ais_unavailable
  union all select note_id, 'positions', 'vessel at rest', not list_contains(af, 'vessel_speed_anomaly'), case when list_contains(af, 'vessel_speed_anomaly') then 'moved too fast' else 'track as expected' end from j where not ais_unavailable
  union all select note_id, 'positions', 'barge alongside', not list_contains(af, 'barge_ais_missing') and overlap_percent >= 70, case when list_contains(af, 'barge_ais_missing') then 'no positions of the barge' else overlap_percent || ' percent together, ' || avg_distance_m || ' m apart' end from j where not ais_unavailable
  union all select note_id, 'positions', 'port as stated', port_coordinate_match, case when port_coordinate_match then 'near the port' else 'elsewhere or unknown' end from j where not ais_unavailable
  union all select note_id, 'positions', 'usual pattern', not is_anomaly, 'score ' || anomaly_score from j where not ais_unavailable and anomaly_score is not null
  union all select note_id, 'positions', 'times in UTC', true, 'by the port''s time zone' from j where start_s is not null)
  select note_id, category, "check", case when ok then 'ok' else 'attention' end as status, detail from c""")
def rl_11_verdict_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of document, identity, positions and times of judged notes."""
    return U.verdict_checks(_judged(spark, d))


@query(f"""with {_J}, b as (select *, coalesce(density not between 0.82e0 and 1.01e0, false) as fd, coalesce(sulphur_content > 0.5e0, false) as fs, flashpoint < 60 as ff, barge_ais_missing and not barge_missing and not is_anomaly as gap, len(list_filter(af, lambda f: f <> 'ais_unavailable')) as others from j),
  c as (select *, greatest(0e0, 1 - case when fd then 0.33e0 else 0 end - case when fs then 0.33e0 else 0 end - case when ff then 0.34e0 else 0 end) as lim, greatest(0e0, 1 - case when barge_ais_missing then 0.5e0 else 0 end - 0.2e0 * others) as dat,
    case when fd or fs or ff then 'HIGH_RISK' when gap and classification in ('VALID', 'SUSPICIOUS') then 'REVIEW_REQUIRED' else classification end as label from b)
  select note_id, {sql_round('lim', 2)} as limits, {sql_round('dat', 2)} as data, {sql_round('ocr_confidence * 0.4e0 + dat * 0.35e0 + lim * 0.25e0', 4)} as overall, label as new_classification,
    case when fd or fs or ff then 'A limit for marine fuel is broken.' when gap and label = 'REVIEW_REQUIRED' then 'The barge has no positions for the delivery; nothing unusual was found.' else 'as before' end as new_reason,
    array_to_string(list_filter([case when fd then 'marpol_density_violation' end, case when fs then 'marpol_sulphur_violation' end, case when ff then 'marpol_flashpoint_violation' end], lambda x: x is not null), ',') as violations from c""")
def rl_09_compliance_override(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts judged again after an edit, by the limits for fuel and what is known of the barge."""
    return U.compliance_review(_judged(spark, d)).select("note_id", "limits", "data", "overall", "new_classification", "new_reason", F.array_join("violations", ",").alias("violations"))


@query("""select id, code, description from (select o_orderkey as id, unnest([case o_orderkey % 4 when 1 then 'ais_unavailable' when 2 then 'barge_ais_missing' when 3 then 'port_coordinate_mismatch' end, case o_orderkey % 5 when 2 then 'vessel_name_fuzzy_match' end]) as code from orders) x join (values
  ('ais_unavailable', 'No positions could be had, so the place is unverified'), ('barge_ais_missing', 'The barge has no positions for the delivery'), ('port_coordinate_mismatch', 'Positions lie far from the stated port'), ('vessel_name_fuzzy_match', 'The name resembles the registered one')) as t(code, description) using (code)""")
def rl_14_flag_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the flags of positions and identity."""
    codes = _staged(spark, d).select("id", F.explode(F.concat("anomaly_flags", F.filter("identity_flags", lambda f: f == "vessel_name_fuzzy_match"))).alias("code"))
    return codes.select("id", "code", U.describe_flag(F.col("code")).alias("description"))


_TEXTS = " ".join(f"when '{k}' then '{v}'" for k, v in U.DESCRIPTIONS.items())


@query(f"with {_CRED}, codes as (select distinct alert_type as code from alerts union select distinct x.f from (select unnest(string_split(flags, ',')) as f from cred) x where x.f <> '') select code, case code {_TEXTS} else replace(code, '_', ' ') end as description from codes")
def rl_14_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the codes that alerts and documents carry."""
    # Outer: else the optimizer asks beforehand whether a note has flags, and works out its fields anew for every flag that names them.
    flags = U.credibility(_fields(spark, d)).select(F.explode_outer("credibility_flags").alias("code")).where("code is not null")
    codes = frame(spark, d, "alerts").select(F.col("alert_type").alias("code")).union(flags).distinct()
    return codes.select("code", U.describe_flag(F.col("code")).alias("description"))


def references(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The registries, ports, tracks and past barges that notes are judged against; small derived ones written once."""
    large = {x: frame(spark, d, x) for x in ("positions", "name_vectors")}
    return large | {x: staged(frame(spark, d, x), x) for x in ("ports", "vessel_registry", "barge_registry", "barge_history", "ships")}


def track_model(spark: SparkSession, d: str, path: str) -> A.Model:
    """A stored forest, fitted on deliveries that have tracks."""
    f = staged(T.build_features(frame(spark, d, "deliveries"), frame(spark, d, "positions")).where("n_vessel > 0").select("id", *T.FEATURES), "model-features")
    return A.fit_model(f, "id", T.FEATURES, path)


#: What a note is compared with among those before it.
SEEN = ["note_id", "vessel_name", "port", "delivery_date", "bdn_reference", "received_s"]


def read_notes(notes: DataFrame) -> DataFrame:
    """Fields of notes, by patterns and else by labels that look alike, and how sure they are; written once."""
    return staged(E.routed(notes).withColumn("extraction_confidence", E.extraction_confidence()), "fields")


def judged_notes(refs: dict[str, DataFrame], fields: DataFrame, model: A.Model | None, seen: DataFrame | None = None) -> DataFrame:
    """Notes to verdicts: duplicates, credibility, vessel, barge, tracks in the port's delivery window, anomaly score, alerts, verdict.

    fields: of `read_notes`. A note is a duplicate of those of the same vessel, port and day received within the window before it, among
    the fields and those in `seen`, notes that were judged earlier.
    """
    t = refs.__getitem__
    known = fields.select(SEEN) if seen is None else fields.select(SEEN).unionByName(seen.select(SEEN))
    again = H.repeats_within(known).where("duplicates > 0").select("note_id", F.lit(True).alias("again"))
    x = U.credibility(fields.join(again, "note_id", "left"), duplicate=F.col("again"))
    times = X.parse_pumping_times(F.col("start_time"), F.col("end_time"), F.lit(None).cast("string"))
    x = R.resolve_port(x.withColumn("t", times), t("ports")).join(t("ports").select(F.col("port").alias("port_name"), "timezone", "utc_offset", "lat", "lon"), "port_name", "left")
    utc = lambda c: X.to_utc(F.col(f"t.{c}"), F.col("timezone"), F.col("utc_offset"))
    x = staged(x.withColumns({"start_s": utc("start_s"), "end_s": utc("end_s")}).withColumnRenamed("port_name", "place"), "credibility")
    ident = staged(R.vessel_identity(x.select("note_id", "vessel_name", "imo"), t("vessel_registry"), vectors=t("name_vectors")), "vessels")
    barge = staged(R.barge_identity(x.select("note_id", "barge_name", "barge_sb_number", "place", "lat", "lon"), t("barge_registry"), t("barge_history"), t("vessel_registry"), t("ships")), "barges")
    asked = x.join(ident.select("note_id", F.col("confirmed_mmsi").alias("vessel_mmsi")), "note_id").join(barge.select("note_id", "barge_mmsi"), "note_id").where("start_s is not null").select(F.col("note_id").alias("id"), "vessel_mmsi", "barge_mmsi", "start_s", "end_s", "quantity_mt")
    feats = staged(T.build_features(asked, t("positions")), "features")
    ais = T.ais_outcome(feats, ident.select(F.col("note_id").alias("id"), F.col("unresolved").alias("vessel_identity_unresolved")))
    # Only tracks that are there are scored.
    tracked = feats.join(ais.where("not ais_unavailable").select("id"), "id", "left_semi")
    scores = A.score(tracked, "id", model).select("id", "anomaly_score", "is_anomaly")
    outcome = ais.join(scores, "id", "left").withColumnRenamed("id", "note_id")
    rows = (
        x.join(ident.select("note_id", F.col("method").alias("identity_method"), F.col("flags").alias("identity_flags"), F.col("unresolved").alias("identity_unresolved"), F.col("confidence").alias("identity_confidence")), "note_id")
        .join(barge.select("note_id", F.col("method").alias("barge_method"), F.col("flags").alias("barge_flags"), F.col("confidence").alias("barge_confidence"), "barge_ais_missing"), "note_id")
        .join(outcome, "note_id", "left")
        .withColumns({"ais_unavailable": F.coalesce("ais_unavailable", F.lit(True)), "anomaly_flags": F.coalesce("anomaly_flags", F.array(F.lit("ais_unavailable"))), "is_anomaly": F.coalesce("is_anomaly", F.lit(False))})
    )
    return U.verdicts(U.with_alerts(rows))


def received_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the time at which they came in."""
    return frame(spark, d, "notes").withColumnRenamed("end_s", "received_s")


def verdict_columns(v: DataFrame, *more: str) -> DataFrame:
    return v.select(*more, "note_id", "classification", "confidence", "human_review_required", "overall_fraud_risk", "credibility_score", "verdict_reason", "identity_method", "identity_confidence", "identity_unresolved", "barge_method", "barge_confidence", "barge_missing", "ais_unavailable", "is_anomaly", "anomaly_score", "ocr_confidence", "extraction_confidence", F.array_join("anomaly_flags", ",").alias("anomaly_flags"), F.array_contains("credibility_flags", "duplicate_bdn_detected").alias("duplicate"))


def rl_15_note_to_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One verdict per note, with what it rests on."""
    model = track_model(spark, d, f"{shared_folder(spark)}/models/{uuid.uuid4().hex}")
    return verdict_columns(judged_notes(references(spark, d), read_notes(received_notes(spark, d)), model))


query()(rl_15_note_to_verdict)
