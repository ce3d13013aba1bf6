"""Queries over past verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import history as H
from ..sources import merging, store
from ..sources.adapters import frame
from ..sources.store import staged
from .base import query

AS_OF = 902016000  # 1998-08-02
OPEN = "human_review_required and classification not in ('VALID', 'REJECTED', 'MANUALLY_APPROVED')"


def _v(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "verdicts")


@query("select id, classification from verdicts order by validated_s desc, id limit 200")
def src_10_transactions(spark: SparkSession, d: str) -> DataFrame:
    return H.list_transactions(_v(spark, d)).select("id", "classification")


@query("select id, classification, confirmed_imo from verdicts where id in (1, 7, 33)")
def src_11_point_read(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d).where(F.col("id").isin(1, 7, 33)).select("id", "classification", "confirmed_imo")


@query(f"select id, classification from (select * from verdicts order by validated_s desc, id limit 200) x where {OPEN}")
def sl_01_limit_then_filter(spark: SparkSession, d: str) -> DataFrame:
    return H.list_transactions(_v(spark, d), human_review_only=True).select("id", "classification")


@query("select id, row_number() over (order by validated_s desc, id) as place from verdicts")
def sl_02_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return H.numbered(_v(spark, d).select("id", "validated_s"), [F.desc("validated_s"), F.col("id")]).select("id", "place")


@query("select id, confidence from verdicts order by confidence desc, id limit 100")
def sl_03_user_sort(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d).orderBy(F.desc("confidence"), "id").limit(100).select("id", "confidence")


@query("select mmsi, seq, row_number() over (partition by mmsi order by ts, seq) as place from positions")
def sl_04_positions_by_time(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "positions").select("mmsi", "seq", F.row_number().over(W.partitionBy("mmsi").orderBy("ts", "seq")).alias("place"))


#: How many a list shows: duplicates, further candidates (after the first), reasons, archive results, audit entries, word confidences.
CAPS = {"duplicates": (1, 5), "candidates": (2, 2), "reasons": (1, 3), "archives": (1, 5), "audit": (1, 50), "confidences": (1, 200)}


@query("select custkey, " + ", ".join(f"array_to_string(ids[{a}:{a + n - 1}], ',') as {k}" for k, (a, n) in CAPS.items()) + ", n from (select custkey, list_sort(list(id)) as ids, count(*) as n from verdicts group by custkey) x")
def sl_05_caps(spark: SparkSession, d: str) -> DataFrame:
    """The caps over each customer's verdicts; no more ids are gathered than the longest list shows."""
    longest = max(a + n - 1 for a, n in CAPS.values())
    top = _v(spark, d).select("custkey", "id", F.row_number().over(W.partitionBy("custkey").orderBy("id")).alias("r"))
    ids = top.groupBy("custkey").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= longest, F.col("id")))).alias("ids"), F.count(F.lit(1)).alias("n"))
    return ids.select("custkey", *[F.array_join(F.transform(F.slice("ids", a, n), lambda x: x.cast("string")), ",").alias(k) for k, (a, n) in CAPS.items()], "n")


@query(f"select id, classification from verdicts where {OPEN}")
def flt_01_review_queue(spark: SparkSession, d: str) -> DataFrame:
    return H.review_queue(_v(spark, d)).select("id", "classification")


@query("select id from verdicts where classification = 'SUSPICIOUS'")
def flt_02_classification(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d).where("classification = 'SUSPICIOUS'").select("id")


@query("select imo, name from vessel_registry where not (flag = '7')")
def flt_03_drop_placeholders(spark: SparkSession, d: str) -> DataFrame:
    r = frame(spark, d, "vessel_registry").withColumn("source", F.when(F.col("flag") == "7", "stub"))
    return r.where("source is null or source <> 'stub'").select("imo", "name")


@query("select imo, name from vessel_registry where contains(lower(type_specific), 'tanker')")
def flt_04_tankers(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "vessel_registry").where(F.contains(F.lower("type_specific"), F.lit("tanker"))).select("imo", "name")


@query(f"select id from verdicts where (case when id % 10 = 0 then null else validated_s end) is null or validated_s >= {AS_OF} - 90 * 86400")
def flt_05_recent(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d).withColumn("at", F.when(F.col("id") % 10 != 0, F.col("validated_s")))
    return H.recent(v, "at", F.lit(AS_OF), 90).select("id")


@query("select confirmed_imo, id, classification from (select *, row_number() over (partition by confirmed_imo order by validated_s desc, id desc) as r from verdicts) x where r = 1")
def wn_04_latest_verdict(spark: SparkSession, d: str) -> DataFrame:
    return H.latest_per(_v(spark, d), "confirmed_imo", [F.col("validated_s"), F.col("id")]).select("confirmed_imo", "id", "classification")


@query("""select id, field, old_value, new_value, place, edits, last_edited_s from (select *, lag(new_value) over (partition by id, field order by edited_s, seq) as old_value,
  row_number() over (partition by id, field order by edited_s desc, seq desc) as place, count(*) over (partition by id, field) as edits, max(edited_s) over (partition by id, field) as last_edited_s from edits) x where old_value is distinct from new_value""")
def wn_10_edit_log(spark: SparkSession, d: str) -> DataFrame:
    return H.edit_log(frame(spark, d, "edits")).select("id", "field", "old_value", "new_value", "place", "edits", "last_edited_s")


@query("select classification, count(*) as n, count(*) filter (human_review_required) as in_review from verdicts group by classification")
def ag_12_histogram(spark: SparkSession, d: str) -> DataFrame:
    return H.histogram(_v(spark, d))


@query("select min(quantity_mt) as min_q, max(quantity_mt) as max_q, floor(avg(quantity_mt) * 100 + 0.500001e0) / 100 as avg_q, min((end_s - start_s) / 3600e0) as min_h, max((end_s - start_s) / 3600e0) as max_h from deliveries")
def ag_13_calibration(spark: SparkSession, d: str) -> DataFrame:
    h = (F.col("end_s") - F.col("start_s")) / 3600.0
    return frame(spark, d, "deliveries").agg(F.min("quantity_mt").alias("min_q"), F.max("quantity_mt").alias("max_q"), (F.floor(F.avg("quantity_mt") * 100 + 0.500001) / 100).alias("avg_q"), F.min(h).alias("min_h"), F.max(h).alias("max_h"))


@query(f"select count(*) as n from verdicts where {OPEN}")
def ag_21_count(spark: SparkSession, d: str) -> DataFrame:
    return H.review_queue(_v(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("""select a.id as note_id, n - 1 as duplicates, array_to_string(list_filter(ids[1:6], lambda x: x <> a.id)[1:5], ',') as others from note_fields a
  join (select upper(vessel_name) as v, upper(port) as w, floor(from_s / 86400) as d, count(*) as n, list_sort(list(id)) as ids from note_fields group by all having count(*) > 1) b on upper(a.vessel_name) = v and upper(a.port) = w and floor(a.from_s / 86400) = d""")
def jn_15_duplicates(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "note_fields").select(F.col("id").alias("note_id"), "vessel_name", "port", F.floor(F.col("from_s") / 86400).alias("delivery_date"))
    return H.duplicates(n).select("note_id", "duplicates", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


#: Notes over two thirds of a year, each reference used by up to four of them.
_RECEIVED = "select id as note_id, vessel_name, port, floor(from_s / 86400) as delivery_date, 'REF-' || cast(id % (select count(*) / 4 + 1 from deliveries) as string) as bdn_reference, end_s + id % 8 * 30 * 86400 as received_s from note_fields"


def _received(spark: SparkSession, d: str) -> DataFrame:
    n, total = frame(spark, d, "note_fields"), frame(spark, d, "deliveries").count()
    reference = F.concat(F.lit("REF-"), F.col("id") % F.lit(total // 4 + 1))
    return n.select(F.col("id").alias("note_id"), "vessel_name", "port", F.floor(F.col("from_s") / 86400).alias("delivery_date"), reference.alias("bdn_reference"), (F.col("end_s") + F.col("id") % 8 * 30 * 86400).alias("received_s"))


_BEFORE = "b.received_s >= a.received_s - 90 * 86400 and (b.received_s < a.received_s or (b.received_s = a.received_s and b.note_id < a.note_id))"
_SAME = f"""n as ({_RECEIVED.replace('count(*) / 4', 'count(*) // 4')}), same as (select a.note_id, count(*) as duplicates, array_to_string(list(b.note_id order by b.received_s, b.note_id)[1:5], ',') as others
  from n a join n b on upper(a.vessel_name) = upper(b.vessel_name) and upper(a.port) = upper(b.port) and a.delivery_date = b.delivery_date and {_BEFORE} group by 1)"""


@query(f"""with {_SAME}, uses as (select a.note_id, count(*) as reference_uses from n a join n b on upper(a.bdn_reference) = upper(b.bdn_reference) and {_BEFORE} group by 1)
  select coalesce(same.note_id, uses.note_id) as note_id, coalesce(duplicates, 0) as duplicates, coalesce(others, '') as others, coalesce(reference_uses, 0) as reference_uses, coalesce(reference_uses, 0) > 1 as reused_reference from same full join uses on uses.note_id = same.note_id""")
def jn_15_within_window(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates and reused references of the 90 days before a note."""
    return H.repeats_within(_received(spark, d)).withColumn("others", F.array_join(F.transform("others", lambda x: x.cast("string")), ","))


@query("""with v as (select imo, arg_max(id, validated_s * 100000000 + id) as id from (select confirmed_imo as imo, id, validated_s from verdicts union all select extracted_imo, id, validated_s from verdicts where extracted_imo is not null and extracted_imo <> confirmed_imo) x group by imo)
  select r.imo, v.id as verdict_id, case when v.id is null then 'local_registry' else 'verdict' end as source from vessel_registry r left join v using (imo)""")
def jn_16_vessel_lookup(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d)
    seen = v.select(F.explode(F.array_distinct(F.array("confirmed_imo", "extracted_imo"))).alias("imo"), "id", "validated_s").where("imo is not null")
    last = seen.groupBy("imo").agg(F.max_by("id", F.struct("validated_s", "id")).alias("verdict_id"))
    return frame(spark, d, "vessel_registry").select("imo").join(last, "imo", "left").select("imo", "verdict_id", F.when(F.col("verdict_id").isNull(), "local_registry").otherwise("verdict").alias("source"))


@query("select v.id, a.name as vessel, b.name as barge from verdicts v left join vessel_registry a on a.imo = v.confirmed_imo left join (select mmsi, min(name) as name from barge_registry where mmsi is not null group by mmsi) b on b.mmsi = v.barge_mmsi")
def jn_17_two_dimensions(spark: SparkSession, d: str) -> DataFrame:
    a = frame(spark, d, "vessel_registry").select(F.col("imo").alias("confirmed_imo"), F.col("name").alias("vessel"))
    b = frame(spark, d, "barge_registry").where("mmsi is not null").groupBy(F.col("mmsi").alias("barge_mmsi")).agg(F.min("name").alias("barge"))
    return _v(spark, d).join(a, "confirmed_imo", "left").join(b, "barge_mmsi", "left").select("id", "vessel", "barge")


@query("select id, confirmed_imo from verdicts v where not exists (select 1 from vessel_registry r where r.imo = v.confirmed_imo and contains(lower(type_specific), 'tanker'))")
def jn_18_not_found(spark: SparkSession, d: str) -> DataFrame:
    tankers = frame(spark, d, "vessel_registry").where(F.contains(F.lower("type_specific"), F.lit("tanker"))).select(F.col("imo").alias("confirmed_imo"))
    return _v(spark, d).join(tankers, "confirmed_imo", "left_anti").select("id", "confirmed_imo")


@query("select id, classification, confirmed_imo, cast(floor(validated_s / 86400) as bigint) as validated_day from (select *, row_number() over (partition by confirmed_imo order by validated_s desc, id desc) as r from verdicts) x where r = 1 and confirmed_imo is not null")
def snk_01_verdict_rows(spark: SparkSession, d: str) -> DataFrame:
    """A keyed overwrite by vessel in three batches, the second of them twice, merged by the sink and read back: resolved rows, latest wins."""
    path = f"{store.shared_folder(spark)}/verdicts/{uuid.uuid4().hex}"
    rows = _v(spark, d).select("id", "classification", "confirmed_imo", "validated_s")
    for number in (0, 1, 1, 2):
        merging.merge_batch(rows.where(F.col("id") % 3 == number), path, "thirds", number, period="yyyy-MM")
    return merging.read_table(spark, path).select("id", "classification", "confirmed_imo", F.floor(F.col("validated_s") / 86400).alias("validated_day"))


@query("""with n as (select confirmed_imo as imo, arg_max(case when id % 5 = 0 then '' else 'NEW ' || cast(id as string) end, id) as name, arg_max(barge_mmsi, id) as mmsi, arg_max(case when id % 2 = 0 then '' else classification end, id) as vessel_type from verdicts group by confirmed_imo)
  select coalesce(o.imo, n.imo) as imo, coalesce(nullif(n.name, ''), o.name) as name, coalesce(nullif(n.mmsi, ''), o.mmsi) as mmsi, coalesce(nullif(n.vessel_type, ''), o.type_specific) as vessel_type
  from (select * from vessel_registry where cast(imo as bigint) % 3 <> 0) o full join n on o.imo = n.imo where o.imo is not null or (length(n.imo) = 7 and n.name <> '')""")
def snk_02_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "vessel_registry").where("cast(imo as bigint) % 3 <> 0").select("imo", "name", "mmsi", F.col("type_specific").alias("vessel_type"))
    new = _v(spark, d).select(F.col("confirmed_imo").alias("imo"), F.expr("case when id % 5 = 0 then '' else 'NEW ' || cast(id as string) end").alias("name"), F.col("barge_mmsi").alias("mmsi"), F.expr("case when id % 2 = 0 then '' else classification end").alias("vessel_type"), F.col("id").alias("seq"))
    return H.upsert_vessels(old, new)


_ACT = "case when seq % 3 = 0 then 'approve' when seq % 3 = 1 then 'reject' else 'edit' end"
_DEC = f"select id, {_ACT} as action, case when seq % 3 = 2 then new_value end as note, case when seq % 3 = 2 and seq % 2 = 0 then 'X' || new_value end as barge_mmsi, seq from edits"


@query(f"""select id, case action when 'approve' then 'VALID' when 'reject' then 'REJECTED' else classification end as classification, human_review_required and coalesce(action, 'edit') = 'edit' as human_review_required, note, coalesce(y.barge_mmsi, v.barge_mmsi) as barge_mmsi
  from verdicts v left join (select id, arg_max(action, seq) filter (action <> 'edit') as action, arg_max(note, seq) filter (note is not null) as note, arg_max(barge_mmsi, seq) filter (barge_mmsi is not null) as barge_mmsi from ({_DEC}) x group by id) y using (id)""")
def snk_03_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "edits").selectExpr("id", f"{_ACT} as action", "case when seq % 3 = 2 then new_value end as note", "case when seq % 3 = 2 and seq % 2 = 0 then 'X' || new_value end as barge_mmsi", "seq")
    merged = staged(H.apply_decisions(_v(spark, d).withColumn("note", F.lit(None).cast("string")), e, ["note", "barge_mmsi"]), "decided")
    return merged.select("id", "classification", "human_review_required", "note", "barge_mmsi")


@query("select id, case when id % 2 = 0 then 'VALID' else 'REJECTED' end as classification, false as human_review_required, case when id % 2 = 0 then 'approved' else 'rejected' end || ' by reviewer' as reason from verdicts where human_review_required")
def rl_13_review_rows(spark: SparkSession, d: str) -> DataFrame:
    q = _v(spark, d).where("human_review_required")
    yes = F.col("id") % 2 == 0
    return q.select("id", F.when(yes, "VALID").otherwise("REJECTED").alias("classification"), F.lit(False).alias("human_review_required"), F.concat(F.when(yes, "approved").otherwise("rejected"), F.lit(" by reviewer")).alias("reason"))


@query("select id, coalesce(json_extract_string(payload, '$.class'), classification) as classification, cast(json_extract_string(payload, '$.q') as double) as q from (select id, classification, case when id % 3 = 0 then '{\"q\": ' || cast(id as string) || '.5}' else '{\"class\": \"X' || cast(id % 7 as string) || '\", \"q\": 1}' end as payload from verdicts) x")
def prj_04_nested_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = _v(spark, d).select("id", "classification", F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"q": '), F.col("id").cast("string"), F.lit(".5}"))).otherwise(F.concat(F.lit('{"class": "X'), (F.col("id") % 7).cast("string"), F.lit('", "q": 1}'))).alias("payload"))
    return p.select("id", F.coalesce(F.get_json_object("payload", "$.class"), "classification").alias("classification"), F.get_json_object("payload", "$.q").cast("double").alias("q"))


@query("select event_id, json_extract_string(props, '$.k') as k, length(props) as n from events")
def jsn_01_payload(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


@query("select id, '{\"id\":' || cast(id as string) || ',\"classification\":\"' || classification || '\"}' as report from verdicts")
def jsn_02_report(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d).select("id", F.to_json(F.struct("id", "classification")).alias("report"))


@query("select id, 'BDN-' || cast(1970 + cast(floor(validated_s / 31556952) as bigint) as string) || '-' || upper(substr(md5(cast(id as string)), 1, 6)) as transaction_id from verdicts")
def prj_06_transaction_id(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d).select("id", H.transaction_id(1970 + F.floor(F.col("validated_s") / 31556952), F.col("id")).alias("transaction_id"))


@query("select id, 'stored' as source from verdicts where classification = 'VALID'")
def st_05_source_preference(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d)
    return H.prefer(v.where("classification = 'VALID'").select("id", F.lit("stored").alias("source")), v.select("id", F.lit("memory").alias("source")))


@query("select imo as key, name, 'vessel' as source from vessel_registry union all select sb_number, name, 'barge' from barge_registry union all select cast(ord as string), port, 'port' from ports")
def st_07_union(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, k, n, s: frame(spark, d, t).select(F.col(k).cast("string").alias("key"), F.col(n).alias("name"), F.lit(s).alias("source"))
    return part("vessel_registry", "imo", "name", "vessel").unionByName(part("barge_registry", "sb_number", "name", "barge")).unionByName(part("ports", "ord", "port", "port"))
