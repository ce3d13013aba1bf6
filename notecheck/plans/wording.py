"""Queries over OCR words, document classes and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import rules as U
from ..operators import words as O
from ..sources.adapters import frame
from .base import query, sql_round

CONF = f"conf as (select note_id, count(*) as n, {sql_round('avg(conf) / 100', 3)} as confidence, {sql_round('case when count(*) >= 5 then var_samp(conf) else 100e0 end', 2)} as var_samp, {sql_round('case when count(*) >= 5 then var_pop(conf) else 100e0 end', 2)} as var_pop from ocr_words where conf <> -1 group by note_id)"
LINES = "lines as (select note_id, page, block_num, par_num, line_num, string_agg(text, ' ' order by word_num, pos) as line from ocr_words where trim(text) <> '' group by all)"


def _w(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "ocr_words")


@query("select note_id, pos, text, conf from ocr_words")
def src_09_words(spark: SparkSession, d: str) -> DataFrame:
    return _w(spark, d).select("note_id", "pos", "text", "conf")


@query("select note_id, count(*) as n from ocr_words where trim(text) <> '' and conf > 0 group by note_id")
def flt_06_readable_words(spark: SparkSession, d: str) -> DataFrame:
    return O.readable(_w(spark, d)).groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CONF} select note_id, n, confidence from conf")
def ag_15_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return O.confidence(_w(spark, d)).select("note_id", "n", "confidence")


@query(f"with {CONF} select note_id, var_samp, var_pop from conf")
def ag_16_confidence_variance(spark: SparkSession, d: str) -> DataFrame:
    return O.confidence(_w(spark, d)).select("note_id", "var_samp", "var_pop")


@query(f"with {LINES} select * from lines")
def ag_17_lines(spark: SparkSession, d: str) -> DataFrame:
    return O.lines(_w(spark, d))


@query(f"with {LINES}, pages as (select note_id, page, string_agg(line, chr(10) order by block_num, par_num, line_num) as t from lines where page <= 3 group by all) select note_id, md5(string_agg(t, chr(10) || chr(10) order by page)) as digest from pages group by note_id")
def ag_18_page_texts(spark: SparkSession, d: str) -> DataFrame:
    return O.page_texts(_w(spark, d)).select("note_id", F.md5("text").alias("digest"))


@query("select note_id, page, min(left_px) as left_px, min(top_px) as top_px, max(left_px + width_px) - min(left_px) as width_px, max(top_px + height_px) - min(top_px) as height_px from ocr_words group by note_id, page")
def ag_19_boxes(spark: SparkSession, d: str) -> DataFrame:
    return O.merged_boxes(_w(spark, d), ["note_id", "page"])


_PASSES = "passes as (select note_id, pos % 3 as pass_no, floor(avg(conf) * 10 + 0.500001e0) / 1000 as confidence from ocr_words group by note_id, pos % 3)"


@query(f"with {_PASSES} select note_id, pass_no, confidence from (select *, row_number() over (partition by note_id order by case when pass_no = 0 and confidence >= case note_id % 3 when 0 then 0.75e0 when 1 then 0.65e0 else 0.5e0 end then 0 else 1 end, confidence desc, pass_no) as r from passes) x where r = 1")
def wn_06_best_pass(spark: SparkSession, d: str) -> DataFrame:
    p = _w(spark, d).groupBy("note_id", (F.col("pos") % 3).alias("pass_no")).agg((F.floor(F.avg("conf") * 10 + 0.500001) / 1000).alias("confidence"))
    kind = F.element_at(F.array(F.lit("DIGITAL"), F.lit("SCANNED"), F.lit("HANDWRITTEN")), (F.col("note_id") % 3 + 1).cast("int"))
    return O.best_pass(p, O.pass_threshold(kind))


@query("select o_orderkey as id, o_orderkey % 2 = 0 and (o_orderkey % 100) / 100e0 < 0.4e0 and (o_orderkey % 37) / 37e0 > (o_orderkey % 100) / 100e0 + 0.08e0 as second_wins from orders")
def wn_07_retry_choice(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return frame(spark, d, "orders").select(k.alias("id"), O.retry_choice(F.when(k % 2 == 0, "DIGITAL").otherwise("HANDWRITTEN"), (k % 100) / 100.0, (k % 37) / 37.0).alias("second_wins"))


# Eight values a note, spread over its whole text: two words with others between, one word, the beginning of one, one that is not there.
_VALUE = "case k % 4 when 0 then regexp_replace(text, '\\s', '', 'g') || ' ' || regexp_replace(nxt, '\\s', '', 'g') when 1 then regexp_replace(text, '\\s', '', 'g') when 2 then substr(regexp_replace(text, '\\s', '', 'g'), 1, 3) else regexp_replace(text, '\\s', '', 'g') || ' zzqq' end"
_VALUES = f"""vals as (select note_id, 'f' || cast(k as string) as field, pos, {_VALUE} as value from (select note_id, pos, text, lead(text, 3) over (partition by note_id order by pos) as nxt, count(*) over (partition by note_id) as c from ocr_words) x
  join (select unnest(range(8)) as k) y on pos = cast(floor(c * k / 8) as bigint) where nxt is not null)"""
_PLACED = f"""t as (select note_id, pos, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as tok, left_px, top_px, width_px, height_px from ocr_words),
  v2 as (select note_id, field, value, list_filter(list_transform(regexp_split_to_array(value, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '') as tk from vals),
  s1 as (select v2.note_id, field, any_value(tk) as tk, min(a.pos) as at from v2 join t a on a.note_id = v2.note_id and a.tok = tk[1] where len(tk) > 0 group by 1, 2),
  s2 as (select s1.note_id, field, s1.at from s1 where len(tk) = 1 or exists (select 1 from t b where b.note_id = s1.note_id and b.pos > s1.at and b.tok = tk[2])),
  s3 as (select v2.note_id, field, arg_max(pos, (length(tok), -pos)) as at from v2 join t on t.note_id = v2.note_id where tok <> '' and len(tk) = 1 and not regexp_full_match(trim(value), '[0-9]{{7}}') and (contains(tok, tk[1]) or contains(tk[1], tok)) and not exists (select 1 from s2 where s2.note_id = v2.note_id and s2.field = v2.field) group by 1, 2),
  boxes as (select * from s2 union all select * from s3)"""


@query(f"with {_VALUES}, {_PLACED} select * from boxes")
def arr_02_value_boxes(spark: SparkSession, d: str) -> DataFrame:
    return O.value_boxes(_values(spark, d), _w(spark, d)).select("note_id", "field", "at")


def _values(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = _w(spark, d).withColumn("nxt", F.lead("text", 3).over(W.partitionBy("note_id").orderBy("pos"))).withColumn("c", F.count(F.lit(1)).over(W.partitionBy("note_id")))
    k = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.floor(F.col("c") * k / 8) == F.col("pos"), k)), lambda k: k.isNotNull())).alias("k")
    at = w.where("nxt is not null").select("note_id", "text", "nxt", k)
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    value = F.when(F.col("k") % 4 == 0, F.concat_ws(" ", bare("text"), bare("nxt"))).when(F.col("k") % 4 == 1, bare("text")).when(F.col("k") % 4 == 2, F.substring(bare("text"), 1, 3)).otherwise(F.concat(bare("text"), F.lit(" zzqq")))
    return at.select("note_id", F.concat(F.lit("f"), F.col("k").cast("string")).alias("field"), value.alias("value"))


@query(f"with {_VALUES}, {_PLACED} select vals.note_id, vals.field, boxes.at is not null as found from vals left join boxes on boxes.note_id = vals.note_id and boxes.field = vals.field")
def arr_03_highlights(spark: SparkSession, d: str) -> DataFrame:
    return O.highlights(_values(spark, d), _w(spark, d)).select("note_id", "field", "found")


@query(f"with {_VALUES}, {_PLACED} select vals.note_id, count(boxes.at) as located, count(*) as total, count(boxes.at) >= count(*) - 2 as ok from vals left join boxes on boxes.note_id = vals.note_id and boxes.field = vals.field group by vals.note_id")
def ag_20_located(spark: SparkSession, d: str) -> DataFrame:
    h = O.highlights(_values(spark, d), _w(spark, d))
    n = F.count_if("found")
    return h.groupBy("note_id").agg(n.alias("located"), F.count(F.lit(1)).alias("total"), (n >= F.count(F.lit(1)) - 2).alias("ok"))


@query(f"with {CONF} select note_id, case when note_id % 5 = 0 then 'DIGITAL' when n < 5 then 'HANDWRITTEN' when confidence >= 0.82 and var_samp <= 350 then 'DIGITAL' else 'HANDWRITTEN' end as doc_type from conf")
def cl_01_document_class(spark: SparkSession, d: str) -> DataFrame:
    c = O.confidence(_w(spark, d))
    k = U.document_class(F.when(F.col("note_id") % 5 == 0, 100).otherwise(0), F.col("confidence"), F.col("var_samp"), F.col("n"))
    return c.select("note_id", k["doc_type"].alias("doc_type"))


@query(f"with {CONF} select note_id, case when confidence >= 0.82 and var_pop < 350 then 'DIGITAL' when confidence >= 0.6 and (note_id % 10) / 100e0 >= 0.05e0 then 'SCANNED' else 'HANDWRITTEN' end as doc_type from (select note_id, least(1e0, confidence + (note_id % 5) / 10e0) as confidence, var_pop - 600 * (note_id % 2) as var_pop from conf) x")
def cl_02_legacy_class(spark: SparkSession, d: str) -> DataFrame:
    c = O.confidence(_w(spark, d)).select("note_id", F.least(F.lit(1.0), F.col("confidence") + (F.col("note_id") % 5) / 10.0).alias("confidence"), (F.col("var_pop") - 600 * (F.col("note_id") % 2)).alias("var_pop"))
    return c.select("note_id", U.legacy_class(F.col("confidence"), F.col("var_pop"), (F.col("note_id") % 10) / 100.0).alias("doc_type"))


@query("""select imo, array_to_string(list_filter([case when not regexp_full_match(imo, '[0-9]{7}') then 'imo_format' end, case when not regexp_full_match(mmsi, '[0-9]{9}') then 'mmsi_format' end, case when count(*) over (partition by imo) > 1 then 'imo_unique' end, case when count(*) over (partition by mmsi) > 1 then 'mmsi_unique' end], lambda x: x is not null), ',') as broken, name
  from (select case when cast(imo as bigint) % 50 = 0 then 'X' || imo when cast(imo as bigint) % 70 = 1 then '1000001' else imo end as imo, mmsi, name from vessel_registry) x""")
def dq_01_vessels(spark: SparkSession, d: str) -> DataFrame:
    v = frame(spark, d, "vessel_registry").select(F.expr("case when cast(imo as bigint) % 50 = 0 then 'X' || imo when cast(imo as bigint) % 70 = 1 then '1000001' else imo end").alias("imo"), "mmsi", "name")
    return Q.violations(v, Q.vessel_rules(), {"imo_unique": ["imo"], "mmsi_unique": ["mmsi"]}).select("imo", F.array_join("violations", ",").alias("broken"), "name")


@query("""select imo, mmsi, array_to_string(list_filter([case when mmsi is not null and count(*) over (partition by mmsi) > 1 then 'mmsi_unique' end, case when mmsi is not null and flag is not null and count(*) over (partition by mmsi, flag) > 1 then 'pair_unique' end], lambda x: x is not null), ',') as broken
  from (select imo, case when cast(imo as bigint) % 3 = 0 then null when cast(imo as bigint) % 3 = 1 then '000000000' else mmsi end as mmsi, case when cast(imo as bigint) % 7 = 0 then null else flag end as flag from vessel_registry) x""")
def dq_01_null_and_default_keys(spark: SparkSession, d: str) -> DataFrame:
    """A third of the vessels without a number, a third with the same: unknown keys equal nothing, and the frequent one is dealt."""
    v = frame(spark, d, "vessel_registry").selectExpr("imo", "case when cast(imo as bigint) % 3 = 0 then null when cast(imo as bigint) % 3 = 1 then '000000000' else mmsi end as mmsi", "case when cast(imo as bigint) % 7 = 0 then null else flag end as flag")
    return Q.violations(v, {}, {"mmsi_unique": ["mmsi"], "pair_unique": ["mmsi", "flag"]}).select("imo", "mmsi", F.array_join("violations", ",").alias("broken"))


@query("""select seq, broken from (select seq, array_to_string(list_filter([case when speed - 1 < 0 then 'speed_sign' end, case when heading not between 0 and 360 then 'heading_range' end, case when (seq % 300) + 90 > 360 then 'course_range' end, case when count(*) over (partition by mmsi, cast(floor(ts / 600) as bigint)) > 1 then 'position_unique' end], lambda x: x is not null), ',') as broken from positions) x where broken <> ''""")
def dq_02_positions(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "positions").select("seq", "mmsi", "lat", "lon", "heading", (F.col("speed") - 1).alias("speed"), ((F.col("seq") % 300) + 90).alias("course"), F.floor(F.col("ts") / 600).alias("recorded_at"))
    _, quarantine = Q.split(Q.violations(p, Q.position_rules(), {"position_unique": ["mmsi", "recorded_at"]}))
    return quarantine.select("seq", F.array_join("violations", ",").alias("broken"))


@query("select id, array_to_string(list_filter([case when id % 23 = 0 then 'time_order' end, case when quantity - 1000 < 0 then 'quantity_sign' end, case when id % 31 = 0 then 'density_sign' end, case when id % 37 = 0 then 'sulphur_sign' end, case when id % 41 = 0 then 'flashpoint_sign' end, case when id % 40 = 0 then 'class_domain' end, case when id % 101 > 100 - id % 2 then 'confidence_range' end, case when id % 103 > 100 then 'credibility_range' end], lambda x: x is not null), ',') as broken from verdicts")
def dq_03_transactions(spark: SparkSession, d: str) -> DataFrame:
    made = {"quantity": "quantity - 1000", "start_s": "10", "end_s": "case when id % 23 = 0 then 5 else 20 end", "density": "case when id % 31 = 0 then 0d else 0.95d end", "sulphur_content": "case when id % 37 = 0 then -0.1d else 0.4d end", "flashpoint": "case when id % 41 = 0 then -1d when id % 2 = 0 then null else 61d end", "classification": "case when id % 40 = 0 then 'OTHER' else classification end", "confidence": "case when id % 101 > 100 - id % 2 then 1.5d else 0.5d end", "credibility_score": "cast(id % 103 as double)"}
    v = frame(spark, d, "verdicts").selectExpr("id", *[f"{e} as {c}" for c, e in made.items()])
    return Q.violations(v, Q.transaction_rules()).select("id", F.array_join("violations", ",").alias("broken"))
