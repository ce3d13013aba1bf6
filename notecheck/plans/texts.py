"""Queries over note text: extraction and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import cosine, rounded
from ..operators import extract as E
from ..params import DEFAULT
from ..sources.adapters import ctes, frame
from ..sources.store import staged
from .base import ORACLES, QUERIES, query, sql_round


def scalar(name: str, source: str, key: str, given: str, f: Callable[[Column], Column], sql: str | None) -> None:
    """Registers key and f(given) over a table; in the oracle's expression, {x} stands for the input."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return frame(spark, d, source).select(key, f(F.expr(given)).alias("out"))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = ctes(f"select {key}, {sql.replace('{x}', '(' + given + ')')} as out from {source}")


def _rx(pattern: str) -> str:
    return pattern.replace("'", "''")


NAMED = "case when p_partkey % 5 = 0 then 'm.v. ' || p_name when p_partkey % 5 = 1 then 'MT ' || upper(p_name) when p_partkey % 5 = 2 then '  ' || upper(p_name) || '  7 ' when p_partkey % 5 = 3 then 'M/V ' || p_name || '-II' else p_name || '.X' end"
NUMBERED = "case when o_orderkey % 4 = 0 then '1,' || lpad(cast(o_orderkey % 1000 as string), 3, '0') || '.25 MT' when o_orderkey % 4 = 1 then cast(o_orderkey % 1400 as string) || ' kg/m3' when o_orderkey % 4 = 2 then 'n/a' else '0.' || cast(o_orderkey % 1000 as string) end"
IMO = "case when o_orderkey % 3 = 0 then 'IMO ' || cast(9000000 + o_orderkey as string) when o_orderkey % 3 = 1 then cast(o_orderkey as string) else '93-' || lpad(cast(o_orderkey % 100000 as string), 5, '0') end"
HHMM = "(lpad(cast(o_orderkey % 27 as string), 2, '0') || lpad(cast(o_orderkey % 67 as string), 2, '0'))"
CLOCK = f"case when o_orderkey % 5 = 0 then {HHMM} when o_orderkey % 5 = 1 then {HHMM} || ' HRS' when o_orderkey % 5 = 2 then cast(1 + o_orderkey % 12 as string) || ':30 PM' when o_orderkey % 5 = 3 then '07:45' else cast(1 + o_orderkey % 12 as string) || ':05 am' end"
STAMP = "case when o_orderkey % 5 = 0 then '1 June 2024 ' || cast(o_orderkey % 10 as string) when o_orderkey % 5 = 1 then '01/06/2024 14' when o_orderkey % 5 = 2 then '11Feb2026 930' when o_orderkey % 5 = 3 then '2024-06-01  14:' || lpad(cast(o_orderkey % 60 as string), 2, '0') else 'soon' end"
COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TITLE = "array_to_string(list_transform(string_split(lower({}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
PREFIX = "'^(MT |MV |M/V |M/T |BT )'"
NUM = "try_cast(regexp_replace({x}, '[^0-9.]', '', 'g') as double)"

scalar("str_01_slug", "part", "p_partkey", NAMED, X.slug, "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')")
scalar("str_02_name_key", "part", "p_partkey", NAMED, X.name_key, "regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')")
scalar("str_03_token_key", "part", "p_partkey", NAMED, X.token_key, "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')")
scalar("str_04_barge_key", "part", "p_partkey", NAMED, X.barge_key, f"replace(replace(regexp_replace(upper(trim({{x}})), {PREFIX}, ''), ' ', ''), '-', '')")
scalar("str_05_imo", "orders", "o_orderkey", IMO, X.normalize_imo, "case when length(regexp_replace({x}, '[^0-9]', '', 'g')) = 7 then regexp_replace({x}, '[^0-9]', '', 'g') end")
scalar("str_06_port", "part", "p_partkey", "'  port of   ' || upper(p_name)", X.normalize_port, TITLE.format(COLLAPSE.format("{x}")))
_VESSEL = COLLAPSE.format(r"regexp_replace(trim({x}), '(?i)^(M\.?V\.?|M\.?T\.?)\s+', '')")
scalar("str_07_vessel_name", "part", "p_partkey", NAMED, X.normalize_vessel_name, f"case when {_VESSEL} = upper({_VESSEL}) and length({_VESSEL}) > 2 then {TITLE.format(_VESSEL)} else {_VESSEL} end")
scalar("str_08_barge_name", "part", "p_partkey", NAMED, X.normalize_barge_name, COLLAPSE.format(f"regexp_replace(upper(trim({{x}})), {PREFIX}, '')"))
scalar("str_09_quantity", "orders", "o_orderkey", NUMBERED, X.to_number, NUM)
scalar("str_10_density", "orders", "o_orderkey", NUMBERED, lambda c: rounded(X.normalize_density(c), 4), f"case when {NUM} > 10 then {sql_round(NUM + ' / 1000', 4)} else {sql_round(NUM, 4)} end")
scalar("str_12_clean_text", "documents", "doc_id", "replace(replace(replace(text, ' of ', ' | '), ' in ', '-' || chr(10)), ' the ', '  ' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10))", lambda c: F.md5(X.clean_ocr_text(c)), r"md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[|~`^¦]', ' ', 'g'), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')))")
scalar("str_13_keywords", "notes", "note_id", "raw_text", lambda c: X.has_keyword(c, DEFAULT.correction_keywords), " or ".join(f"contains(lower({{x}}), '{w}')" for w in DEFAULT.correction_keywords))
scalar("str_14_reference", "notes", "note_id", "raw_text", X.bdn_reference, r"coalesce(nullif(regexp_extract({x}, '(?i)\bBDN\s*(?:No|Number|Ref(?:erence)?)\.?\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]+)', 1), ''), nullif(regexp_extract({x}, '\b(BDN-[A-Z0-9-]+)\b', 1), ''))")
PORT_FIXES = {"SINGAPOUR": "Singapore", "SINGAP0RE": "Singapore", "R0TTERDAM": "Rotterdam", "FUJAIRA": "Fujairah", "HONGKONG": "Hong Kong"}


def fix_port(c: Column) -> Column:
    """Known misreadings corrected, trailing numbers dropped."""
    bare = F.trim(F.regexp_replace(c, r"[ ,]*[0-9]+$", ""))
    known = F.create_map(*[F.lit(x) for kv in PORT_FIXES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(bare)), bare)


scalar("str_15_port_typos", "orders", "o_orderkey", "case o_orderkey % 5 when 0 then 'Singap0re 4' when 1 then 'HongKong' when 2 then 'Fujaira, 12' when 3 then 'Rotterdam 7' else 'Houston' end", fix_port, "case upper(trim(regexp_replace({x}, '[ ,]*[0-9]+$', ''))) " + " ".join(f"when '{k}' then '{v}'" for k, v in PORT_FIXES.items()) + " else trim(regexp_replace({x}, '[ ,]*[0-9]+$', '')) end")
scalar("str_16_sb_number", "barge_registry", "suppkey", "substr(sb_number, 1, 2) || ' ' || substr(sb_number, 3) || '  '", lambda c: F.regexp_replace(c, r"\s+", ""), r"regexp_replace({x}, '\s+', '', 'g')")
scalar("str_17_title_case", "part", "p_partkey", "case when p_partkey % 2 = 0 then upper(p_name) else p_name end", lambda c: F.when(F.upper(c) == c, X.title(c)).otherwise(c), f"case when upper({{x}}) = {{x}} then {TITLE.format('{x}')} else {{x}} end")
scalar("dt_04_time_only", "orders", "o_orderkey", CLOCK, X.parse_time_only, r"case when regexp_full_match({x}, '(?i)\s*\d{2}:?\d{2}\s*(HRS\.?|H)?\s*') and cast({x}[1:2] as int) < 24 and cast(replace({x}, ':', '')[3:4] as int) < 60 then cast({x}[1:2] as int) * 60 + cast(replace({x}, ':', '')[3:4] as int) end")
scalar("dt_05_timestamp", "orders", "o_orderkey", STAMP, X.normalize_timestamp, "case o_orderkey % 5 when 0 then '1 June 2024 0' || cast(o_orderkey % 10 as string) || ':00' when 1 then '01/06/2024 14:00' when 2 then '11 Feb 2026 00:00' when 3 then '2024-06-01 14:' || lpad(cast(o_orderkey % 60 as string), 2, '0') else 'soon' end")
scalar("dt_06_time_text", "orders", "o_orderkey", CLOCK, X.normalize_time_only, f"case o_orderkey % 5 when 0 then {HHMM}[1:2] || ':' || {HHMM}[3:4] when 1 then {HHMM}[1:2] || ':' || {HHMM}[3:4] when 2 then lpad(cast(case when 1 + o_orderkey % 12 = 12 then 12 else 13 + o_orderkey % 12 end as string), 2, '0') || ':30' when 3 then '07:45' else lpad(cast((1 + o_orderkey % 12) % 12 as string), 2, '0') || ':05' end")
scalar("dt_03_alongside", "orders", "o_orderkey", "case o_orderkey % 4 when 0 then 'alongside ' || cast(1 + o_orderkey % 28 as string) || ' MARCH 2026 2300' when 1 then '0' || cast(1 + o_orderkey % 9 as string) || '/03/2026 21:22' when 2 then '2026-02-1' || cast(o_orderkey % 10 as string) else 'none' end", X.alongside_day, "date_diff('day', date '1970-01-01', case o_orderkey % 4 when 0 then make_date(2026, 3, 1 + o_orderkey % 28) when 1 then make_date(2026, 3, 1 + o_orderkey % 9) when 2 then make_date(2026, 2, 10 + o_orderkey % 10) end)")
scalar("dt_11_duration", "orders", "o_orderkey", "case when o_orderkey % 3 = 0 then '2024-06-01' else cast(1 + o_orderkey % 20 as string) || ' June 2024 ' || lpad(cast(o_orderkey % 24 as string), 2, '0') || ':30' end", lambda c: X.duration_hours(F.lit("1 June 2024 00:00"), c), "case when o_orderkey % 3 <> 0 then (o_orderkey % 20) * 24e0 + o_orderkey % 24 + 0.5e0 end")
scalar("sim_02_levenshtein", "part", "p_partkey", "p_name", lambda c: rounded(X.similarity(c, F.concat(F.lit("x "), F.reverse(c), F.lit(" "), c)), 6), sql_round("1 - levenshtein(array_to_string(list_sort(string_split(upper({x}), ' ')), ' '), array_to_string(list_sort(string_split(upper('x ' || reverse({x}) || ' ' || {x}), ' ')), ' ')) / cast(greatest(length({x}), length({x}) * 2 + 3) as double)", 6))
scalar("sim_01_token_sort", "part", "p_partkey", "upper(p_name)", lambda c: rounded(X.token_sort_ratio(c, F.concat(F.substring(c, 1, 3), F.substring(c, 5, 100), F.lit(" II"))), 4), None)
scalar("flt_07_imo_shape", "orders", "o_orderkey", IMO, lambda c: c.rlike("^[0-9]{7}$"), "regexp_full_match({x}, '[0-9]{7}')")
_TEXT_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as line from documents)"


def _text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every text."""
    return frame(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))


@query(f"with {_TEXT_LINES} select doc_id, line, " + r"length(x) < 2 or length(x) - length(regexp_replace(x, '[@<>=\\\[\]]', '', 'g')) >= 2 or regexp_matches(x, '^[a-z] ') or (length(x) > 3 and length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) / cast(length(x) as double) < 0.7) as out from l")
def dq_06_garbage(spark: SparkSession, d: str) -> DataFrame:
    return _text_lines(spark, d).select("doc_id", "line", E.is_garbage(F.col("x")).alias("out"))


@query(f"with {_TEXT_LINES} select doc_id, line, " + r"nullif(regexp_replace(array_to_string(regexp_split_to_array(x, '\s+')[1:4], ' '), '^[\s,;:.\-]+|[\s,;:\-]+$', '', 'g'), '') as out from l")
def dq_07_cap_words(spark: SparkSession, d: str) -> DataFrame:
    return _text_lines(spark, d).select("doc_id", "line", E.cap_words(F.col("x"), 4).alias("out"))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return E.extract(frame(spark, d, "notes"))


def _sql_field(f: str, patterns: list[str]) -> str:
    found = [f"nullif(regexp_extract(raw_text, '{_rx(p)}', 1), '')" for p in patterns]
    x = f"coalesce({', '.join(found)})"
    if f in E.NUMERIC:
        v = f"try_cast(replace({x}, ',', '') as double)"
        return f"case when {v} between {E.RANGES[f][0]} and {E.RANGES[f][1]} then {v} end" if f in E.RANGES else v
    if f in E.LONGEST:
        x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    return f"case when length(regexp_replace({x}, '[^0-9]', '', 'g')) <= 0.4 * length({x}) then {x} end" if f == "supplier" else x


@query("select note_id, " + ", ".join(f"{_sql_field(f, p)} as {f}" for f, p in E.FIELDS.items()) + " from notes")
def ex_02_fields(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("note_id", *E.FIELDS)


@query("select note_id, " + ", ".join(f"{_sql_field(f, p)} as {f}" for f, p in E.LEGACY.items() if f != "density") + f", case when {_sql_field('density', E.LEGACY['density'])} is not null then {_sql_field('density', E.LEGACY['density'])} end as density from notes")
def ex_06_legacy_fields(spark: SparkSession, d: str) -> DataFrame:
    return E.extract(frame(spark, d, "notes"), E.LEGACY).select("note_id", *E.LEGACY)


@query(f"select note_id, field, value from (unpivot (select note_id, {', '.join(f'cast({_sql_field(f, E.FIELDS[f])} as string) as {f}' for f in ('vessel_name', 'imo', 'barge_name', 'port'))} from notes) on vessel_name, imo, barge_name, port into name field value value)")
def ex_01_first_match(spark: SparkSession, d: str) -> DataFrame:
    fields = {f: E.FIELDS[f] for f in ("vessel_name", "imo", "barge_name", "port")}
    return E.extract(frame(spark, d, "notes"), fields).unpivot("note_id", list(fields), "field", "value").where("value is not null")


@query("select id as note_id, case when id % 2 = 1 or doc_type = 'HANDWRITTEN' then vessel_name end as vessel_name, barge_name, regexp_replace(port, ' +', ' ', 'g') as port from note_fields")
def ex_04_route(spark: SparkSession, d: str) -> DataFrame:
    """Labels misread: by three letters of eleven (found in handwritten notes only), and by two of ten."""
    text = F.when(F.col("note_id") % 2 == 0, F.replace("raw_text", F.lit("Vessel Name:"), F.lit("Vesl Nam:"))).otherwise(F.col("raw_text"))
    text = F.when(F.col("note_id") % 3 == 0, F.replace(text, F.lit("Barge Name:"), F.lit("Brge Nme:"))).otherwise(text)
    n = staged(frame(spark, d, "notes").withColumn("raw_text", text), "misread")
    return E.routed(n).select("note_id", "vessel_name", "barge_name", "port")


_VALUES = ["vessel_name", "imo", "barge_name", "barge_sb_number", "delivery_date", "start_time", "end_time", "port", "supplier", "cast(q + 0.5e0 as double) as quantity_mt", "fuel_type", *[f"cast({f} as double) as {f}" for f in E.NUMERIC[1:]], "seal_number_vessel", "seal_number_marpol", "seal_number_barge", "bdn_reference"]
_WORN = "case when note_id % 2 = 1 or doc_type = 'HANDWRITTEN' then {0} end as {0}"


@query(f"select note_id, {', '.join(_VALUES)} from note_values")
def ex_02_layouts(spark: SparkSession, d: str) -> DataFrame:
    """All fields of notes in four layouts, under labels that no pattern knows: beside a colon or bar, two lines below, and aligned."""
    return E.routed(frame(spark, d, "laid_notes")).select("note_id", *E.LABELS)


@query(f"select note_id, {', '.join(_WORN.format(v) if v in ('vessel_name', 'supplier') else v for v in _VALUES)} from note_values")
def ex_01_misread_labels(spark: SparkSession, d: str) -> DataFrame:
    """All fields under misread labels, some so far off that only the limit of handwritten notes lets them pass."""
    return E.routed(frame(spark, d, "misread_notes")).select("note_id", *E.LABELS)


@query("select o_orderkey, case when o_orderkey % 30 < 24 then '2024-01-02 ' || lpad(cast(o_orderkey % 30 as string), 2, '0') || ':15' end as at, case when o_orderkey % 4 <> 1 and o_orderkey % 4 <> 2 then case o_orderkey % 4 when 0 then 'Eastern Fuels' else 'Police Notes' end end as supplier from orders")
def dq_05_hours_and_licences(spark: SparkSession, d: str) -> DataFrame:
    """Times with an hour beyond 23 and suppliers that are a licence are no values."""
    x = frame(spark, d, "orders").selectExpr("o_orderkey", "'2024-01-02 ' || lpad(cast(o_orderkey % 30 as string), 2, '0') || ':15' as at", "case o_orderkey % 4 when 0 then 'Eastern Fuels' when 1 then 'Licence No 2252' when 2 then 'LIC  NO: X' else 'Police Notes' end as supplier")
    return x.select("o_orderkey", E.plausible_text(F.col("at"), "start_time").alias("at"), E.plausible_text(F.col("supplier"), "supplier").alias("supplier"))


@query("""select o_orderkey, case o_orderkey % 6 when 0 then 'OP BRAZIL ' || cast(o_orderkey as string) when 1 then 'STAR' when 2 then null when 3 then null when 4 then 'ONE TWO THREE FOUR' else null end as out from orders""")
def dq_07_values(spark: SparkSession, d: str) -> DataFrame:
    """Values end at a stop phrase, have at most four words, and are no heading."""
    x = frame(spark, d, "orders").selectExpr("o_orderkey", "case o_orderkey % 6 when 0 then 'OP BRAZIL ' || cast(o_orderkey as string) || ' Next  Port: X' when 1 then 'STAR;;noise' when 2 then 'Reference' when 3 then 'metering 12' when 4 then ' ONE TWO THREE FOUR FIVE 12:30 later' else ' n/a ' end as x")
    return x.select("o_orderkey", E.cap_value(F.col("x"), 4).alias("out"))


@query(f"select note_id, {sql_round('0.7e0 * (7 + case when contains(raw_text, ' + chr(39) + 'Barge Name' + chr(39) + ') then 1 else 0 end) / 9 + 0.3e0 * ocr_confidence', 3)} as confidence from notes")
def ex_05_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("note_id", E.extraction_confidence().alias("confidence"))


@query("select id as note_id, from_s as start_s, to_s + case when to_s < from_s then 86400 else 0 end as end_s, case id % 5 when 2 then 'US_DATE' when 3 then 'HRS_AT' when 4 then 'DATE_AT_HRS' else 'ISO' end as method, to_s < from_s as crossed from note_fields")
def dt_01_pumping_times(spark: SparkSession, d: str) -> DataFrame:
    t = X.parse_pumping_times(F.col("start_time"), F.col("end_time"), F.lit(None).cast("string"))
    return _extracted(spark, d).select("note_id", t.alias("t")).select("note_id", "t.*")


@query("select id as note_id, case when to_s < from_s then to_s + 86400 end as moved_end_s from note_fields")
def dt_02_midnight(spark: SparkSession, d: str) -> DataFrame:
    t = X.parse_pumping_times(F.col("start_time"), F.col("end_time"), F.lit(None).cast("string"))
    return _extracted(spark, d).select("note_id", t.alias("t")).select("note_id", F.when(F.col("t.crossed"), F.col("t.end_s")).alias("moved_end_s"))


@query("select id as note_id, case id % 5 when 0 then 'Singapore' when 1 then 'Rotterdam' when 2 then 'Houston' when 3 then 'Fujairah' else 'Nowhere' end as port, least(a, b) as start_utc, greatest(a, b) as end_utc from (select id, from_s - o as a, to_s - o as b from (select *, case id % 5 when 0 then 8 when 1 then 1 when 2 then -6 when 3 then 4 else 0 end * 3600 as o from note_fields) x) y")
def dt_09_window_utc(spark: SparkSession, d: str) -> DataFrame:
    ports = frame(spark, d, "ports")
    port = F.expr("case id % 5 when 0 then 'Singapore' when 1 then 'Rotterdam' when 2 then 'Houston' when 3 then 'Fujairah' else 'Nowhere' end")
    x = frame(spark, d, "note_fields").select("id", "from_s", "to_s", port.alias("port")).join(F.broadcast(ports), "port", "left")
    a, b = (X.to_utc(F.col(c), F.col("timezone"), F.col("utc_offset")) for c in ("from_s", "to_s"))
    return x.select(F.col("id").alias("note_id"), "port", F.least(a, b).alias("start_utc"), F.greatest(a, b).alias("end_utc"))


@query("select id as note_id, from_s - coalesce(utc_offset, 8) * 3600 as start_utc from (select id, from_s, case id % 5 when 0 then 'Singapore' when 1 then 'Rotterdam' when 2 then 'Houston' when 3 then 'Fujairah' else 'Nowhere' end as port from note_fields) x left join ports using (port)")
def dt_10_fixed_offset(spark: SparkSession, d: str) -> DataFrame:
    port = F.expr("case id % 5 when 0 then 'Singapore' when 1 then 'Rotterdam' when 2 then 'Houston' when 3 then 'Fujairah' else 'Nowhere' end")
    x = frame(spark, d, "note_fields").select("id", "from_s", port.alias("port")).join(F.broadcast(frame(spark, d, "ports")), "port", "left")
    return x.select(F.col("id").alias("note_id"), X.to_utc(F.col("from_s"), F.lit(None).cast("string"), F.coalesce("utc_offset", F.lit(8))).alias("start_utc"))


@query("select id as note_id, from_s as local_s from note_fields")
def dt_08_local_time(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("start_time")
    return _extracted(spark, d).select("note_id", F.coalesce(X.parse_iso(c), X.parse_slashed(c), X.parse_hrs_at(c), X.parse_date_at_hrs(c)).alias("local_s"))


@query("select note_id, case when doc_type = 'HANDWRITTEN' then regexp_extract(raw_text, 'Delivery Date: ([^\\n]*)', 1) || ' 18:50' else '1850' end as start_time from notes")
def dt_07_anchored(spark: SparkSession, d: str) -> DataFrame:
    return E.anchored_times(_extracted(spark, d).withColumn("start_time", F.lit("1850"))).select("note_id", "start_time")


@query("select id as note_id, " + TITLE.format("vessel_name") + " as vessel_name, imo, barge_name, case id % 4 when 0 then 'Singapore' when 1 then 'Rotterdam' when 2 then 'Port Of Hong Kong' else 'Fujairah' end as port, cast(q as double) as quantity_mt, case when id % 3 = 0 then 0.991e0 else 0.9512e0 end as density from note_fields")
def str_11_all_normalisers(spark: SparkSession, d: str) -> DataFrame:
    return E.normalized(_extracted(spark, d)).select("note_id", "vessel_name", "imo", "barge_name", "port", "quantity_mt", "density")


@query("select o_orderkey, field, v as value from (select o_orderkey, unnest(['density', 'sulphur_content', 'flashpoint', 'viscosity', 'water_content']) as field, unnest([(o_orderkey % 1300) + 0e0, (o_orderkey % 80) / 10e0, (o_orderkey % 250) + 0e0, (o_orderkey % 1000) + 0e0, (o_orderkey % 40) / 10e0]) as v from orders) x where (field = 'density' and v between 0.5 and 1100) or (field = 'sulphur_content' and v between 0 and 5) or (field = 'flashpoint' and v between 0 and 200) or (field = 'viscosity' and v between 0.1 and 800) or (field = 'water_content' and v between 0 and 2)")
def dq_04_plausible_numbers(spark: SparkSession, d: str) -> DataFrame:
    given = {"density": "(o_orderkey % 1300) + 0d", "sulphur_content": "(o_orderkey % 80) / 10d", "flashpoint": "(o_orderkey % 250) + 0d", "viscosity": "(o_orderkey % 1000) + 0d", "water_content": "(o_orderkey % 40) / 10d"}
    return frame(spark, d, "orders").select("o_orderkey", *[E.plausible(F.expr(e), f).alias(f) for f, e in given.items()]).unpivot("o_orderkey", list(given), "field", "value").where("value is not null")


@query("select p_partkey, case when length(regexp_replace(x, '[^A-Za-z]', '', 'g')) / cast(length(x) as double) >= 0.5 and length(x) >= 2 then x end as vessel, case when length(regexp_replace(x, '[^0-9]', '', 'g')) / cast(length(x) as double) <= 0.4 then x end as port from (select p_partkey, substr(p_name, 1, cast(1 + p_partkey % 6 as int)) || cast(p_partkey as string) as x from part) t")
def dq_05_plausible_text(spark: SparkSession, d: str) -> DataFrame:
    x = frame(spark, d, "part").selectExpr("p_partkey", "substr(p_name, 1, cast(1 + p_partkey % 6 as int)) || cast(p_partkey as string) as x")
    return x.select("p_partkey", E.plausible_text(F.col("x"), "vessel_name").alias("vessel"), E.plausible_text(F.col("x"), "port").alias("port"))


_COS = "list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))"


@query(f"select a.vec_id as a, b.vec_id as b, {sql_round(f'greatest(0e0, least(1e0, {_COS}))', 5)} as similarity, {_COS} >= 0.72 as accepted from embeddings a join (select * from (select *, row_number() over (partition by label order by vec_id) as r from embeddings) x where r = 1) b on a.label = b.label")
def jn_19_embedding_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The vector of each name against the one registered under its key (the first of its label), not all pairs of a key."""
    v = frame(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "vec_id").alias("r")).select("label", "r.*")
    s = cosine(F.col("embedding"), F.col("y"))
    return v.join(first, "label").select(F.col("vec_id").alias("a"), "b", rounded(s, 5).alias("similarity"), (s >= DEFAULT.embedding_threshold).alias("accepted"))


@query("select vec_id, " + sql_round("greatest(0e0, least(1e0, list_cosine_similarity(cast(embedding as double[]), list_reverse(cast(embedding as double[])))))", 5) + " as similarity from embeddings")
def mth_03_cosine(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "embeddings").select("vec_id", rounded(cosine(F.col("embedding"), F.reverse("embedding")), 5).alias("similarity"))


@query("select o_orderkey, " + sql_round("o_totalprice / 7", 2) + " as two, " + sql_round("o_totalprice / 7000", 4) + " as four, greatest(0e0, least(1e0, o_totalprice / 100000)) as held from orders")
def mth_04_rounding(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_totalprice")
    return frame(spark, d, "orders").select("o_orderkey", rounded(c / 7, 2).alias("two"), rounded(c / 7000, 4).alias("four"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / 100000)).alias("held"))


@query(f"""select id as note_id, field, value, score from (select id, 'vessel_name' as field, vessel_name as value, case when id % 2 = 0 then {sql_round('100 * (1 - 1 / 11e0)', 3)} else 100e0 end as score from note_fields union all select id, 'port', port, 100e0 from note_fields union all select id, 'supplier', supplier, 100e0 from note_fields) x""")
def wn_08_fuzzy_labels(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "notes").withColumn("raw_text", F.when(F.col("note_id") % 2 == 0, F.replace("raw_text", F.lit("Vessel Name"), F.lit("Vesel Name"))).otherwise(F.replace("raw_text", F.lit("Port: "), F.lit("Port:\n\n"))))
    return E.find_fuzzy(n, {"vessel_name": ["vessel name", "name of vessel"], "port": ["port", "port of delivery"], "supplier": ["supplier", "supplied by"]}).select("note_id", "field", "value", "score")


@query("select id as note_id, vessel_name, port, supplier from note_fields")
def ex_03_aligned_labels(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "notes").withColumn("raw_text", F.replace("raw_text", F.lit(": "), F.lit("    ")))
    return E.aligned(n, {"vessel_name": "vessel name", "port": "port", "supplier": "supplier"})
