"""Domain tables derived from the star-schema tables, as SQL that both Spark and the oracle run.

Each text names its inputs in braces. `frame` gives a table as a DataFrame; `ctes` gives the WITH clause for an oracle query.
Times are whole seconds since 1970, so that no session time zone matters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EPOCH0 = 1704067200  # 2024-01-01


def _two(x: str, n: int = 2) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


def _time_text(at: str) -> str:
    """The five formats of clock times, by id % 5; all times lie in January 2024."""
    off = f"({at} - {EPOCH0})"
    day = _two(f"cast(floor({off} / 86400) as bigint) + 1")
    hour = _two(f"cast(floor({off} % 86400 / 3600) as bigint)")
    minute = _two(f"cast(floor({off} % 3600 / 60) as bigint)")
    return (
        f"case id % 5 when 0 then '2024-01-' || {day} || ' ' || {hour} || ':' || {minute} || ':00' "
        f"when 1 then {day} || '-Jan-2024 ' || {hour} || ':' || {minute} || ':00' "
        f"when 2 then {day} || '/01/2024 ' || {hour} || ':' || {minute} "
        f"when 3 then {hour} || ':' || {minute} || ' hrs. @ ' || {day} || '/01/2024' "
        f"else {day} || '-01-2024 @ ' || {hour} || {minute} || ' HRS' end"
    )


def _laid(labels: dict[str, str], separator: str) -> str:
    """A note's text: each label, the separator and the value of `note_values`; fields without a value are left out."""
    return " || ".join(f"coalesce({label} || {separator} || {field} || chr(10), '')" for field, label in labels.items())


#: How the labels of laid-out notes read: other words than those of `notes`.
_OTHER_WORDS = {"vessel_name": "'Receiving Vessel'", "imo": "'Vessel IMO Number'", "barge_name": "'Bunker Craft'", "barge_sb_number": "'Craft No'", "delivery_date": "'Bunkering Date'", "start_time": "'Hose On'", "end_time": "'Hose Off'", "port": "'Anchorage'", "supplier": "'Seller'", "quantity_text": "'Metric Tons Delivered'", "fuel_type": "'Product Grade'", "density": "'Specific Gravity'", "sulphur_content": "'Sulfur'", "flashpoint": "'Flash Pt'", "viscosity": "'Kinematic Viscosity'", "water_content": "'Water % V/V'", "seal_number_vessel": "'Ship Seal'", "seal_number_marpol": "'Marpol'", "seal_number_barge": "'Seal Barge'", "bdn_reference": "'BDN Ref'"}
#: Labels as a scan misreads them: by a letter or two, and those of vessel and supplier by more in notes with even numbers.
_MISREAD = {"vessel_name": "case when note_id % 2 = 0 then 'Vesl Nam' else 'Vesse1 Nane' end", "imo": "'IM0 Nunber'", "barge_name": "'Barqe Nane'", "barge_sb_number": "'S8 Number'", "delivery_date": "'Delivery Dale'", "start_time": "'Commenccd Pumpinq'", "end_time": "'Complcted Pumpinq'", "port": "'Port of Delivcry'", "supplier": "case when note_id % 2 = 0 then 'Spplir' else 'Suppller' end", "quantity_text": "'Quantity Delivcred'", "fuel_type": "'Fuel Typc'", "density": "'Densily'", "sulphur_content": "'Sulphur Contcnt'", "flashpoint": "'Flashpolnt'", "viscosity": "'Viscosily'", "water_content": "'Water Contenl'", "seal_number_vessel": "'Vessel Seai'", "seal_number_marpol": "'Marpol Seai'", "seal_number_barge": "'Barqe Seal'", "bdn_reference": "'BDN Nunber'"}


TABLES: dict[str, str] = {
    "users": "select max(user_id) + 1 as u from {events}",
    "positions": """select cast(200000000 + user_id as string) as mmsi, EPOCH(ts) as ts, event_id as seq,
        1.264e0 + (user_id % 5) * 2e-4 + ((event_id * 7919) % 1001 - 500) * 2e-6 + case when user_id % 11 = 0 then 0.9e0 else 0e0 end as lat,
        103.84e0 + ((event_id * 6151) % 1001 - 500) * 2e-6 as lon, value / 100 as speed,
        cast(case when event_id % 97 = 0 then 511 else (event_id * 37) % 360 end as double) as heading from {events}""",
    "deliveries": f"""select o_orderkey as id, o_custkey as custkey, cast(200000000 + o_custkey % (select u from {{users}}) as string) as vessel_mmsi,
        cast(200000000 + (o_custkey * 7 + 3) % (select u from {{users}}) as string) as barge_mmsi, {EPOCH0} + (o_orderkey * 5 % 648) * 3600 as start_s,
        {EPOCH0} + (o_orderkey * 5 % 648) * 3600 + (12 + o_orderkey % 60) * 3600 as end_s, 60 * q as quantity_mt
        from {{orders}} join (select l_orderkey, sum(l_quantity) as q from {{lineitem}} group by l_orderkey) t on l_orderkey = o_orderkey""",
    "ports": """select * from (values (1, 'Singapore', 'Asia/Singapore', 8, 1.264e0, 103.84e0), (2, 'Rotterdam', 'Europe/Amsterdam', 1, 51.922e0, 4.479e0),
        (3, 'Fujairah', 'Asia/Dubai', 4, 25.128e0, 56.326e0), (4, 'Houston', 'America/Chicago', -6, 29.735e0, -95.265e0),
        (5, 'Hong Kong', 'Asia/Hong_Kong', 8, 22.302e0, 114.177e0)) as p(ord, port, timezone, utc_offset, lat, lon)""",
    "part_names": "select p_partkey as k, upper(p_name) as n from {part}",
    "vessel_registry": """select cast(1000000 + c_custkey as string) as imo, n || ' ' || cast(c_custkey % 100 as string) as name, cast(200000000 + c_custkey % (select u from {users}) as string) as mmsi,
        case when c_mktsegment in ('MACHINERY', 'AUTOMOBILE') then 'Bunkering Tanker' else c_mktsegment end as type_specific, cast(c_nationkey as string) as flag
        from (select *, 1 + c_custkey % (select count(*) from {part}) as pk from {customer}) c join {part_names} on k = pk""",
    "barge_registry": """select 'SB' || lpad(cast(s_suppkey as string), 4, '0') || chr(cast(65 + s_suppkey % 26 as int)) as sb_number, n || ' ' || cast(s_suppkey % 50 as string) as name,
        case when s_suppkey % 9 = 0 then null else cast(200000000 + (s_suppkey * 7 + 3) % (select u from {users}) as string) end as mmsi, cast(9000000 + s_suppkey as string) as imo, s_suppkey as suppkey, s_name as supplier
        from (select *, 1 + (s_suppkey * 3) % (select count(*) from {part}) as pk from {supplier}) c join {part_names} on k = pk""",
    "suppliers": "select count(*) as s from {supplier}",
    "note_fields": f"""select id, v.name as registry_name, case when id % 7 = 0 then substr(v.name, 1, 1) || substr(v.name, 3) else v.name end as vessel_name,
        case when id % 19 = 0 then cast(cast(v.imo as bigint) + 1 as string) else v.imo end as imo, case when id % 13 = 0 then null else b.name end as barge_name, b.sb_number, b.supplier,
        case id % 4 when 0 then 'Singapore' when 1 then 'ROTTERDAM' when 2 then 'Port of Hong  Kong' else 'Fujairah' end as port,
        case when id % 23 = 0 then end_s else start_s end as from_s, case when id % 23 = 0 then start_s else end_s end as to_s, cast(quantity_mt as bigint) as q,
        case when id % 4 = 0 then 'HANDWRITTEN' else 'DIGITAL' end as doc_type, 0.6e0 + (id % 40) / 100e0 as ocr_confidence, cast((id * 13) % 500 as double) as font_variance, custkey, d.start_s, d.end_s, d.vessel_mmsi, d.barge_mmsi
        from (select *, 1 + (id * 7 + 3) % (select s from {{suppliers}}) as sk from {{deliveries}}) d join {{vessel_registry}} v on v.imo = cast(1000000 + custkey as string) join {{barge_registry}} b on b.suppkey = sk""",
    "name_vectors": """select name, embedding from (select *, (length(name) * 31 + ascii(substr(name, 3, 1))) % (select count(*) from {embeddings}) as vid from (select vessel_name as name from {note_fields} union select name from {vessel_registry}) n) x join {embeddings} e on vec_id = vid""",
    "notes": f"""select id as note_id, doc_type, ocr_confidence, font_variance, custkey, start_s, end_s, vessel_mmsi, barge_mmsi,
        'BUNKER DELIVERY NOTE' || chr(10) || 'BDN No: BDN-' || cast(id as string) || chr(10) || 'Vessel Name: ' || vessel_name || chr(10) || 'IMO No: ' || imo || chr(10)
        || case when barge_name is null then '' else 'Barge Name: ' || barge_name || chr(10) end || 'SB No: ' || sb_number || chr(10) || 'Port: ' || port || chr(10)
        || 'Delivery Date: ' || {_two(f"cast(floor((from_s - {EPOCH0}) / 86400) as bigint) + 1")} || '/01/2024' || chr(10)
        || 'Commenced Pumping: ' || {_time_text('from_s')} || chr(10) || 'Completed Pumping: ' || {_time_text('to_s')} || chr(10)
        || 'Supplier: ' || supplier || chr(10) || 'Quantity: ' || case when q >= 1000 then cast(cast(floor(q / 1000) as bigint) as string) || ',' || {_two('q % 1000', 3)} else cast(q as string) end || '.00 MT' || chr(10)
        || 'Fuel Type: ' || case when id % 2 = 0 then 'VLSFO' else 'MGO' end || chr(10) || 'Density: ' || case when id % 3 = 0 then '991.0' else '0.9512' end || chr(10) || 'Sulphur: 0.' || cast(id % 7 as string) || chr(10)
        || 'Flashpoint: ' || cast(50 + id % 40 as string) || chr(10) || 'Viscosity: ' || cast(300 + id % 500 as string) || '.5' || chr(10) || 'Water Content: 0.' || cast(id % 9 as string) || chr(10)
        || case when id % 3 = 0 then '' else 'Vessel Seal: V' || cast(id as string) || chr(10) end || case when id % 17 = 0 then 'Remarks: quantity AMENDED by hand' else 'Remarks: none' end as raw_text
        from {{note_fields}}""",
    "note_values": f"""select id as note_id, doc_type, ocr_confidence, font_variance, vessel_name, imo, barge_name, sb_number as barge_sb_number, {_two(f"cast(floor((start_s - {EPOCH0}) / 86400) as bigint) + 1")} || '/01/2024' as delivery_date,
        '2024-01-15 ' || {_two('id % 24')} || ':' || {_two('id % 60')} as start_time, '2024-01-16 ' || {_two('(id + 5) % 24')} || ':' || {_two('id % 60')} as end_time,
        case cast(floor(id / 4) as bigint) % 4 when 0 then 'Singapore' when 1 then 'ROTTERDAM' when 2 then 'Hong Kong' else 'Fujairah' end as port, 'Eastern ' || supplier as supplier,
        case when q >= 1000 then cast(cast(floor(q / 1000) as bigint) as string) || ',' || {_two('q % 1000', 3)} else cast(q as string) end || '.50 MT' as quantity_text, q, case when id % 2 = 0 then 'VLSFO' else 'MGO' end as fuel_type,
        '0.9' || cast(500 + id % 400 as string) as density, '0.' || cast(1 + id % 8 as string) as sulphur_content, cast(50 + id % 40 as string) as flashpoint, cast(300 + id % 400 as string) || '.5' as viscosity, '0.' || cast(1 + id % 8 as string) as water_content,
        'V' || cast(id as string) as seal_number_vessel, 'M' || cast(id as string) as seal_number_marpol, 'B' || cast(id as string) as seal_number_barge, 'BDN-' || cast(id as string) as bdn_reference from {{note_fields}}""",
    "laid_notes": f"""select note_id, doc_type, ocr_confidence, font_variance, 'BUNKER DELIVERY NOTE' || chr(10) || {_laid(_OTHER_WORDS, "case note_id % 4 when 0 then ': ' when 1 then ':' || chr(10) || chr(10) when 2 then '    ' else ' | ' end")} || 'Remarks: none' as raw_text from {{note_values}}""",
    "misread_notes": f"""select note_id, doc_type, ocr_confidence, font_variance, 'BUNKER DELIVERY NOTE' || chr(10) || {_laid(_MISREAD, "': '")} || 'Remarks: none' as raw_text from {{note_values}}""",
    "ocr_words": """select doc_id as note_id, pos, cast(1 + floor(pos / 600) as bigint) as page, cast(floor(pos % 600 / 200) as bigint) as block_num, cast(floor(pos % 200 / 50) as bigint) as par_num,
        cast(floor(pos % 50 / 10) as bigint) as line_num, pos % 10 as word_num, word as text, (doc_id * 31 + pos * 17) % 101 - 1 as conf, 40 + (pos % 10) * 90 as left_px, 30 + cast(floor(pos / 10) as bigint) * 14 as top_px,
        8 * length(word) as width_px, 12 as height_px from (WORDS(doc_id, text, {documents})) t""",
    "verdicts": """select o_orderkey as id, o_custkey as custkey, EPOCH(o_orderdate) as validated_s, case when o_orderstatus = 'F' then 'VALID' when o_orderpriority = '1-URGENT' then 'HIGH_RISK'
        when o_orderpriority = '2-HIGH' then 'REVIEW_REQUIRED' when o_orderpriority = '5-LOW' then 'REJECTED' else 'SUSPICIOUS' end as classification, o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW') as human_review_required,
        cast(1000000 + o_custkey as string) as confirmed_imo, case when o_orderkey % 4 = 0 then null else cast(1000000 + (o_orderkey * 11) % 97 as string) end as extracted_imo, cast(200000000 + (o_custkey * 7 + 3) % 500 as string) as barge_mmsi,
        o_totalprice as quantity, cast(o_orderkey % 1000 as double) / 1000 as confidence from {orders}""",
    "barge_history": """select v.id, b.name, b.mmsi, v.validated_s from (select *, 4 * (1 + id % greatest(1, cast(floor((select s from {suppliers}) / 4) as bigint))) as sk from {verdicts}) v join {barge_registry} b on b.suppkey = sk where b.mmsi is not null""",
    "ships": """select mmsi, lat, lon, 'FEEDER ' || substr(mmsi, 6) as name from (select *, row_number() over (partition by mmsi order by ts desc, seq desc) as r from {positions}) x where r = 1""",
    "edits": "select user_id as id, event_type as field, cast(cast(floor(value) as bigint) as string) as new_value, EPOCH(ts) as edited_s, event_id as seq from {events}",
    "alerts": """select l_orderkey as id, l_linenumber as n, case l_linenumber % 8 when 0 then 'VESSEL_NOT_FOUND' when 1 then 'BARGE_MISSING' when 2 then 'BARGE_NAME_MISMATCH' when 3 then 'MISSING_SEAL_NUMBERS'
        when 4 then 'AIS_UNAVAILABLE' when 5 then 'QUANTITY_INFEASIBLE' when 6 then 'DUPLICATE_BDN' else 'SOMETHING_ELSE' end as alert_type from {lineitem} where l_linenumber % 2 = l_orderkey % 2 or l_linenumber > 5""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _inputs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def _for_spark(text: str) -> str:
    text = re.sub(r"EPOCH\((\w+)\)", r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(\1 as timestamp_ntz))", text)
    return re.sub(r"WORDS\((\w+), (\w+), (\{\w+\})\)", r"select \1, cast(pos as bigint) as pos, word from \3 lateral view posexplode(split(\2, ' ')) w as pos, word", text)


def _for_duckdb(text: str) -> str:
    text = re.sub(r"EPOCH\((\w+)\)", r"date_diff('second', timestamp '1970-01-01', \1)", text)
    text = re.sub(r"WORDS\((\w+), (\w+), (\{\w+\})\)", r"select \1, unnest(range(len(string_split(\2, ' ')))) as pos, unnest(string_split(\2, ' ')) as word from \3", text)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TABLES[name]
    return spark.sql(_for_spark(text), **{x: frame(spark, sf_dir, x) for x in dict.fromkeys(_inputs(text))})


def ctes(body: str) -> str:
    """The oracle query with a WITH clause for every derived table that it names, in the order of need."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in TABLES and name not in needed:
            for x in _inputs(TABLES[name]):
                need(x)
            needed.append(name)

    for name in TABLES:
        if re.search(rf"\b(?:from|join)\s+{name}\b", body):
            need(name)
    head = ", ".join(f"{n} as ({_for_duckdb(TABLES[n])})" for n in needed)
    body = body.strip()
    if not head:
        return body
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
