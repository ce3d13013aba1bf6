"""Queries of the forest, the streams and the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import anomaly as A
from ..operators import extract as E
from ..operators import resolve as R
from ..operators import rules as U
from ..operators import tracks as T
from ..sources import merging, store
from ..sources import readers as S
from ..sources.adapters import frame
from ..streaming import jobs as J
from .base import query
from .resolving import _IDENT, NOTES
from .ruling import _CRED, SEEN, judged_notes, read_notes, received_notes, references, track_model, verdict_columns


def _features(spark: SparkSession, d: str) -> DataFrame:
    return store.staged(T.build_features(frame(spark, d, "deliveries"), frame(spark, d, "positions")).select("id", *T.FEATURES), "features")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return store.staged(A.raw_scores(f, "id", T.FEATURES, A.fit_forest(f, "id", T.FEATURES)), "raw-scores")


@query()
def ml_01_forest(spark: SparkSession, d: str) -> DataFrame:
    f = A.fit_forest(_features(spark, d), "id", T.FEATURES)
    return f.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("size").alias("sample"), F.max("depth").alias("depth"))


@query()
def ml_02_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.anomaly_scores(_raw(spark, d)).select("id", "anomaly_score", "is_anomaly")


@query()
def ml_03_plain_scores(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("id", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw"))), 3).alias("score"))


@query()
def ag_14_score_range(spark: SparkSession, d: str) -> DataFrame:
    s = A.anomaly_scores(_raw(spark, d))
    return s.agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count_if("is_anomaly").alias("flagged"), F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Positions, in whole seconds as the table has them, as a stream over files of the events table, and a new folder for its output."""
    folder = f"{store.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    raw = frame(spark, d, "events")
    rows = spark.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    made = rows.select((200000000 + F.col("user_id")).cast("string").alias("mmsi"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("recorded_at"), (F.col("value") / 100).alias("speed"))
    return made, folder


def _seconds(c: str):
    return F.unix_timestamp(c)


@query("select mmsi, ts as at from positions group by mmsi, ts")
def sm_01_distinct_positions(spark: SparkSession, d: str) -> DataFrame:
    s, folder = _stream(spark, d)
    out = J.run_available(J.distinct_positions(s), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("mmsi", _seconds("recorded_at").alias("at"))


@query("""select mmsi, window_s, count(*) as n, floor(avg(speed) * 10000 + 0.500001e0) / 10000 as mean_speed from (select *, cast(floor(ts / 600) * 600 as bigint) as window_s from positions) x
  where window_s + 600 <= (select max(ts) - 3600 from positions) group by mmsi, window_s""")
def sm_02_interval_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows, as append mode gives them: those that end before the watermark."""
    s, folder = _stream(spark, d)
    out = J.run_available(J.interval_statistics(s), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("mmsi", _seconds("window_start").alias("window_s"), "n", rounded(F.col("mean_speed"), 4).alias("mean_speed"))


@query("""with g as (select mmsi, ts, sum(case when ts - prev < 3600 then 0 else 1 end) over (partition by mmsi order by ts, seq) as s from (select *, lag(ts) over (partition by mmsi order by ts, seq) as prev from positions) x)
  select mmsi, min(ts) as first_s, max(ts) as last_s, count(*) as n from g group by mmsi, s having max(ts) + 3600 <= (select max(ts) - 3600 from positions)""")
def sm_03_sessions(spark: SparkSession, d: str) -> DataFrame:
    s, folder = _stream(spark, d)
    out = J.run_available(J.sessions(s), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("mmsi", _seconds("first_at").alias("first_s"), _seconds("last_at").alias("last_s"), "n")


def _sm_04() -> str:
    """Credibility and identity of every note, from the batch queries' texts."""
    notes = "n as (select id as note_id, vessel_name, imo, barge_name, sb_number as sb, port from note_fields)"
    return f"with {_CRED}, {_IDENT.replace(NOTES, notes)} select cred.note_id, score, method from cred join ident on ident.note_id = cred.note_id"


@query(_sm_04())
def sm_04_judge_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes as a stream of files, each micro-batch judged against the static registry and written by the sink."""
    folder = f"{store.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    notes = frame(spark, d, "notes")
    notes.write.parquet(f"{folder}/in")
    registry = store.staged(frame(spark, d, "vessel_registry"), "registry")

    def judge(batch: DataFrame) -> DataFrame:
        x = U.credibility(E.extract(batch).withColumn("extraction_confidence", E.extraction_confidence()))
        who = R.vessel_identity(x.select("note_id", "vessel_name", "imo"), registry).select("note_id", "method")
        return x.select("note_id", F.col("credibility_score").alias("score")).join(who, "note_id")

    J.judge_notes(spark.readStream.schema(notes.schema).parquet(f"{folder}/in"), judge, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("note_id long, score double, method string").parquet(f"{folder}/out").select("note_id", "score", "method")


@query()
def sm_04_verdict_stream(spark: SparkSession, d: str) -> DataFrame:
    """The flagship as a stream: notes arrive in three parts by time, the stream is started anew for each, and its sink is read back."""
    folder = f"{store.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    notes = store.staged(received_notes(spark, d), "received")
    refs, model = references(spark, d), track_model(spark, d, f"{folder}/model")
    ends = notes.agg(F.min("received_s").alias("first"), F.max("received_s").alias("last")).first()
    third = F.floor((F.col("received_s") - F.lit(ends.first)) * 3 / F.lit((ends.last or 0) - (ends.first or 0) + 1))
    for part in range(3):
        notes.where(third == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(notes.schema).parquet(f"{folder}/in")
        judge = lambda fields, seen: verdict_columns(judged_notes(refs, fields, model, seen), "received_s")
        J.verdict_stream(stream, read_notes, judge, SEEN, f"{folder}/verdicts", f"{folder}/seen", f"{folder}/checkpoint").awaitTermination()
    return merging.read_table(spark, f"{folder}/verdicts").drop("received_s")


DOCUMENT_ROWS = 5000  # rows that a written document holds


def _archived(spark: SparkSession, p: DataFrame) -> str:
    """Positions written as archive files (lists of JSON documents, each of a ship and day and of DOCUMENT_ROWS positions at most), for the readers."""
    item = F.struct("lat", "lon", "speed", "heading", F.col("ts").alias("last_position_epoch"))
    day = F.floor(F.col("ts") / 86400).alias("day")
    rows = p.select("mmsi", day, item.alias("item"))
    at = F.row_number().over(Window.partitionBy("mmsi", "day").orderBy("item"))
    chunk = F.floor((at - 1) / DOCUMENT_ROWS).alias("chunk")
    documents = rows.select("mmsi", "day", "item", chunk).groupBy("mmsi", "day", "chunk").agg(F.collect_list("item").alias("positions")).select("mmsi", "positions")
    return _as_documents(spark, store.staged(documents, "archives"), "archives", 200)


@query("select mmsi, count(*) as n, min(ts) as first_ts from positions group by mmsi")
def src_01_archives(spark: SparkSession, d: str) -> DataFrame:
    return S.read_history(spark, _archived(spark, frame(spark, d, "positions"))).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("select mmsi, ts, count(*) as n from positions where ts is not null group by mmsi, ts")
def prj_01_normalized_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.read_history(spark, _archived(spark, frame(spark, d, "positions"))).groupBy("mmsi", "ts").agg(F.count(F.lit(1)).alias("n"))


@query("select md5(text) as digest, length(text) as n, count(*) as files from benchmark group by all")
def src_08_note_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as files, one each in one folder, and read by kind."""
    path = f"{store.shared_folder(spark)}/notes/{uuid.uuid4().hex}"
    frame(spark, d, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(path)
    text = F.regexp_replace("raw_text", "\n$", "")
    return S.read_notes(spark, path).select(F.md5(text).alias("digest"), F.length(text).alias("n")).groupBy("digest", "n").agg(F.count(F.lit(1)).alias("files"))


@query("select mmsi, case when seq % 3 = 0 then null else ts end as ts, count(*) as n from positions group by 1, 2")
def prj_02_keep_untimed(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "positions")
    empty = [F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in S.POSITION.split(", ") if f.split(" ")[0] not in ("lat", "lon", "speed", "heading", "last_position_epoch")]
    raw = p.select("mmsi", "lat", "lon", "speed", "heading", F.when(F.col("seq") % 3 != 0, F.col("ts")).alias("last_position_epoch"), *empty)
    return S.normalize_positions(raw, drop_null_ts=False, course=False).groupBy("mmsi", "ts").agg(F.count(F.lit(1)).alias("n"))


@query("select imo, name, mmsi, flag from vessel_registry")
def prj_03_normalized_vessels(spark: SparkSession, d: str) -> DataFrame:
    v = frame(spark, d, "vessel_registry").select("imo", F.lit("").alias("name"), F.col("name").alias("ship_name"), F.lit(None).cast("string").alias("mmsi"), F.col("mmsi").alias("mmsi_number"), F.lit(" ").alias("flag"), F.col("flag").alias("country_iso"), F.lit(None).cast("string").alias("type"), "type_specific")
    return S.normalize_vessels(v).select("imo", "name", "mmsi", "flag")


@query("with f as (select mmsi, seq % 3 as file, count(*) as n from positions group by 1, 2) select mmsi, arg_min(file, -n * 10 + file) as file from f group by mmsi")
def wn_05_longest_archive(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "positions").withColumn("file", F.col("seq") % 3)
    return S.longest_archive(p).select("mmsi", "file").distinct()


@query("select cast(floor(ts / 86400) as bigint) as day, count(*) as n from positions group by 1")
def snk_04_position_archive(spark: SparkSession, d: str) -> DataFrame:
    path = f"{store.shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    store.archive_positions(frame(spark, d, "positions"), path)
    return spark.read.parquet(path).groupBy(F.datediff("position_date", F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _buckets(rows: DataFrame, each: int) -> int:
    """How many buckets leave about `each` rows to a bucket, 16 at least."""
    return max(16, -(-rows.count() // each))


def _as_documents(spark: SparkSession, rows: DataFrame, name: str, each: int = DOCUMENT_ROWS) -> str:
    """Rows as JSON documents, each a list of about `each` rows, or fewer."""
    path = f"{store.shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*rows.columns), F.lit(_buckets(rows, each))).alias("bucket")
    rows.groupBy(bucket).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.partitionBy("bucket").text(path)
    return path


@query("select imo, name, mmsi, flag from vessel_registry")
def src_02_vessel_files(spark: SparkSession, d: str) -> DataFrame:
    path = _as_documents(spark, frame(spark, d, "vessel_registry"), "vessels")
    return S.read_vessels(spark, path).select("imo", "name", "mmsi", "flag")


@query("select sb_number, name, mmsi, imo from barge_registry")
def src_05_barge_files(spark: SparkSession, d: str) -> DataFrame:
    path = _as_documents(spark, frame(spark, d, "barge_registry").select("name", "sb_number", "mmsi", "imo"), "barges")
    return S.read_barges(spark, path).select("sb_number", "name", "mmsi", "imo")


@query("select mmsi, name, cast(cast(imo as bigint) % 40 as double) as distance from vessel_registry")
def src_04_radius_files(spark: SparkSession, d: str) -> DataFrame:
    v = frame(spark, d, "vessel_registry").select(F.struct(F.lit(1.264).alias("lat"), F.lit(103.84).alias("lon"), F.lit(50.0).alias("radius")).alias("point"), "imo", F.struct("name", "mmsi", "imo", (F.col("imo").cast("long") % 40).cast("double").alias("distance")).alias("v"))
    one = v.groupBy("point", F.pmod(F.xxhash64("imo"), F.lit(_buckets(v, DOCUMENT_ROWS))).alias("b")).agg(F.collect_list("v").alias("vessels"), F.count(F.lit(1)).alias("total"))
    path = _as_documents(spark, one, "radius", 1)
    return S.read_radius(spark, path).select("mmsi", "name", "distance")
