"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "lat double, latitude double, lon double, longitude double, speed double, sog double, course double, cog double, heading double, destination string, last_position_epoch bigint, last_position_UTC string, timestamp string, time string, time_utc string"
HISTORY = f"uuid string, name string, mmsi string, imo string, eni string, country_iso string, type string, type_specific string, positions array<struct<{', '.join(f.replace(' ', ':', 1) for f in POSITION.split(', '))}>>"
VESSEL = "uuid string, name string, ship_name string, name_ais string, mmsi string, mmsi_number string, imo string, country_iso string, flag string, type string, type_specific string, lat double, lon double, speed double, course double, heading double"
RADIUS = "point struct<lat:double,lon:double,radius:double>, total int, vessels array<struct<name:string,mmsi:string,imo:string,type:string,type_specific:string,country_iso:string,lat:double,lon:double,distance:double>>"
BARGE = "name string, sb_number string, mmsi string, imo string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def normalize_positions(rows: DataFrame, drop_null_ts: bool = True, course: bool = True) -> DataFrame:
    """mmsi, ts (seconds), lat, lon, speed, heading from any of the known names; text times first, then the epoch."""
    text = F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(c, "Z$", ""))) for c in ("last_position_UTC", "timestamp", "time", "time_utc")])
    ts = F.coalesce(text, "last_position_epoch")
    heading: list[Column | str] = ["heading", "course", "cog"] if course else ["heading", "cog"]
    out = rows.select("mmsi", ts.alias("ts"), F.coalesce("lat", "latitude", F.lit(0.0)).alias("lat"), F.coalesce("lon", "longitude", F.lit(0.0)).alias("lon"), F.coalesce("speed", "sog").alias("speed"), F.coalesce(*heading).alias("heading"), *[c for c in ("file",) if c in rows.columns])
    return out.where("ts is not null") if drop_null_ts else out


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Position archives: one row per position."""
    return normalize_positions(_json(spark, path, HISTORY).select("mmsi", "file", F.explode("positions").alias("p")).select("mmsi", "file", "p.*"))


def longest_archive(rows: DataFrame) -> DataFrame:
    """Per ship the positions of the file with most of them; of equal ones the first by name."""
    best = rows.groupBy("mmsi", "file").agg(F.count(F.lit(1)).alias("n")).groupBy("mmsi").agg(F.min_by("file", F.struct((-F.col("n")).alias("a"), F.col("file").alias("b"))).alias("file"))
    return rows.join(best, ["mmsi", "file"])


def normalize_vessels(rows: DataFrame) -> DataFrame:
    some = lambda *cs: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in cs])
    return rows.select("imo", some("name", "ship_name").alias("name"), some("mmsi", "mmsi_number").alias("mmsi"), some("flag", "country_iso").alias("flag"), "type", "type_specific")


def read_vessels(spark: SparkSession, path: str) -> DataFrame:
    """Registry files: an object or a list of them."""
    return normalize_vessels(_json(spark, path, VESSEL))


def read_radius(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, RADIUS).select("point", F.explode("vessels").alias("v")).select("point", "v.*")


def read_barges(spark: SparkSession, path: str | None) -> DataFrame:
    """The barge registry; without a path, no rows."""
    return spark.createDataFrame([], BARGE) if path is None else _json(spark, path, BARGE).drop("file")


def read_notes(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("txt", "text")) -> DataFrame:
    """A folder of note texts: file name and whole text of the accepted kinds."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("note_id"), F.col("value").alias("raw_text"))
    return rows.where(F.lower(F.substring_index("note_id", ".", -1)).isin(*kinds))
