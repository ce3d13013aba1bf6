"""Data-quality constraints: per row the names of those it breaks; clean rows and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import staged


#: Rows of one key that one task joins; keys with more are dealt, the largest of them if there are very many.
KEY_ROWS, HOT_KEYS = 4_000, 50_000


def repeated(rows: DataFrame, keys: list[str], name: str, most: int = KEY_ROWS) -> DataFrame:
    """rows with a boolean `name`: another row has the same keys. A key with a null equals no other.

    Keys are counted before anything moves; only keys that repeat come back to the rows, and the rows of a frequent one are dealt over tasks.
    """
    known = [F.col(f"`{k}`").isNotNull() for k in keys]
    every = known[0]
    for k in known[1:]:
        every = every & k
    counted = rows.where(every).groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    twice = staged(counted.withColumn("__parts", F.ceil(F.col("__c") / most).cast("int")), "repeated-keys")
    on = [f"__k{i}" for i in range(len(keys))]
    keyed = rows.withColumns({k: F.col(f"`{c}`") for k, c in zip(on, keys)})
    hot = twice.where("__parts > 1").orderBy(F.desc("__c")).limit(HOT_KEYS).select(*on, F.col("__parts").alias("__deal"))
    dealt = keyed.join(F.broadcast(hot), on, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__deal", F.lit(1))).cast("int"))
    copies = twice.join(F.broadcast(hot), on, "left").select(*on, F.explode(F.sequence(F.lit(0), F.coalesce("__deal", F.lit(1)) - 1)).alias("__part"), F.lit(True).alias("__twice"))
    out = dealt.join(copies, [*on, "__part"], "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__twice", F.lit(False)).alias(name))


def violations(rows: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with `violations`; a rule that is null (an unknown value) is not broken, and a key with a null is unique."""
    out = rows
    for name, keys in (unique or {}).items():
        out = repeated(out, keys, f"__{name}")
    broken = [F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()] + [F.when(F.col(f"__{n}"), n) for n in (unique or {})]
    return out.withColumn("violations", F.filter(F.array(*broken), lambda x: x.isNotNull())).drop(*[f"__{n}" for n in (unique or {})])


def vessel_rules() -> dict[str, Column]:
    return {"imo_format": F.col("imo").rlike("^[0-9]{7}$"), "mmsi_format": F.col("mmsi").rlike("^[0-9]{9}$")}


def position_rules() -> dict[str, Column]:
    return {"mmsi_format": F.col("mmsi").rlike("^[0-9]{9}$"), "lat_range": F.abs("lat") <= 90, "lon_range": F.abs("lon") <= 180, "speed_sign": F.col("speed") >= 0, "heading_range": F.col("heading").between(0, 360), "course_range": F.col("course").between(0, 360)}


def transaction_rules() -> dict[str, Column]:
    classes = ("VALID", "SUSPICIOUS", "HIGH_RISK", "REVIEW_REQUIRED", "REJECTED", "MANUALLY_APPROVED")
    return {"time_order": F.col("end_s") >= F.col("start_s"), "quantity_sign": F.col("quantity") >= 0, "density_sign": F.col("density") > 0, "sulphur_sign": F.col("sulphur_content") >= 0, "flashpoint_sign": F.col("flashpoint") >= 0, "class_domain": F.col("classification").isin(*classes), "confidence_range": F.col("confidence").between(0, 1), "credibility_range": F.col("credibility_score").between(0, 100)}


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and those in quarantine."""
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
