"""Past verdicts: scans, filters, latest rows, duplicates, upserts, review decisions and edit logs.

verdicts: id, validated_s (seconds), classification, human_review_required, confirmed_imo and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources.store import staged

CLOSED = ("VALID", "REJECTED", "MANUALLY_APPROVED")


def review_queue(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("human_review_required") & ~F.col("classification").isin(*CLOSED))


def newest(verdicts: DataFrame, limit: int, *, tie: str = "id") -> DataFrame:
    return verdicts.orderBy(F.desc("validated_s"), tie).limit(limit)


def list_transactions(verdicts: DataFrame, classification: str | None = None, human_review_only: bool = False, limit: int = 200) -> DataFrame:
    """The newest rows; the review filter applies after the limit."""
    rows = verdicts if classification is None else verdicts.where(F.col("classification") == classification)
    rows = newest(rows, limit)
    return review_queue(rows) if human_review_only else rows


def latest_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last in that order."""
    payload = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(payload, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("r")).select("r.*")


def recent(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows inside the window; rows without a time pass."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) >= as_of - days * 86400))


def duplicates(notes: DataFrame, most: int = 5, p: Params = DEFAULT) -> DataFrame:
    """note_id, duplicates (count of other notes of the same vessel, port and day) and the first few of their ids.

    A key's ids are not gathered: its smallest ids come from a rank, its size from a count.
    """
    keyed = notes.where("vessel_name is not null and port is not null and delivery_date is not null").select("note_id", F.upper("vessel_name").alias("v"), F.upper("port").alias("w"), F.col("delivery_date").alias("d"))
    per = keyed.groupBy("v", "w", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = keyed.withColumn("r", F.row_number().over(W.partitionBy("v", "w", "d").orderBy("note_id"))).where(F.col("r") <= most + 1).groupBy("v", "w", "d").agg(F.array_sort(F.collect_list("note_id")).alias("ids"))
    out = keyed.join(per, ["v", "w", "d"]).join(first, ["v", "w", "d"])
    return out.select("note_id", (F.col("n") - 1).alias("duplicates"), F.slice(F.array_except("ids", F.array("note_id")), 1, most).alias("others"))


def earlier_within(rows: DataFrame, keys: list[str], at: str, days: int, most: int = 5, row_id: str = "note_id") -> DataFrame:
    """row_id, earlier, others: how many other rows of the same keys came at most `days` days before a row, and the ids of the first of them.

    Of equal times the smaller id came before. Rows with a null key or time are neither counted nor answered. A key's rows are never gathered,
    however many it has: rows, and a probe for the beginning of each row's window, are sorted together in ranges; what stands before a row
    less what stands before its probe is the count. row_id is unique.
    """
    known = rows.where(" and ".join(f"`{c}` is not null" for c in [*keys, at])).select(F.col(row_id).alias("i"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.col(at).alias("t"))
    both = known.withColumn("kind", F.lit(1)).unionByName(known.withColumns({"t": F.col("t") - days * 86400, "kind": F.lit(0)}))
    order = [F.col(c) for c in (*[f"k{n}" for n in range(len(keys))], "t", "kind", "i")]
    placed = staged(both.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "window-ranges")
    inside = F.coalesce(F.sum("kind").over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("__range").agg(F.sum("kind").alias("n"))
    starts = sizes.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row per range
    counted = staged(placed.withColumn("c", inside).join(F.broadcast(starts), "__range").select("i", "kind", (F.col("c") + F.col("start")).alias("c")), "window-counts")
    spans = counted.groupBy("i").agg(F.max(F.when(F.col("kind") == 0, F.col("c"))).alias("low"), F.max(F.when(F.col("kind") == 1, F.col("c"))).alias("high")).where("high > low")
    first = spans.select("i", F.explode(F.sequence("low", F.least("high", F.col("low") + most) - 1)).alias("c"))
    named = first.join(counted.where("kind = 1").select(F.col("i").alias("other"), "c"), "c").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("c", "other"))).alias("o"))
    return spans.join(named, "i").select(F.col("i").alias(row_id), (F.col("high") - F.col("low")).alias("earlier"), F.transform("o", lambda x: x["other"]).alias("others"))


def repeats_within(notes: DataFrame, p: Params = DEFAULT, most: int = 5) -> DataFrame:
    """note_id, duplicates, others, reference_uses, reused_reference: the notes of the same vessel, port and day, and those with the same
    reference, that came within the window before. Only notes with either.

    notes: note_id, vessel_name, port, delivery_date, bdn_reference, received_s.
    """
    named = notes.select("note_id", F.upper("vessel_name").alias("v"), F.upper("port").alias("w"), F.col("delivery_date").alias("d"), F.upper("bdn_reference").alias("r"), "received_s")
    same = earlier_within(named, ["v", "w", "d"], "received_s", p.duplicate_window_days, most)
    uses = earlier_within(named, ["r"], "received_s", p.duplicate_window_days, 1).select("note_id", F.col("earlier").alias("uses"))
    both = same.join(uses, "note_id", "full")
    return both.select("note_id", F.coalesce("earlier", F.lit(0)).alias("duplicates"), F.coalesce("others", F.array().cast(same.schema["others"].dataType)).alias("others"), F.coalesce("uses", F.lit(0)).alias("reference_uses"), (F.coalesce("uses", F.lit(0)) > p.max_reuse_count).alias("reused_reference"))


def upsert_vessels(old: DataFrame, new: DataFrame) -> DataFrame:
    """imo, name, mmsi, vessel_type: new non-empty values win; new rows need a 7-character IMO and a name."""
    fresh = new.groupBy("imo").agg(*[F.max_by(c, F.struct("seq")).alias(c) for c in ("name", "mmsi", "vessel_type")]).select("imo", *[F.nullif(c, F.lit("")).alias(f"n_{c}") for c in ("name", "mmsi", "vessel_type")])
    both = old.withColumn("known", F.lit(True)).join(fresh, "imo", "full")
    return both.where(F.col("known") | ((F.length("imo") == 7) & F.col("n_name").isNotNull())).select("imo", *[F.coalesce(f"n_{c}", c).alias(c) for c in ("name", "mmsi", "vessel_type")])


def apply_decisions(verdicts: DataFrame, decisions: DataFrame, edited: list[str] | None = None) -> DataFrame:
    """Verdicts with the last decision (id, action, seq): approve or reject, which ends the review; and of each edited column the last value given."""
    given = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in edited or []]
    last = decisions.groupBy("id").agg(F.max_by("action", F.when(F.col("action").isin("approve", "reject"), F.col("seq"))).alias("action"), F.count_if(F.col("action").isin("approve", "reject")).alias("n"), *given).withColumn("action", F.when(F.col("n") > 0, F.col("action"))).drop("n")
    after = F.when(F.col("action") == "approve", "VALID").when(F.col("action") == "reject", "REJECTED")
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in (edited or []) else F.col(c) for c in verdicts.columns if c not in ("classification", "human_review_required")]
    return verdicts.join(last, "id", "left").select(*kept, F.coalesce(after, "classification").alias("classification"), (F.col("human_review_required") & after.isNull()).alias("human_review_required"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `place`, their number in that order: ranges of the order are numbered apart, after the counts of those before."""
    placed = staged(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    start = sizes.select("__range", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return placed.withColumn("__r", inside).join(F.broadcast(start), "__range").withColumn("place", F.col("__before") + F.col("__r")).drop("__range", "__r", "__before")


def edit_log(edits: DataFrame) -> DataFrame:
    """Per id and field each change old -> new, newest first, with the number of edits and the last time."""
    by = W.partitionBy("id", "field").orderBy("edited_s", "seq")
    whole = W.partitionBy("id", "field")
    out = edits.withColumn("old_value", F.lag("new_value").over(by)).withColumn("place", F.row_number().over(W.partitionBy("id", "field").orderBy(F.desc("edited_s"), F.desc("seq"))))
    return out.withColumn("edits", F.count(F.lit(1)).over(whole)).withColumn("last_edited_s", F.max("edited_s").over(whole)).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def histogram(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.count_if("human_review_required").alias("in_review"))


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table's rows, or the second's if the first has none."""
    any_first = first.limit(1).agg(F.count(F.lit(1)).alias("c"))
    return first.unionByName(second.join(F.broadcast(any_first.where("c > 0")), how="left_anti"))


def transaction_id(year: Column, key: Column) -> Column:
    return F.concat(F.lit("BDN-"), year.cast("string"), F.lit("-"), F.upper(F.substring(F.md5(key.cast("string")), 1, 6)))
