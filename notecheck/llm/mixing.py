"""Mixing sources to target weights by hash thresholds.

Every document has a hash of its id. Words are summed by source and top bits of the hash (the bucket). A source's target is
met by whole passes over the source plus a part: the documents below a threshold of the hash. The histogram gives the bucket
in which the part's budget runs out; only the documents of that boundary bucket are summed again, by the next bits; the
threshold is then exact to 2^-20 of the hash range, and no document is sorted. Thresholds are nested: a larger budget takes
every document that a smaller one takes.

Targets: sources by code point, null last, weigh `weights` in turn, and share all words; no target exceeds `most` times its
source's words, the excess being shared again by weight among the others until none is above.

Nulls and edges: a null text has no words and is taken with 0; a null source is a source; rows with equal doc_id (null too) share a hash and
so stay or go together; sources without words get target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, join_small, materialize

BITS = 10


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    seed: int = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, seed: int) -> Column:
    """20 bits of MD5, the same in any run, partitioning and engine."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(name), 1, 2 * BITS // 4), 16, 10).cast("int")


def _targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """source, source_size, target. One row per source in and out; water filling without a loop:

    in the order of size/weight, the first sources are the capped ones; the level of the others follows from prefix sums.
    """
    n = len(params.weights)
    # The order needs one task, over one row per source.
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in params.weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int")).cast("double"))
    every = W.partitionBy(F.lit(0))
    fill = every.orderBy((F.lit(float(params.most)) * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    cap = params.most * F.col("source_size")
    # Were the sources before this one capped and no more, the level would be `level`; this source is capped if it lies above.
    seen = weighted.withColumn("total", F.sum("source_size").over(every)).withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    seen = seen.withColumn("level", F.col("left") / F.col("w_left")).withColumn("capped", F.col("level") * F.col("w") > cap)
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("rank"), F.col("level")))).over(every)["level"]
    return seen.withColumn("rank", F.row_number().over(fill)).withColumn("level", level).select("source", "source_size", F.when(F.col("capped") | F.col("level").isNull(), cap.cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, params: MixParams) -> DataFrame:
    """source, source_size, target, passes, cut: documents with a hash below `cut` are taken passes + 1 times, the others passes times.

    sized: source, size, h. Two passes over thin rows: the histogram, and the boundary buckets.
    """
    top = F.shiftright("h", BITS)
    histogram = materialize(sized.groupBy("source", top.alias("bucket")).agg(F.sum("size").alias("words")), "mix-histogram")  # 1,024 rows a source at most
    targets = _targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), params)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    targets = materialize(targets, "mix-targets")
    run = W.partitionBy("source").orderBy("bucket")
    t = targets.select(F.col("source").alias("t_source"), "rest")
    cumulated = histogram.withColumn("upto", F.sum("words").over(run)).join(t, F.col("source").eqNullSafe(F.col("t_source")))
    boundary = materialize(cumulated.where("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("budget")), "bucket").alias("x")).select("source", "x.*"), "mix-boundary")
    inside = join_small(sized, boundary, ["source"], F.col("h")).where(top == F.col("bucket"))
    fine = inside.groupBy("source", "bucket", "budget", F.pmod("h", F.lit(1 << BITS)).alias("sub")).agg(F.sum("size").alias("words"))
    deep = W.partitionBy("source").orderBy("sub")
    fine = fine.withColumn("upto", F.sum("words").over(deep)).withColumn("before", F.col("upto") - F.col("words"))
    # The sub-bucket in which the budget ends is in if that ends nearer to the budget.
    met = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("sub", "upto", "before", "budget"))).alias("x")
    cuts = fine.groupBy("source", "bucket").agg(met).select("source", (F.col("bucket") * (1 << BITS) + F.col("x.sub") + F.when(F.col("x.upto") - F.col("x.budget") < F.col("x.budget") - F.col("x.before"), 1).otherwise(0)).cast("int").alias("cut"))
    c = cuts.select(F.col("source").alias("c_source"), "cut")
    # No boundary: the rest is nothing, or all of it.
    whole = F.when(F.col("rest") > 0, 1 << (2 * BITS)).otherwise(0)
    return targets.join(c, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", "source_size", "target", "passes", F.coalesce("cut", whole).alias("cut"))


def _thin(documents: DataFrame, params: MixParams) -> DataFrame:
    return documents.select("doc_id", "source", size_of(F.col("text")).alias("size"), _hash(F.col("doc_id"), params.seed).alias("h"))


def copies() -> Column:
    return (F.col("passes") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).cast("long")


def mix_sources(documents: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row of documents."""
    sized = materialize(_thin(documents, params), "mix-sizes")
    limits = materialize(thresholds(sized, params), "mix-limits")
    out = join_small(sized, limits, ["source"], F.col("h"))
    return out.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"), copies().alias("copies"))


def take_mix(documents: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of documents that the mix takes, as often as it takes them, all their columns as they were; rows without words go."""
    limits = materialize(thresholds(materialize(_thin(documents, params), "mix-sizes"), params), "mix-limits")
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), F.col("source"), _hash(F.col("doc_id"), params.seed).alias("h"), F.col("text").rlike(WORD).alias("__any"))
    taken = join_small(row.where("__any"), limits, ["source"], F.col("h")).withColumn("__n", copies()).where("__n > 0")
    return taken.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))).select("__row.*")
