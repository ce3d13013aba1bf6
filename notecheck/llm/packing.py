"""Packing by optimal length buckets.

Lengths are counted in words; a text longer than `max_len` is cut into pieces of max_len words and a rest, so nothing is lost.
The global histogram of piece lengths has max_len entries at most. Dynamic programming over it chooses `buckets` boundaries
that minimise the total padding (each piece is padded to its bucket's boundary). Inside a bucket, a batch holds
floor(budget / boundary) pieces. Batches are numbered without a sort of the whole: pieces are ranked inside shards of a
bucket, and the counts of shards give each shard its first rank, so one bucket may hold all rows.

Nulls and edges: texts without words (null, empty) make no piece; a null doc_id is kept; repeated rows are pieces of their
own; ties of length fall into one bucket; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, materialize
from .mixing import size_of


@dataclass(frozen=True)
class PackParams:
    max_len: int = 4096
    buckets: int = 16
    budget: int = 65536
    shard_rows: int = 4096


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The boundaries (subset of lengths, the largest included) of at most `buckets` buckets with the least padding.

    Ties are broken towards the smaller split. Time buckets * n^2 for n distinct lengths, in numpy; memory a few n.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate(([0], np.cumsum(counts)))
    s = np.concatenate(([0], np.cumsum(counts * lengths)))
    # best[j]: least padding of the first j lengths in the buckets so far.
    best = np.concatenate(([0], lengths * c[1:] - s[1:]))
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        now, cut = best.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            now[j], cut[j] = cost[i], i
        back.append(cut)
        best = now
    out, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(documents: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, n_words, bucket_len, batch_id, slot: one row per piece of a text."""
    size = documents.select("doc_id", size_of(F.col("text")).alias("__n")).where("__n > 0")
    piece = size.select("doc_id", "__n", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / params.max_len).cast("int"))).alias("piece"))
    pieces = materialize(piece.select("doc_id", "piece", F.least(F.lit(params.max_len), F.col("__n") - F.col("piece") * params.max_len).cast("int").alias("n_words"), F.monotonically_increasing_id().alias("__row")), "pack-pieces")
    histogram = pieces.groupBy("n_words").count().collect()  # max_len rows at most
    bounds = optimal_boundaries(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), params.buckets)
    total = sum(r[1] for r in histogram)
    shards = max(1, -(-total // params.shard_rows))
    limits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>")
    bucket = F.array_min(F.filter(limits, lambda b: b >= F.col("n_words")))
    placed = pieces.withColumn("bucket_len", bucket).withColumn("__shard", F.pmod(F.xxhash64("doc_id", "piece", "__row"), F.lit(shards)))
    counts = placed.groupBy("bucket_len", "__shard").agg(F.count(F.lit(1)).alias("__c"))
    # One row per shard, a four-thousandth of the pieces.
    start = F.coalesce(F.sum("__c").over(W.partitionBy("bucket_len").orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("bucket_len", "__shard", start.alias("__start")), "pack-starts")
    inside = W.partitionBy("bucket_len", "__shard").orderBy("doc_id", "piece", "__row")
    ranked = placed.withColumn("__r", F.row_number().over(inside) - 1)
    ranked = join_small(ranked, starts, ["bucket_len", "__shard"], F.xxhash64("__row"))
    rank = F.col("__start") + F.col("__r")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(params.budget) / F.col("bucket_len"))).cast("long")
    return ranked.select("doc_id", "piece", F.col("n_words").cast("long").alias("n_words"), "bucket_len", F.concat_ws("-", F.col("bucket_len"), F.floor(rank / capacity)).alias("batch_id"), F.pmod(rank, capacity).alias("slot"))
