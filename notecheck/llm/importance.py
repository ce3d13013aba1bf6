"""Importance resampling towards a target distribution: array-scored weights, then weighted median-of-medians selection.

Features are all runs of one and two consecutive words, repeats counted, hashed by CRC-32 into buckets. The corpus and the target
(the benchmark's texts) are counted by bucket; a bucket's gain is the log of how much likelier the target makes it, and a
document's weight the mean gain of its features. Both passes work on whole Arrow buffers: bytes become word borders, borders
become checksums, one byte of all words at a time. A Gumbel draw from a hash of the id turns the weight into a score, so that
the highest scores are a draw without replacement by weight, the same in each run.

The cut is found without sorting: each chunk of keys that are still open sends its median and its size; the weighted median of
those medians (chunks of medians are folded first if there are many) is a pivot with at least a fixed share of all open keys on
either side, keys are counted against it, and one side is decided. When few keys are open, they give the exact cutoff. Only the
winners are sorted.

Nulls and edges: a null or empty text has no feature and weight 0 and cannot be drawn; a null doc_id hashes like an empty one and comes
after all others in ties; rows with equal doc_id are documents of their own, of equal scores the one with fewer features first, of equal rows any; a
very long text is measured whole, alone in its slice; an empty table gives an empty result, an empty target makes every bucket's gain
follow the corpus alone; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, materialize

#: Bytes of text that are measured at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Bytes of a word that are summed for all words together; what is longer is summed word by word.
STEPS = 48
#: Keys of a chunk that sends one median, and keys or medians that the driver takes at most (24 bytes each).
CHUNK, FEW = 10_000, 20_000


@dataclass(frozen=True)
class ImportanceParams:
    buckets: int = 10_000
    seed: int = 7
    percent: int = 25
    least_words: int = 20


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


_CRC, _ONES = _crc_table(), np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _summed(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC registers after each word, begun at `state`."""
    if not len(starts):
        return state
    order = np.argsort(-lengths, kind="stable")
    at, size, c = starts[order], lengths[order], state[order]
    for j in range(min(int(size[0]), STEPS)):
        n = int(np.searchsorted(-size, -j, side="left"))  # words with more than j bytes
        c[:n] = _CRC[(c[:n] ^ text[at[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -STEPS, side="left"))):
        c[i] = zlib.crc32(text[at[i] + STEPS : at[i] + size[i]].tobytes(), int(c[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(c)
    out[order] = c
    return out


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand side by side in `raw`: the text of each word and its bucket; of each pair of words and its bucket."""
    n = len(raw)
    text = _LOWER[raw]
    inside = _INSIDE[text]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    lengths = ends - starts
    one = _summed(text, starts, lengths, np.full(len(starts), _ONES, np.uint32))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    spaced = _CRC[(one[pair] ^ np.uint32(32)) & np.uint32(255)] ^ (one[pair] >> np.uint32(8))
    two = _summed(text, starts[pair + 1], lengths[pair + 1], spaced)
    return doc, (one ^ _ONES) % np.uint32(buckets), doc[pair], (two ^ _ONES) % np.uint32(buckets)


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of texts."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bucket_counts(texts: DataFrame, buckets: int, column: str = "text") -> DataFrame:
    """bucket and n, the features of all texts in it. A task sends a row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, offsets in _slices(batch.column(0)):
                _, one, _, two = feature_buckets(raw, offsets, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(column).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket. The driver takes two arrays of `buckets` counts, whatever the tables hold."""

    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in df.collect():
            out[r.bucket] = r.n
        return out

    s, t = counts(corpus), counts(target)
    all_s, all_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log(float(t[b] + 1) * all_s / (float(s[b] + 1) * all_t))) for b in range(buckets)], np.int64)


def weights(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of documents."""
    buckets, kind = len(gain), documents.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, raw, offsets in _slices(batch.column(1)):
                n = len(offsets) - 1
                doc, one, docs, two = feature_buckets(raw, offsets, buckets)
                sums = np.concatenate(([0], np.cumsum(gain[one]))), np.concatenate(([0], np.cumsum(gain[two])))
                at, pairs = np.searchsorted(doc, np.arange(n + 1)), np.searchsorted(docs, np.arange(n + 1))
                words[row : row + n] = np.diff(at)
                features[row : row + n] = np.diff(at) + np.diff(pairs)
                total[row : row + n] = np.diff(sums[0][at]) + np.diff(sums[1][pairs])
            weight = total // np.maximum(features, 1)  # floors go down
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return documents.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw, from the first 32 bits of a SHA-256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


_KEY = ["down", "last", "id"]  # the order of the draw: -score, null ids last, id


def _fold(rows: DataFrame, chunk: int) -> DataFrame:
    """A key and a size for each chunk of weighted keys: their weighted median and the sum of their weights."""

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def median() -> pa.RecordBatch:
            keys = np.concatenate(kept, axis=1)
            keys = keys[:, np.lexsort((keys[2], keys[1], keys[0]))]
            upto = np.cumsum(keys[3])
            at = int(np.searchsorted(upto, (upto[-1] + 1) // 2))
            return pa.RecordBatch.from_arrays([pa.array(keys[i, at : at + 1]) for i in range(3)] + [pa.array(upto[-1:])], names=[*_KEY, "n"])

        for batch in batches:
            if batch.num_rows:
                kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]))
            if sum(k.shape[1] for k in kept) >= chunk:
                yield median()
                kept = []
        if kept:
            yield median()

    return rows.select(*_KEY, "n").mapInArrow(medians, "down long, last long, id long, n long")


def _before(key: tuple[int, int, int]) -> Column:
    down, last, doc = (F.col(c) for c in _KEY)
    return (down < key[0]) | ((down == key[0]) & ((last < key[1]) | ((last == key[1]) & (doc < key[2]))))


def _same(key: tuple[int, int, int]) -> Column:
    return (F.col("down") == key[0]) & (F.col("last") == key[1]) & (F.col("id") == key[2])


def kth_key(keys: DataFrame, k: int, few: int = FEW, chunk: int = CHUNK) -> tuple[int, int, int] | None:
    """The key of place k (from 1) in the order of `down`, `last`, `id`; None if k is 0 or beyond the table. keys: a written table.

    What is open after a round is written once it is less than half of what was written before, so all rounds together read
    and write a few times the first table.
    """
    left = written = keys.count()
    if not 1 <= k <= left:
        return None
    stored, live = keys, F.lit(True)
    while left > few:
        medians = _fold(stored.where(live).withColumn("n", F.lit(1).cast("long")), chunk)
        # Few enough tasks that each has a chunk of medians to fold.
        while (n := (medians := materialize(medians, "importance-medians")).count()) > few:
            medians = _fold(medians.coalesce(-(-n // chunk)), chunk)
        found = sorted((r.down, r.last, r.id, r.n) for r in medians.collect())
        half, run = (sum(r[3] for r in found) + 1) // 2, 0
        for *key, n in found:
            run += n
            if run >= half:
                break
        pivot = tuple(key)
        counted = stored.where(live).agg(F.count_if(_before(pivot)).alias("above"), F.count_if(_same(pivot)).alias("same")).first()
        if counted.above < k <= counted.above + counted.same:
            return pivot
        if k <= counted.above:
            live, left = live & _before(pivot), counted.above
        else:
            live, k, left = live & ~_before(pivot) & ~_same(pivot), k - counted.above - counted.same, left - counted.above - counted.same
        if 2 * left < written:
            stored, live, written = materialize(stored.where(live), "importance-open"), F.lit(True), left
    return sorted(tuple(r) for r in stored.where(live).select(*_KEY).collect())[k - 1]


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `rank` from 1 in that order: ranges are sorted, and the counts of the ranges before are added."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at"))
    placed = materialize(placed, "importance-ranges")
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    # One row per range in one task.
    starts = sizes.select("__range", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("__range")) - F.col("n")).alias("__start"))
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return join_small(placed, materialize(starts, "importance-starts"), ["__range"], F.col("__at")).withColumn("rank", F.col("__start") + at + 1).drop("__range", "__at", "__start")


def resample(documents: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) and n_words for every row of documents."""
    gain = gains(bucket_counts(documents, params.buckets), bucket_counts(target, params.buckets), params.buckets)
    scored = weights(documents, gain).withColumn("score", F.col("weight") + draw(F.col("doc_id"), params.seed))
    scored = materialize(scored.select("doc_id", "n_features", "weight", "score", "n_words", (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("last"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")), "importance-scores")
    able = F.col("n_words") >= params.least_words
    keys = scored.where(able).select(*_KEY)
    k = params.percent * keys.count() // 100
    cutoff = kth_key(keys, k)
    shown = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*shown)
    won = able & (_before(cutoff) | _same(cutoff))
    # Rows that share the cutoff's key may be more than there are places.
    winners = ranked(scored.where(won), [F.col(c) for c in (*_KEY, "n_features")]).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return winners.select(*shown).unionByName(scored.where(~won).withColumn("rank", F.lit(None).cast("long")).select(*shown))


def take_drawn(documents: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """The rows of documents that are drawn, all their columns as they were. Rows with one id (null too) are drawn together if any is."""
    drawn = resample(documents, target, params).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return documents.join(drawn, documents["doc_id"].eqNullSafe(drawn["__drawn"]), "left_semi")
