"""What the operators share: tables, the shared folder, small joins and vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
#: Rows of a table that may be broadcast; beyond it `join_small` shuffles.
BROADCAST_ROWS = 20_000
#: Rows of one key that one task joins, and the most keys that are split (a broadcast of that many rows).
SPLIT_ROWS, HOT_KEYS = 4_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master that names none, one of our own (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_own_shared_dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = context._own_shared_dir = tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def join_small(df: DataFrame, small: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """Joins a table with one row per key; null keys meet null keys.

    Up to BROADCAST_ROWS rows, counted first, are broadcast. Beyond that both sides shuffle, and a key with
    more than SPLIT_ROWS rows of the large side is dealt by `salt` over as many parts as it needs.
    """
    small = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    drop = [f"__k{i}" for i in range(len(keys))]
    on = [df[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), on=_all(on), how=how).drop(*drop)
    hot = _hot_keys(df, keys)
    left = _with_parts(df, hot, keys).withColumn("__part", F.pmod(salt, F.col("__parts")).cast("int")).drop("__parts")
    right = _with_parts(small, hot, drop).withColumn("__part_r", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    on = [left[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(right, on=_all([*on, F.col("__part") == F.col("__part_r")]), how=how).drop(*drop, "__part", "__part_r")


def _hot_keys(df: DataFrame, keys: list[str], sizes: str | None = None) -> DataFrame:
    """The keys with more than SPLIT_ROWS rows and how many parts they need; the HOT_KEYS largest if there are more.

    sizes: the column of df that holds the rows of each key, where df has a row per key already.
    """
    named = [F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]
    counted = df.groupBy(*named).agg(F.count(F.lit(1)).alias("__c")) if sizes is None else df.select(*named, F.col(sizes).alias("__c"))
    hot = counted.where(F.col("__c") > SPLIT_ROWS).orderBy(F.desc("__c")).limit(HOT_KEYS)
    return materialize(hot.withColumn("__parts", F.ceil(F.col("__c") / SPLIT_ROWS).cast("int")).drop("__c"), "hot-keys")


def _with_parts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    on = [df[k].eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(keys)]
    return df.join(F.broadcast(hot), on=_all(on), how="left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).drop(*[f"__h{i}" for i in range(len(keys))])


def join_split(left: DataFrame, right: DataFrame, keys: list[str], sizes: str | None = None) -> DataFrame:
    """Inner equi-join in which no key's rows of `right` need fit one task.

    A key with more than SPLIT_ROWS rows of `right` is dealt by a hash of the whole row over parts; rows of `left` have a copy in
    each part of their key. Keys that are not among the HOT_KEYS largest are joined as they are. `right` is counted first, so it should be a
    written table, unless `left` has a row per key with the column `sizes`.
    """
    hot = _hot_keys(right, keys) if sizes is None else _hot_keys(left, keys, sizes)
    if hot.isEmpty():
        return left.join(right, keys)
    dealt = _with_parts(right, hot, keys).withColumn("__part", F.pmod(F.xxhash64(*right.columns), F.col("__parts")).cast("int")).drop("__parts")
    copied = _with_parts(left, hot, keys).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return copied.join(dealt, [*keys, "__part"]).drop("__part")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# Vectorised hashes of words: a table of random values per byte, a polynomial over the word, a mix.
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# For word_hashes(plain=True): ASCII other than letters and digits parts words too.
_PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_GROW = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    step = base
    with np.errstate(over="ignore"):
        while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            done += take
            step = step * step if done < n else step
    return out


_POW = _powers(_BASE, _GROW)
_POW_INV = _powers(_BASE_INV, _GROW)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, lower: bool, plain: bool = False) -> np.ndarray:
    """A 64-bit value for each word of a text, in order; A-Z count as a-z if `lower`, ASCII punctuation as white space if `plain`."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    gap = np.concatenate(([True], (_PLAIN if plain else _SPACE)[raw], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = (_POW, _POW_INV) if len(raw) <= _GROW else (_powers(_BASE, len(raw)), _powers(_BASE_INV, len(raw)))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * power[: len(raw)])))
        return mix((sums[ends] - sums[starts]) * inverse[starts])


_ORDER = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 16, dtype=np.uint64)]


def shingle_hashes(hashed: np.ndarray, k: int, whole_if_short: bool = True) -> np.ndarray:
    """A value for each run of k words, in order; fewer words give one run of them all, or none."""
    n = len(hashed)
    if not n or (n < k and not whole_if_short):
        return np.empty(0, np.uint64)
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width), np.uint64)
        for i in range(width):
            out += hashed[i : n - width + 1 + i] * _ORDER[i]
    return mix(out)
