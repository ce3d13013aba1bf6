"""Ranked lexical search, term at a time with a limited number of accumulators.

Texts become one row each: the length, and the query terms that it holds with their counts. A bitmap of 2^20 hash slots, whatever the
number of queries, tells the tasks which words may be query terms. From these rows come each term's document frequency, weight and the
most that it adds to any document.

Each item takes its terms rarest first. A round adds the next terms' parts to the accumulators, a row per item and document. Then the
accumulators that lead are completed, and the kth best score found so far is compared with the most that the item's remaining
terms can add: once that is less, no document that has no accumulator can come in, and none is created any more. Accumulators that the
rest cannot lift to the kth score are dropped (should a later term make one again, with less than its score, it stays below).
Those that survive are met with their documents' rows, and all remaining terms are added exactly. A round takes terms with up
to `spread` times the postings taken so far, so an item makes few more accumulators than it needs, in few rounds.

Nulls and edges: a null or empty text has no term and counts nowhere, as an item it finds nothing; rows with equal doc_id or item_id (null
too) are documents and items of their own; of equal scores the smaller doc_id comes first, nulls last, then rows of one id in any order;
a very long text is one row of distinct terms; empty tables give empty results; other columns are ignored. Integers are 64 bits wide, the
product in a document's m is exact beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_small, materialize, word_hashes

SLOTS = 1 << 20
#: Terms of items that tasks know at once.
BLOCK = 250_000


@dataclass(frozen=True)
class SearchParams:
    top: int = 10
    first: int = 64  # postings that an item's first round may take
    spread: int = 8
    leaders: int = 30


def _terms(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    hashed = word_hashes(text, lower=True, plain=True)
    found, times = np.unique(hashed.view(np.int64), return_counts=True)
    return len(hashed), found, times


def query_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id, t (a term's hash) and times. An item is one query: its terms are one row of a task."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                _, found, times = _terms(text)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(c)[i], len(found)) for c in (0, 1)), pa.array(found), pa.array(times.astype(np.int64))], names=["item", "item_id", "t", "times"])

    numbered = materialize(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "search-items")
    return numbered.select("item", "item_id", "text").mapInArrow(split, f"item long, item_id {kind}, t long, times long")


def document_rows(documents: DataFrame, slots: np.ndarray) -> DataFrame:
    """uid (a number of the row), doc_id, n, ts and tfs: terms in the whole text, and those whose slot is asked for with their counts."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    packed = np.packbits(slots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        for batch in batches:
            ns, sizes, terms, counts = [], [0], [], []
            for text in batch.column(1):
                n, found, times = _terms(text.as_py())
                keep = wanted[found & (SLOTS - 1)]
                ns.append(n)
                terms.append(found[keep])
                counts.append(times[keep])
                sizes.append(sizes[-1] + len(terms[-1]))
            at = pa.array(np.array(sizes, np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "ts", "tfs"])

    return documents.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, n long, ts array<long>, tfs array<long>").withColumn("uid", F.monotonically_increasing_id())


def _with_m(rows: DataFrame, docs: int, terms: int) -> DataFrame:
    """Rows with a term, and their m = 25 + (75 n docs) div terms."""
    product = F.col("n").cast("decimal(18,0)") * F.lit(75 * docs).cast("decimal(20,0)")
    return rows.where("n > 0").withColumn("m", 25 + F.call_function("div", product, F.lit(terms).cast("decimal(20,0)")))


def _part(tf: Column, m: Column) -> Column:
    """(10^9 tf) div (1000 tf + 8 m)"""
    return F.call_function("div", 1_000_000_000 * tf, 1000 * tf + 8 * m)


def _ordered_terms(asked: DataFrame, postings: DataFrame, docs: int) -> DataFrame:
    """item, t, p, x, rest, upto: an item's terms from the rarest (p = 1); x, a part's weight with repeats; rest, the most that the terms
    after it can add together; upto, the postings up to it."""
    stats = postings.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("best"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    met = asked.join(stats, "t").withColumn("x", F.col("times") * weight).where("x > 0")
    order = W.partitionBy("item").orderBy("df", "t")  # the terms of one item
    after = F.coalesce(F.sum(F.col("x") * F.col("best")).over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    return met.select("item", "t", "x", F.row_number().over(order).alias("p"), after.alias("rest"), F.sum("df").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))


def _best(rows: DataFrame, top: int, *ties: Column) -> DataFrame:
    """The `top` rows of each item with the highest s; Spark keeps no more than that of each item and task before the shuffle."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(F.desc("s"), *ties))).where(F.col("place") <= top)


def _next(terms: DataFrame, state: DataFrame, spread: int) -> DataFrame:
    """state with `goal`, the last term of the next round: the first after which the rest is below the kth partial score, but no more
    than `spread` times the postings so far, though at least one term. state: item, p, upto, kth of items that are open."""
    s = state.select("item", F.col("p").alias("s_p"), F.col("upto").alias("s_upto"), "kth")
    ahead = terms.join(s, "item").where("p > s_p")
    enough = F.min(F.when(F.col("rest") < F.col("kth"), F.col("p")))
    cheap = F.max(F.when(F.col("upto") <= spread * F.col("s_upto"), F.col("p")))
    goal = F.greatest(F.min("p"), F.least(F.coalesce(enough, F.max("p")), F.coalesce(cheap, F.min("p"))))
    return ahead.groupBy("item", "s_p").agg(goal.alias("goal"))


def _completed(kept: DataFrame, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Accumulators (item, uid, s) with the given terms of their item added; also their documents' doc_id.

    A document's accumulators meet its row once. Tasks know the terms of all items of a block: BLOCK rows of 24 bytes, or those of one item.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = max(1, -(-terms.count() // BLOCK))
    out = None
    for b in range(blocks):
        own = F.pmod(F.xxhash64("item"), F.lit(blocks)) == b
        known = terms.where(own).select("item", "t", "x").toArrow()
        item, t, x = (known.column(i).to_numpy() for i in range(3))
        order = np.argsort(item, kind="stable")
        names, first = np.unique(item[order], return_index=True)
        first = np.append(first, len(item))
        t, x = t[order], x[order]

        def add(batches: Iterator[pa.RecordBatch], names=names, first=first, t=t, x=x) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uid, doc_id, m, n_kept = (batch.column(i) for i in (0, 1, 2, 7))
                lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(i) for i in (3, 4, 5, 6))]
                made = []
                for r, m_r in enumerate(m.to_numpy()):
                    ts, tfs, items, s = (values[at[r] : at[r + 1]] for at, values in lists)
                    place = np.minimum(np.searchsorted(names, items), max(0, len(names) - 1))
                    sizes = np.where(names[place] == items, first[place + 1] - first[place], 0) if len(names) else np.zeros(len(items), np.int64)
                    ends = np.cumsum(sizes)
                    at = np.repeat(first[place] - (ends - sizes), sizes) + np.arange(sizes.sum()) if len(names) else np.empty(0, np.int64)
                    if len(ts):
                        found = np.minimum(np.searchsorted(ts, t[at]), len(ts) - 1)
                        part = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m_r)
                        sums = np.concatenate(([0], np.cumsum(np.where(ts[found] == t[at], x[at] * part[found], 0))))
                        s = s + sums[ends] - sums[ends - sizes]
                    made.append(s)
                at = np.repeat(np.arange(batch.num_rows), n_kept.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(lists[2][1][lists[2][0][0] : lists[2][0][-1]]), uid.take(pa.array(at)), doc_id.take(pa.array(at)), pa.array(np.concatenate(made) if made else np.empty(0, np.int64))], names=["item", "uid", "doc_id", "s"])

        mine = kept.where(own).groupBy("uid").agg(F.collect_list(F.struct("item", "s")).alias("kept"))
        few = mine.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        met = rows.join(F.broadcast(mine) if few else mine, "uid").select("uid", "doc_id", "m", "ts", "tfs", F.col("kept.item").alias("items"), F.col("kept.s").alias("ss"), F.size("kept").alias("n_kept"))
        done = met.mapInArrow(add, f"item long, uid long, doc_id {kind}, s long")
        out = done if out is None else out.unionByName(done)
    return out


def search(documents: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """item_id, rank, doc_id and score: the `top` documents of each item with a score above 0."""
    asked = materialize(query_terms(items), "search-terms")
    # SLOTS numbers at most, however many queries there are.
    slots = np.zeros(SLOTS, bool)
    slots[[r[0] for r in asked.select(F.col("t").bitwiseAND(F.lit(SLOTS - 1)).cast("int")).distinct().collect()]] = True
    stored = materialize(document_rows(documents, slots), "search-rows")
    n = stored.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    rows = _with_m(stored, n.docs, max(1, n.terms))
    postings = rows.select("uid", "m", F.explode(F.arrays_zip("ts", "tfs")).alias("z")).select("uid", F.col("z.ts").alias("t"), _part(F.col("z.tfs"), F.col("m")).alias("part"))
    terms = materialize(_ordered_terms(asked, postings, n.docs), "search-order")
    state = materialize(terms.groupBy("item").agg(F.lit(0).alias("p"), F.lit(params.first).cast("long").alias("upto"), F.lit(0).cast("long").alias("kth")), "search-state")
    open_rows: DataFrame | None = None
    kept: list[DataFrame] = []
    ends: list[DataFrame] = []
    lines = rows.select("uid", "doc_id", "m", "ts", "tfs")
    while not state.isEmpty():
        step = materialize(_next(terms, state, params.spread), "search-step")
        todo = materialize(terms.join(step, "item").where("p > s_p and p <= goal").select("item", "t", "x"), "search-round")
        made = join_small(postings, todo, ["t"], F.col("uid")).select("item", "uid", (F.col("x") * F.col("part")).alias("s"))
        both = made if open_rows is None else made.unionByName(open_rows)
        sums = materialize(both.groupBy("item", "uid").agg(F.sum("s").alias("s")), "search-accumulators")
        # The leaders' whole scores: the kth of them is the kth partial score with all that follows, so items close early.
        leaders = materialize(_best(sums, params.leaders).select("item", "uid", F.lit(0).cast("long").alias("s")), "search-leaders")
        kth = _best(_completed(leaders, lines, terms), params.top).groupBy("item").agg(F.min(F.when(F.col("place") == params.top, F.col("s"))).alias("kth"))
        now = terms.join(step.select("item", "goal"), "item").where("p = goal").select("item", "p", "rest", "upto").join(kth, "item", "left").withColumn("kth", F.coalesce("kth", F.lit(0)))
        now = materialize(now.withColumn("closed", (F.col("rest") < F.col("kth")) | (F.col("rest") == 0)), "search-state")
        limits = now.select("item", "rest", "kth", "closed")
        alive = materialize(join_small(sums, limits, ["item"], F.col("uid")).where("s + rest >= kth").select("item", "uid", "s", "closed"), "search-alive")
        kept.append(alive.where("closed").drop("closed"))
        ends.append(now.where("closed").select("item", F.col("p").alias("ended")))
        open_rows, state = alive.where("not closed").drop("closed"), now.where("not closed")
    ids = asked.select("item", "item_id").distinct()
    if not kept:
        return ids.join(stored.where("n < 0").select(F.lit(0).cast("long").alias("item"), "doc_id"), "item").select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    whole, stopped = kept[0], ends[0]
    for k, e in zip(kept[1:], ends[1:]):
        whole, stopped = whole.unionByName(k), stopped.unionByName(e)
    full = _completed(whole, lines, terms.join(stopped, "item").where("p > ended")).where("s > 0")
    best = materialize(_best(full, params.top, F.col("doc_id").asc_nulls_last(), F.col("uid")), "search-best")
    return best.join(ids, "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", F.col("s").alias("score"))
