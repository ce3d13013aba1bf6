"""N-gram Jaccard join: an exact metric-space self-join of shingle sets, to connected components.

Jaccard distance is a metric, but nearly all documents lie at distance 1 from any given document, where pivots that are
documents separate nothing. So the first pivots are single shingles: a document's distance to {s} is 1 - 1/n if it holds s,
and 1 otherwise. Its regions are the shingles it holds, nearest first by a fixed order (frequent shingles last, else by hash).
Documents x and y with |x & y| >= o differ in at most |x| - o shingles of x, so they have a common region among the first
|x| - ceil(t |x|) + 1 of each: that many regions take a copy of a boundary document, and no more. Inside regions the pivots
are documents:

1. Texts become sets of 64-bit shingle hashes; equal sets are one class from here on.
2. Every class sends its lowest hashes (a quarter more than it needs, and a few) to their regions. The smallest class of a region is its
   pivot; documents that share enough of their hashes with it are compared exactly, and those within the radius join its cell.
3. Regions are counted in cells. Shingles with more than `hot` cells are ordered last. Documents keep the regions they need in
   that order. Documents for which frequent shingles leave too few regions meet each other by whole sets, rarest first among themselves.
4. A region of more than `small` documents that would make more than `crowd` pairs of different cells a document is split: up to PIVOTS documents of its largest cells
   become pivots, every member is measured against them exactly and goes to its nearest pivot's Voronoi region; it has a copy in each
   other whose pivot is no further than the nearest plus twice the radius. Inside, rings of one radius around the pivot hold a document and
   a copy of it in the next ring. Members within the radius of a pivot join its cell. What is still crowded is split again, with other
   pivots, as long as the pairs left become fewer. Regions left then that have nearly the same members become one family, whose pairs
   are made once, in tiles.
5. Remaining pairs are compared exactly, text against text. Links join cells into components.

No step drops a pair that could link: all bounds are exact. Frequent shingles, pivots and regions are split over tasks. Where many
documents lie at nearly the same distance, just beyond the radius, from each other, no pivot separates them, and step 4 ends in as many
comparisons as they have pairs; they are dealt over tasks, but nothing makes them fewer.

Nulls and edges: texts without words have n_shingles 0 and link with nothing; a text with fewer words than `k` is one shingle
of them all; rows with a null doc_id have the size of their set, link with nothing and have a null component; rows with equal doc_id are
one document: what links with one of them is linked with all; very long texts are sets like any other; ties of distance go to the smaller
pivot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _hot_keys, _with_parts, join_small, join_split, materialize, mix, shingle_hashes, word_hashes, words

#: Rows of a few longs that may be broadcast (about 16 MB in memory), counted first; beyond, joins shuffle.
BROADCAST_IDS = 200_000
PIVOTS = 8
BLOCK = 2000  # documents of a region that one task holds against the others
TILES = 8  # blocks of a family at least, so that several tasks share it
ENTRIES = 1_000_000  # places in regions that a block of a family has on average at most


@dataclass(frozen=True)
class JoinParams:
    k: int = 4
    num: int = 85  # link if 100 * |x & y| >= num * |x | y|
    hot: int = 32
    crowd: int = 8  # pairs a document above which a region of more than `small` documents is split by pivots
    small: int = 256


def text_set(text: object, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text if isinstance(text, str) else None, True), k))


def digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(np.array(a, np.uint64).view(np.int64)), int(np.array(b, np.uint64).view(np.int64))


def _need(n: Column, num: int) -> Column:
    """Regions that a set of n shingles needs: n - ceil(t n) + 1."""
    return n - F.floor((num * n + 99) / 100).cast("int") + 1


def _least(a: Column, b: Column, num: int) -> Column:
    """The smallest intersection with which sets of a and b shingles link."""
    return F.ceil(num * (a + b) / F.lit(100 + num)).cast("int")


def _sizes_fit(a: Column, b: Column, num: int) -> Column:
    return 100 * F.least(a, b) >= num * F.greatest(a, b)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted here, are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def hashed_sets(documents: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, n, d1, d2 (digests of the set), lows (its lowest hashes) for every row."""
    k, num = params.k, params.num

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                s = text_set(text, k)
                n = len(s)
                take = min(n, (n - -(-num * n // 100) + 1) * 5 // 4 + 12)
                rows.append((i, n, *digest(s), s[:take].view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "d1", "d2", "lows"])

    # Ids travel as text: pandas would turn a column of longs with a null into doubles.
    thin = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return thin.mapInPandas(hashed, "doc_id string, n int, d1 long, d2 long, lows array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def whole_sets(documents: DataFrame, chosen: DataFrame, params: JoinParams) -> DataFrame:
    """id, n, h for every shingle of the chosen classes (id, doc, n, d1)."""
    k = params.k

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, d1, text in zip(b["id"], b["d1"], b["text"], strict=True):
                s = text_set(text, k)
                if digest(s)[0] == d1:
                    rows.append((i, len(s), s.view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "n", "hs"])

    texts = documents.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    rows = texts.join(_small(chosen.select("id", "doc", "d1")), F.col("__doc") == F.col("doc")).select("id", "d1", "text")
    return rows.mapInPandas(hashed, "id long, n int, hs array<long>").select("id", "n", F.explode("hs").alias("h")).distinct()


def compare(documents: DataFrame, pairs: DataFrame, classes: DataFrame, params: JoinParams, name: str, every: bool = False) -> DataFrame:
    """a, b, distance of the pairs (a, b) of classes that link, or of every pair, by exact comparison of their texts' sets.

    Each b travels to its a; an a with many pairs has several copies.
    """
    k, num = params.k, params.num
    salted = _with_parts(pairs.select("a", "b"), _hot_keys(pairs, ["a"]), ["a"]).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("__parts")).cast("int")).drop("__parts")
    asked = salted.select("a", "salt", F.col("b").alias("id"), F.lit(1).alias("member")).unionByName(salted.select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("member")).distinct())
    asked = materialize(asked.join(_small(classes.select("id", "doc", "d1").join(_small(asked.select("id").distinct()), "id", "left_semi")), "id"), f"{name}-asked")
    texts = documents.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    sent = texts.join(_small(asked), F.col("__doc") == F.col("doc")).select("a", "salt", "member", "id", "d1", "text")
    dealt = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "id")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pivot = None, np.empty(0, np.uint64)
        for b in batches:
            rows = []
            for a, salt, member, i, d1, text in zip(b["a"], b["salt"], b["member"], b["id"], b["d1"], b["text"], strict=True):
                s = text_set(text, k)
                if digest(s)[0] != d1:
                    continue  # another row of a repeated doc_id
                if not member:
                    at, pivot = (a, salt), s
                elif at == (a, salt):
                    common = len(np.intersect1d(pivot, s, assume_unique=True))
                    union = len(pivot) + len(s) - common
                    if every or 100 * common >= num * union:
                        rows.append((a, i, 1 - common / union, 100 * common >= num * union))
            yield pd.DataFrame(rows, columns=["a", "b", "distance", "linked"])

    return materialize(dealt.mapInPandas(measured, "a long, b long, distance double, linked boolean").distinct(), f"{name}-measured")


def components(edges: DataFrame, name: str) -> DataFrame:
    """id, component (the smallest id reachable) for every id of the edges (a, b).

    Alternating large-star and small-star steps, each a written table, until every node points to its root. A node with very many
    neighbours is a plain equi-join of two longs a row, which adaptive execution splits.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Nodes that are minima themselves keep no edge; all others now point at or below their neighbours' minimum.
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, f"{name}-star")
        # Each node has one edge by now; done when no edge leads to a node that has one itself.
        if e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and e.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            break
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _celled(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """With the cell of `id`; a class without links is its own."""
    return rows.join(_small(cells.select("id", F.col("component").alias("cell"))), "id", "left").withColumn("cell", F.coalesce("cell", "id"))


def _frequent(postings: DataFrame) -> DataFrame:
    """Shingles (h) that, by a sixteenth of the documents, stand in a thousand or more; 50,000 at most. What is missed is only not split."""
    part = postings.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c >= 64")
    return materialize(part.orderBy(F.desc("c")).limit(50_000).select("h"), "jaccard-frequent")


def _regions(postings: DataFrame) -> DataFrame:
    """h, id, n, rank, pivot, pivot_n: postings (h, id, n, rank) of shingles with more than one class, and the smallest class there.

    Those of frequent shingles have a null pivot.
    """
    marked = postings.join(F.broadcast(_frequent(postings).withColumn("often", F.lit(True))), "h", "left")
    least = F.min(F.struct("id", "n"))
    region = W.partitionBy("h")
    seldom = marked.where("often is null").drop("often").withColumn("size", F.count(F.lit(1)).over(region)).withColumn("pivot", least.over(region)).where("size > 1").drop("size")
    often = marked.where("often").drop("often").withColumn("pivot", F.lit(None).cast(seldom.schema["pivot"].dataType))
    every = seldom.unionByName(often)
    return every.select("h", "id", "n", "rank", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n"))


def _to_pivots(shared: DataFrame, num: int) -> DataFrame:
    """id, n, pivot: a row for every region of `_regions` in which a class meets a pivot, not itself, that it fits in size."""
    fit = (F.col("id") != F.col("pivot")) & _sizes_fit(F.col("n"), F.col("pivot_n"), num)
    often = shared.where("pivot is null").select("h", "id", "n")
    pivots = often.groupBy("h").agg(F.min(F.struct("id", "n")).alias("x"))  # a row per frequent shingle
    pivots = materialize(pivots.select(F.col("h").alias("at"), F.col("x.id").alias("pivot"), F.col("x.n").alias("pivot_n")), "jaccard-pivots")
    # The join itself drops what does not fit, most of the rows of a shingle that stands in texts of all lengths.
    met = often.join(F.broadcast(pivots), (F.col("h") == F.col("at")) & fit)
    return shared.where(fit).select("id", "n", "pivot").unionByName(met.select("id", "n", "pivot"))


def _crowds(members: DataFrame, name: str) -> DataFrame:
    """g, size, pairs (of different cells), big (the largest cell) of every region with two cells or more."""
    cells = members.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("c"))
    found = cells.groupBy("g").agg(F.sum("c").alias("size"), F.sum(F.col("c").cast("double") * F.col("c")).alias("same"), F.max_by("cell", F.struct("c", "cell")).alias("big"), F.count(F.lit(1)).alias("cells"))
    return materialize(found.where("cells > 1").select("g", "size", ((F.col("size").cast("double") * F.col("size") - F.col("same")) / 2).alias("pairs"), "big"), f"{name}-crowds")


def _in_regions(members: DataFrame, crowds: DataFrame) -> DataFrame:
    """Members with their region's columns; large regions are split over tasks."""
    return join_split(crowds, members, ["g"], "size")


def _met(members: DataFrame, crowds: DataFrame, num: int) -> DataFrame:
    """a, b, na, nb, g: pairs of different cells and fitting sizes of the regions in crowds; not of two members of kind 2.

    All members of a region lie in blocks; those outside its largest cell have a copy in every block.
    """
    inside = _in_regions(members, crowds).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    y = inside.select("g", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("cell").alias("cy"), F.col("place").alias("py"), F.col("kind").alias("ky"), "big")
    x = inside.where("cell <> big").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("cell").alias("cx"), F.col("place").alias("px"), F.col("kind").alias("kx"))
    least = _least(F.col("nx"), F.col("ny"), num)
    # If this is the first region in which they meet, what stands before it is held by one of them alone.
    alone = F.col("px") + F.col("py") + F.abs((F.col("nx") - F.col("px")) - (F.col("ny") - F.col("py")))
    fit = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("big")) | (F.col("x") < F.col("y"))) & _sizes_fit(F.col("nx"), F.col("ny"), num) & ~((F.col("kx") == 2) & (F.col("ky") == 2)) & (alone <= F.col("nx") + F.col("ny") - 2 * least)
    met = x.join(y, ["g", "block"]).where(fit)
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return met.select("g", pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("nx", "ny").alias("na"), pick("ny", "nx").alias("nb"))


def _families(members: DataFrame, crowds: DataFrame, name: str) -> DataFrame:
    """family, id, n, cell, kind, block, blocks, gs, places: the members of regions, once in each family, with their regions there.

    Regions that agree on their member of the smallest hash are one family if together they have at most twice the members of the largest;
    any other region is a family of its own. A family's regions all hold one document, so that document's length bounds their number.
    """
    inside = materialize(_in_regions(members, crowds).select("g", "id", "n", "cell", "place", "kind", "size"), f"{name}-inside")
    heads = materialize(inside.groupBy("g").agg(F.min_by("id", F.xxhash64("id")).alias("head"), F.first("size").alias("size")), f"{name}-heads")
    headed = join_split(heads.select("g", "head", "size"), inside.drop("size"), ["g"], "size")
    union = headed.select("head", "id").distinct().groupBy("head").agg(F.count(F.lit(1)).alias("held"))
    union = union.join(heads.groupBy("head").agg(F.max("size").alias("largest")), "head")
    alike = F.col("held") <= 2 * F.col("largest")
    family = F.when(alike, F.xxhash64(F.lit(0), "head")).otherwise(F.xxhash64(F.lit(1), "g"))
    named = materialize(heads.join(union, "head").select("g", "size", family.alias("family"), F.when(alike, F.col("held")).otherwise(F.col("size")).alias("held")), f"{name}-families")
    blocks = F.greatest(F.lit(TILES), F.ceil(F.max("held") / BLOCK), F.ceil(F.sum("size") / ENTRIES)).cast("int")
    sized = named.groupBy("family").agg(blocks.alias("blocks"), F.max("held").alias("held"))
    at = join_split(named.select("g", "family", "size"), inside.drop("size"), ["g"], "size")
    once = at.groupBy("family", "id").agg(*[F.first(c).alias(c) for c in ("n", "cell", "kind")], F.collect_list(F.struct("g", "place")).alias("at"))
    once = once.select("family", "id", "n", "cell", "kind", F.col("at.g").alias("gs"), F.col("at.place").alias("places"))
    dealt = join_split(materialize(sized, f"{name}-sized"), once, ["family"], "held").drop("held")
    return materialize(dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")), f"{name}-members")


def _by_region(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of each region and their places there."""
    if rows.empty:
        return {}
    g, place = np.concatenate(rows["gs"].to_list()), np.concatenate(rows["places"].to_list())
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows["gs"]])
    order = np.argsort(g, kind="stable")
    found, starts = np.unique(g[order], return_index=True)
    return {int(r): (owner[i], place[i]) for r, i in zip(found, np.split(order, starts[1:]), strict=True)}


def _met_in_families(members: DataFrame, crowds: DataFrame, num: int, name: str) -> DataFrame:
    """a, b: the pairs of `_met`, each once a family instead of once a region in which its documents meet."""
    held = _families(members, crowds, name)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = held.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def met(tile: pd.DataFrame) -> pd.DataFrame:
        lo, hi = tile["lo"].iloc[0], tile["hi"].iloc[0]
        x, y = tile[tile["block"] == lo], tile[tile["block"] == hi]
        nx, ny = x["n"].to_numpy(np.int64)[:, None], y["n"].to_numpy(np.int64)[None, :]
        slack = nx + ny - 2 * -(-num * (nx + ny) // (100 + num))  # shingles that one of the two may have alone
        ok = np.zeros(slack.shape, bool)
        there = _by_region(y)
        for g, (i, px) in _by_region(x).items():
            if g in there:
                j, py = there[g]
                at = np.ix_(i, j)
                px, py = px[:, None].astype(np.int64), py[None, :].astype(np.int64)
                ok[at] |= px + py + np.abs((nx[i] - px) - (ny[:, j] - py)) <= slack[at]
        ok &= (100 * np.minimum(nx, ny) >= num * np.maximum(nx, ny)) & (x["cell"].to_numpy()[:, None] != y["cell"].to_numpy()[None, :])
        ok &= (x["kind"].to_numpy()[:, None] != 2) | (y["kind"].to_numpy()[None, :] != 2)
        i, j = np.nonzero(np.triu(ok, 1) if lo == hi else ok)
        p, q = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    sent = tiles.select("family", "lo", "hi", "block", "id", "n", "cell", "kind", "gs", "places")
    return sent.groupBy("family", "lo", "hi").applyInPandas(met, "a long, b long")


def region_join(documents: DataFrame, members: DataFrame, classes: DataFrame, links: DataFrame, params: JoinParams, name: str, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different cells that may link, and the links found on the way.

    members: g (region), id, n, cell, place (in the region's order; 0: unknown), kind. counted: members of one pair meet in every
    region among their first, so the number of common regions bounds the intersection.
    """
    num = params.num
    crowds = _crowds(members, name)
    crowded = (F.col("pairs") > params.crowd * F.col("size")) & (F.col("size") > params.small)
    pairs = _met(members, crowds.where(~crowded), num)
    if counted:
        # The set whose kept regions end first has met all it shares of them: need - shared of them are its own alone. A pair that
        # also meets in a crowded region, which is not counted here, is met again there.
        least = _least(F.col("na"), F.col("nb"), num)
        enough = F.col("shared") >= F.least(_need(F.col("na"), num) - F.col("na") + least, _need(F.col("nb"), num) - F.col("nb") + least)
        pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).cast("int").alias("shared")).where(enough)
    pairs = pairs.select("a", "b")
    before, level = float("inf"), 0
    while True:
        # The crowded regions left to split, and how many pairs they have.
        left = crowds.where(crowded)
        now = left.agg(F.sum("pairs")).first()[0]
        if now is None:
            return pairs, links
        if now > before / 2:
            return pairs.unionByName(_met_in_families(members, left, num, f"{name}-left")), links
        before, level = now, level + 1
        members, links = _split(documents, materialize(_in_regions(members, left), f"{name}-crowded"), classes, links, params, f"{name}-{level}", level)
        crowds = _crowds(members, name)
        pairs = pairs.unionByName(_met(members, crowds.where(~crowded), num).select("a", "b"))


def _split(documents: DataFrame, members: DataFrame, classes: DataFrame, links: DataFrame, params: JoinParams, name: str, level: int) -> tuple[DataFrame, DataFrame]:
    """Members dealt to Voronoi regions and rings of pivots of their region, with copies at the boundaries; and all links so far."""
    radius = 1 - params.num / 100
    chosen = members.groupBy("g", "cell").agg(F.min_by("id", F.xxhash64("id", F.lit(level))).alias("pivot"), F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(W.partitionBy("g").orderBy(F.desc("c"), F.xxhash64("cell", F.lit(level))))
    pivots = chosen.withColumn("place", place).where(F.col("place") <= PIVOTS).groupBy("g").agg(F.collect_list("pivot").alias("pivots"))  # PIVOTS entries at most
    sized = pivots.join(members.groupBy("g").agg(F.first("size").alias("size")), "g")
    asked = materialize(join_split(materialize(sized, f"{name}-pivots"), members.drop("size"), ["g"], "size").select("g", F.explode("pivots").alias("pivot"), "id"), f"{name}-pairs")
    distances = compare(documents, asked.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), classes, params, name, every=True)
    links = materialize(links.unionByName(distances.where("linked").select("a", "b")).distinct(), f"{name}-links")
    cells = materialize(components(links, name), f"{name}-cells")
    measured = asked.join(distances.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "distance"), ["pivot", "id"]).unionByName(asked.where("pivot = id").select("pivot", "id", F.lit(0.0).alias("distance"), "g"))
    nearest = measured.groupBy("g", "id").agg(F.min("distance").alias("least"), F.collect_list(F.struct("pivot", "distance")).alias("to"))  # PIVOTS entries at most
    slack = 1e-9
    kept = nearest.select("g", "id", F.explode(F.filter("to", lambda t: t["distance"] <= F.col("least") + 2 * radius + slack)).alias("t"))
    ring = F.floor(F.col("t.distance") / (radius + slack))
    ringed = kept.select("g", "id", F.col("t.pivot").alias("pivot"), F.explode(F.array(ring, ring + 1)).alias("ring")).select(F.xxhash64("g", "pivot", "ring").alias("g2"), "g", "id")
    back = members.select("g", "id", "n", "place", "kind")
    dealt = ringed.join(back, ["g", "id"]).select(F.col("g2").alias("g"), "id", "n", "place", "kind")
    return materialize(_celled(dealt, cells).select("g", "id", "n", "cell", "place", "kind"), f"{name}-members"), links


def link_documents(documents: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of equal sets), component_id: one row per row of documents."""
    num, hot = params.num, params.hot
    table = materialize(hashed_sets(documents, params).withColumn("uid", F.monotonically_increasing_id()), "jaccard-sets")
    able = table.where("doc_id is not null and n > 0")
    # A class is known by the smallest uid of its rows.
    classes = materialize(able.groupBy("n", "d1", "d2").agg(F.min(F.struct("uid", "doc_id")).alias("x"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).select(F.col("x.uid").alias("id"), F.col("x.doc_id").alias("doc"), "n", "d1", "d2", "least", "rows"), "jaccard-classes")
    same = _same_documents(able, classes)

    # Regions of the lowest hashes.
    firsts = able
    if not classes.where("rows > 1").isEmpty():
        # Further rows of a class are fewer than classes; lows are shuffled only where even those are too many to broadcast.
        again = materialize(able.select("uid").join(classes.select(F.col("id").alias("uid")), "uid", "left_anti"), "jaccard-again")
        firsts = able.join(_small(again), "uid", "left_anti")
    postings = firsts.select(F.col("uid").alias("id"), "n", F.posexplode("lows").alias("rank", "h"))
    shared = materialize(_regions(postings), "jaccard-regions")

    # Cells around pivots. The share asked for only saves comparisons: what it leaves out is met again below.
    near = _to_pivots(shared, num).groupBy("pivot", "id").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    near = near.where(F.col("c") >= 0.4 * F.col("n") * (100 - num) / 100).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = compare(documents, materialize(near, "jaccard-near"), classes, params, "jaccard-cells").select("a", "b").unionByName(same)
    links = materialize(links, "jaccard-links")
    cells = materialize(components(links, "jaccard-cells"), "jaccard-cells")

    celled = materialize(_celled(shared.select("h", "id", "n", "rank"), cells), "jaccard-celled")
    kinds = celled.groupBy("h", "cell").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.count(F.lit(1)).alias("cells"), F.sum("c").alias("size")).where("cells > 1").select("h", (F.col("cells") > hot).alias("hot"), "size")
    known = join_split(materialize(kinds, "jaccard-kinds"), celled, ["h"], "size").drop("size")
    by_doc = W.partitionBy("id").orderBy("rank")
    counted = known.withColumn("hot_before", F.sum(F.col("hot").cast("int")).over(by_doc)).withColumn("hot_all", F.sum(F.col("hot").cast("int")).over(W.partitionBy("id")))
    sent = F.least(F.col("n"), F.floor(_need(F.col("n"), num) * 5 / 4).cast("int") + 12)
    counted = counted.withColumn("need", _need(F.col("n"), num))
    counted = materialize(counted.withColumn("short", sent - F.col("hot_all") < F.col("need")), "jaccard-counted")
    plain = counted.where(~F.col("short") & ~F.col("hot") & (F.col("rank") - F.col("hot_before") < F.col("need"))).select(F.col("h").alias("g"), "id", "n", "cell", F.lit(0).alias("place"), F.lit(1).alias("kind"))

    # Documents with too few regions of seldom shingles: whole sets, against the others in the same order (seldom ones by hash) ...
    dense = materialize(counted.where("short").select("id").distinct().join(classes, "id"), "jaccard-dense")
    full = materialize(_celled(whole_sets(documents, dense, params), cells), "jaccard-dense-sets")
    seldom = full.join(_small(counted.where("hot").select("h").distinct()), "h", "left_anti").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.shiftrightunsigned("h", 1), "h")) - 1)
    wanted = seldom.where(F.col("place") < _need(F.col("n"), num)).join(plain.select(F.col("g").alias("h")).distinct(), "h", "left_semi")
    both = plain.unionByName(wanted.select(F.col("h").alias("g"), "id", "n", "cell", F.lit(0).alias("place"), F.lit(2).alias("kind")))
    first, links = region_join(documents, materialize(both, "jaccard-plain"), classes, links, params, "jaccard-plain", True)
    # ... and against each other, rarest among themselves first.
    ordered = _rarest_first(full, num)
    second, links = region_join(documents, materialize(ordered.select(F.col("h").alias("g"), "id", "n", "cell", "place", F.lit(1).alias("kind")), "jaccard-ordered"), classes, links, params, "jaccard-dense", False)

    pairs = materialize(first.unionByName(second).distinct(), "jaccard-pairs")
    more = compare(documents, pairs, classes, params, "jaccard-last").select("a", "b")
    final = materialize(components(links.unionByName(more), "jaccard-final"), "jaccard-components")
    # Only classes of several rows, or with links, need more than their own row's doc_id.
    rooted = classes.join(_small(final), "id", "left").withColumn("root", F.coalesce("component", "id"))
    smallest = rooted.where("component is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    named = join_split(smallest, materialize(rooted.where("component is not null"), "jaccard-rooted"), ["root"]).select("n", "d1", "d2", "least", "smallest")
    named = named.unionByName(classes.where("rows > 1").join(_small(final), "id", "left_anti").select("n", "d1", "d2", "least", F.col("least").alias("smallest")))
    out = join_small(table.select("doc_id", "n", "d1", "d2", "uid"), materialize(named, "jaccard-named"), ["n", "d1", "d2"], F.xxhash64("uid"), "left")
    known_id = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(known_id, F.coalesce("least", "doc_id")).alias("class_id"), F.when(known_id, F.coalesce("smallest", "doc_id")).alias("component_id"))


def _rarest_first(full: DataFrame, num: int) -> DataFrame:
    """id, n, cell, h, c, place: the regions that whole sets (id, n, cell, h) need, in the order of the sets c that hold a shingle, those of one set left out.

    Shingles that only one set holds come first in its order and are counted by set; a set with as many of them as it needs regions shares none
    of those.
    """
    sizes = materialize(full.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")), "jaccard-dense-sizes")
    alone = materialize(sizes.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("alone")), "jaccard-dense-alone")
    left = full.join(_small(alone), "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).where(F.col("alone") < _need(F.col("n"), num))
    shared = join_split(sizes.where("c > 1").select("h", "c"), left, ["h"], "c")
    place = F.col("alone") + F.row_number().over(W.partitionBy("id").orderBy("c", "h")) - 1
    return shared.withColumn("place", place).where(F.col("place") < _need(F.col("n"), num)).drop("alone")


def _same_documents(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes of which rows have the same doc_id; none where ids are unique."""
    several = materialize(rows.groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("lo"), F.max(F.struct("n", "d1", "d2")).alias("hi")).where("lo <> hi").select("doc_id"), "jaccard-several")
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    held = rows.select("doc_id", "n", "d1", "d2").join(_small(several), "doc_id", "left_semi").distinct().join(classes.select("id", "n", "d1", "d2"), ["n", "d1", "d2"])
    held = materialize(held.select("doc_id", "id"), "jaccard-held")
    least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return join_split(least, held, ["doc_id"]).where("a <> id").select("a", F.col("id").alias("b"))


def keep_one(documents: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """The rows of documents without all but the smallest doc_id of each component, all their columns as they were.

    Rows without words or with a null doc_id stay; of rows that repeat a doc_id one stays (the one with the most words, then the last by text).
    """
    found = link_documents(documents, params).where("doc_id is not null")
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
    # Rows travel packed, so that no column of theirs meets a name used here.
    row = documents.select(F.col("doc_id").cast("long").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"))
    kept = row.join(_small(gone), F.col("__id") == F.col("__gone"), "left_anti")
    again = row.where("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("__id").alias("__again"))
    again = materialize(again, "jaccard-repeated")
    if again.isEmpty():
        return kept.select("__row.*")
    once = kept.join(_small(again), F.col("__id") == F.col("__again"), "left_anti").select("__row")
    more = kept.join(_small(again), F.col("__id") == F.col("__again"), "left_semi")
    text = F.coalesce("__row.text", F.lit(""))
    one = more.groupBy("__id").agg(F.max_by("__row", F.struct(F.size(words(text)), text)).alias("__row")).select("__row")
    return once.unionByName(one).select("__row.*")
