"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base statistics and five rule measures are computed per text. A rule rejects a document whose measure, in whole
per-mille, reaches the rule's cutoff in the document's stratum (its `lang`). Cutoffs are learnt from labelled documents:

* good holdout documents of a stratum (quality 1, n of them) that a cutoff would reject are counted, k;
* a cutoff is admissible if the exact binomial tail P(Bin(n, risk) <= k) is at most level / hypotheses, that is, if the
  Clopper-Pearson upper bound of its false rejection rate is below `risk`. Cutoffs of a rule are nested and tested from the
  strictest down, stopping at the first that fails, so the order needs no correction; the level is divided by the number of
  (stratum, rule) pairs (Bonferroni), and the stratum's total risk is shared equally by the rules;
* of the admissible cutoffs, the one with the most rejected bad documents less `cost` times the rejected good ones is taken, at
  the middle of the gap to the next lower measure seen. A stratum with too few labels for any guarantee rejects nothing.

Nulls and edges: a null text counts as empty and fails the base rule; a null `lang` is a stratum of its own; a null or
repeated doc_id is kept as it is, row by row (labels meet rows by doc_id; several labels of one document count as their
largest quality, null labels are ignored); very long texts are measured whole, as arrays of their words; of cutoffs that gain the same
the larger is taken; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_small, materialize, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: rule: per-mille measure; its numerator and denominator are counts.
RULES = {"symbols": ("n_symbols", "word_chars"), "shouting": ("n_exclaim", "n_words"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines")}


@dataclass(frozen=True)
class RiskParams:
    risk: float = 0.05
    level: float = 0.05
    cost: int = 10


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns of df, the base statistics and the counts that the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = _without(t, " \t\n\x0b\x0c\r")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = df.select(
        *keep,
        words(F.col(text)).alias("__w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(_without(t, "!"))).cast("long").alias("n_exclaim"),
        (F.length(t) - F.length(_without(t, CAPITALS))).cast("long").alias("n_capitals"),
        lines.alias("__lines"),
    )
    rest = ["word_chars", "n_symbols", "n_exclaim", "n_capitals"]
    keys = F.when(F.size("__w") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *keep,
        *rest,
        F.size("__w").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        keys.alias("__keys"),
    )
    rest += ["n_words", "n_lines", "n_dup_lines"]
    # Nearly all texts repeat no window; only the others sort theirs.
    twice = F.size(F.array_distinct("__keys")) < F.size("__keys")
    step = step.select(*keep, *rest, F.when(twice, F.sort_array(F.transform("__keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).alias("__sorted"))
    same = lambda x, j: F.get(F.col("__sorted"), j)["k"].eqNullSafe(x["k"])
    found = F.filter(F.transform("__sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda p: p.isNotNull())
    step = step.select(*keep, *rest, F.sort_array(found).alias("__at"))
    covered = F.aggregate(F.transform("__at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return step.select(*keep, *rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_measure(rule: str) -> Column:
    above, below = RULES[rule]
    return F.least(F.lit(1000), F.floor(1000 * F.col(above) / F.greatest(F.col(below), F.lit(1)))).cast("int")


def _critical(n: Column, risk: float, level: Column) -> Column:
    """The largest k with P(Bin(n, risk) <= k) <= level, or -1; at most n * risk terms are added."""
    import math

    log_first = n.cast("double") * F.lit(math.log1p(-risk))
    odds = F.lit(math.log(risk) - math.log1p(-risk))
    start = F.struct(log_first.alias("lt"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("bigint").alias("k"))

    def step(s: Column, j: Column) -> Column:
        cdf = s["cdf"] + F.exp(s["lt"])
        left = F.greatest((n - j).cast("double"), F.lit(1e-9))
        return F.struct((s["lt"] + F.log(left) - F.log((j + 1).cast("double")) + odds).alias("lt"), cdf.alias("cdf"), F.when(cdf <= level, j).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor(n * F.lit(risk)).cast("bigint")), start, step, lambda s: s["k"])


def learn_cutoffs(measured: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """stratum and a cutoff column per rule (null: the rule rejects nothing there).

    measured: doc_id, stratum and the counts of `measures`.
    """
    truth = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("long").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = measured.where(~base_failed()).select("doc_id", "stratum", *[rule_measure(r).alias(f"m_{r}") for r in RULES]).join(truth, "doc_id")
    long = rows.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"m_{r}").alias("at")) for r in RULES])).alias("x")).select("stratum", "quality", "x.*")
    counts = materialize(long.groupBy("stratum", "rule", "at").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")), "cutoff-counts")  # 1,001 rows a rule and stratum at most
    sizes = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"))
    level = params.level / max(1, sizes.count())
    sizes = sizes.withColumn("most", _critical(F.col("n"), params.risk / len(RULES), F.lit(level)))
    down = W.partitionBy("stratum", "rule").orderBy(F.desc("at"))
    tried = counts.select("*", F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("caught"), F.coalesce(F.lead("at").over(down), F.lit(-1)).alias("next_at"))
    size = sizes.select(F.col("stratum").alias("s2"), F.col("rule").alias("r2"), "most")
    valid = tried.join(size, tried["stratum"].eqNullSafe(size["s2"]) & (tried["rule"] == size["r2"])).where("k <= most and caught > 0 and at > 0")
    best = valid.groupBy("stratum", "rule").agg(F.max_by(F.struct("at", "next_at"), F.struct((F.col("caught") - params.cost * F.col("k")).alias("gain"), "at")).alias("x"), F.max(F.col("caught") - params.cost * F.col("k")).alias("gain"))
    best = best.where("gain > 0").select("stratum", "rule", F.greatest(F.lit(1), F.floor((F.col("x.at") + F.col("x.next_at")) / 2).cast("int") + 1).alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.max("cutoff")).select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])


def _rejected() -> Column:
    out = F.lit(False)
    for r in RULES:
        out = out | F.coalesce(rule_measure(r) >= F.col(f"cut_{r}"), F.lit(False))
    return out


def quality_rules(documents: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every row of documents."""
    table = materialize(measures(documents.select("doc_id", F.col("lang").alias("stratum"), "text"), "text", ["doc_id", "stratum"]), "quality-measures")
    cuts = materialize(learn_cutoffs(table, labels, params), "quality-cutoffs")
    judged = join_small(table, cuts, ["stratum"], F.xxhash64("doc_id"), "left")
    return judged.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & ~_rejected()).alias("kept"), *[rule_measure(r).alias(f"{r}_permille") for r in RULES])


def keep_good(documents: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """The rows of documents that the rules keep, all their columns as they were."""
    # Each text is measured once: its row travels packed beside the counts through one written table.
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), F.col("lang").alias("stratum"), F.col("text").alias("__text"))
    table = materialize(measures(inner, "__text", ["__row", "stratum"]), "quality-rows")
    cuts = materialize(learn_cutoffs(table.withColumn("doc_id", F.col("__row.doc_id")), labels, params), "quality-cutoffs")
    judged = join_small(table, cuts, ["stratum"], F.xxhash64("__row.doc_id"), "left")
    return judged.where(~base_failed() & ~_rejected()).select("__row.*")
