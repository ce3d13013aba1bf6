"""The registered queries of this subpackage, each over its whole table with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_prints, chat, importance, jaccard_join, lexical_search, license_scan, mixing, packing, quality_cnn, quality_rules, secret_scan, toxicity, url_filter
from .common import table
from .oracles import ORACLES  # noqa: F401


def op1_audio_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are turns of conversations, sounded word by word over a hiss, each from the last words of the turn before it on; so
    neighbours share a passage. Queries are those whose conv_id 20 divides."""
    ids = ["conv_id", "turn"]
    media = audio_prints.recordings_of(audio_prints.rolling_turns(table(spark, sf_dir, "conversations")), ids, noise=0.01)
    return audio_prints.align(audio_prints.fingerprint(media, ids), ids, F.col("conv_id") % 20 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"select -1L conv_id, 0L turn, 'user' role, '{probe}' text union all select -1L, 1L, 'assistant', '{probe}'")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_examples(chat.expand_turns(turns))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_audio_prints, op2_url_filter, op3_mixing, op4_toxicity, op5_packing, op6_chat, op7_jaccard_join, op8_license_scan, op9_quality_cnn, op10_quality_rules, op11_importance, op12_secret_scan, op13_lexical_search)}
