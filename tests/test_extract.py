"""How the work on note texts is laid out, and labels and values at their edges."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from notecheck.operators import extract as E

NOTE = "note_id long, doc_type string, raw_text string"


def test_notes_are_spread_over_tasks(spark):
    """A thousand notes lie in one task, being few bytes; they are read by as many tasks as there are."""
    notes = spark.range(1000).select(F.col("id").alias("note_id"), F.lit("Vessel Name: A").alias("raw_text")).coalesce(1)
    assert E.extract(notes).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_flags_are_exploded_once(spark):
    """The optimizer does not work out fields anew for a condition on the flags."""
    plan = entry.queries()["rl_14_descriptions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("completed pumping|") <= 2


CASES = [
    (["Vesse1 Nane: SEA STAR"], "DIGITAL", "SEA STAR"),  # misread by two letters
    (["Vesl Nam: SEA STAR"], "DIGITAL", None),  # by too many for a printed note
    (["Vesl Nam: SEA STAR"], "HANDWRITTEN", "SEA STAR"),
    (["Vesl Nam: ONE", "Vesse1 Name: TWO"], "HANDWRITTEN", "TWO"),  # the label most alike wins
    (["Vesse1 Name: ONE", "Vesse1 Name: TWO"], "DIGITAL", "ONE"),  # of equals the first
    (["Name of Ship:", "", " \t SEA  STAR Next Port: X"], "DIGITAL", "SEA STAR"),  # two lines below, up to a stop phrase
    (["Name of Ship:", "Anchorage:", "East"], "DIGITAL", None),  # a label of its own is no value
    (["m.v. SEA STAR"], "DIGITAL", "SEA STAR"),  # first word, as it stands
    (["mv: a b c d e f g h"], "DIGITAL", "a b c d e f"),  # at most six words
    (["mx: SEA STAR"], "DIGITAL", None),  # short labels are not misread
    (["Motor Vessel    SEA STAR"], "DIGITAL", "SEA STAR"),
    (["motor vessel SEA STAR"], "DIGITAL", "SEA STAR"),
    (["number"], "DIGITAL", None),
]


def test_labels(spark):
    rows = [(i, kind, "\n".join(lines)) for i, (lines, kind, _) in enumerate(CASES)] + [(len(CASES), "DIGITAL", None)]
    notes = spark.createDataFrame(rows, NOTE).withColumn("ocr_confidence", F.lit(0.5))
    got = {r.note_id: r.vessel_name for r in E.routed(notes).select("note_id", "vessel_name").collect()}
    assert got == dict(enumerate([want for *_, want in CASES] + [None]))


def test_short_labels_alone(spark):
    notes = spark.createDataFrame([(1, "DIGITAL", "imo: 9\nimp: 8")], NOTE)
    assert [(r.field, r.value) for r in E.find_fuzzy(notes, {"imo": ["imo"]}).collect()] == [("imo", "9")]
