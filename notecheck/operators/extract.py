"""Fields of notes by pattern tables, their plausibility, and the confidence of an extraction.

A table maps each field to patterns with one capture, tried in order; the first that finds a value wins. All patterns keep to what
any regular-expression engine reads alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import rounded
from ..sources.store import spread, staged


def _line(labels: str, value: str = r"([^\n]*[^\s])") -> str:
    """A label at the beginning of a line, a mark or two blanks, and the value; without either the words may go on to another label."""
    return rf"(?im)^[ \t]*(?:{labels})(?:[ \t]*[:#.][ \t]*|[ \t][ \t]+){value}[ \t]*$"


_NUMBER = r"([0-9][0-9,]*\.?[0-9]*)[^\n]*"
#: field: patterns.
FIELDS: dict[str, list[str]] = {
    "vessel_name": [_line("vessel(?:'s)? name|name of vessel|receiving vessel|ship(?:'s)? name"), r"(?im)^[ \t]*(?:vessel|ship)[ \t]*:[ \t]*([^\n]*[^\s])[ \t]*$"],
    "imo": [_line(r"(?:vessel )?imo(?: no\.?| number)?", r"([0-9]{7})"), r"(?i)\bimo[^0-9\n]{0,12}([0-9]{7})\b"],
    "barge_name": [_line("barge(?: name)?|bunker (?:barge|tanker)(?: name)?|delivered by|name of barge")],
    "barge_sb_number": [_line(r"(?:barge )?sb(?: no\.?| number)?|licen[cs]e no", r"(SB[ \t-]?[0-9]+[A-Z]?)")],
    "delivery_date": [_line("delivery date|date of delivery|date", r"([0-9][^\n]*[^\s])")],
    "start_time": [_line("commenced pumping|pumping (?:start(?:ed)?|commenced)|start(?: time)?|commenced", r"([0-9][^\n]*[^\s])")],
    "end_time": [_line("completed pumping|pumping (?:end(?:ed)?|completed)|(?:end|finish)(?: time)?|completed", r"([0-9][^\n]*[^\s])")],
    "port": [_line("port(?: of delivery| name)?|delivery port|place of delivery")],
    "supplier": [_line("supplier(?: name)?|supplied by|bunker supplier")],
    "quantity_mt": [_line("quantity(?: delivered)?|(?:total )?(?:quantity|mass)(?: \\(?mt\\)?)?", _NUMBER), r"(?i)\b([0-9][0-9,]*\.?[0-9]*)[ \t]*(?:mt|metric tons?)\b"],
    "fuel_type": [_line("(?:fuel|product)(?: type| grade| name)?|grade")],
    "density": [_line(r"density(?: (?:at|@) 15 ?.?c)?", _NUMBER)],
    "sulphur_content": [_line(r"sul(?:ph|f)ur(?: content)?", _NUMBER)],
    "flashpoint": [_line("flash ?point", _NUMBER)],
    "viscosity": [_line(r"viscosity(?: (?:at|@) [0-9]+ ?.?c)?", _NUMBER)],
    "water_content": [_line("water(?: content)?", _NUMBER)],
    "seal_number_vessel": [_line("vessel(?:'s)? seal(?: no\\.?)?|seal \\(vessel\\)")],
    "seal_number_marpol": [_line("marpol seal(?: no\\.?)?|seal \\(marpol\\)")],
    "seal_number_barge": [_line("barge seal(?: no\\.?)?|seal \\(barge\\)")],
    "bdn_reference": [_line(r"bdn(?: no\.?| number| ref(?:erence)?)?", r"([A-Z0-9][A-Z0-9/-]+)")],
}
#: An older, shorter table.
LEGACY: dict[str, list[str]] = {
    "vessel_name": [_line("vessel name|vessel")],
    "imo": [r"(?i)\bimo[^0-9\n]{0,12}([0-9]{7})\b"],
    "barge_name": [_line("barge name|barge")],
    "port": [_line("port")],
    "start_time": [_line("commenced pumping|start time", r"([0-9][^\n]*[^\s])")],
    "end_time": [_line("completed pumping|end time", r"([0-9][^\n]*[^\s])")],
    "quantity_mt": [r"(?i)\b([0-9][0-9,]*\.?[0-9]*)\s*mt\b"],
    "density": [_line("density", _NUMBER)],
}
#: A time may go on after its clock.
TIMES = ("delivery_date", "start_time", "end_time")
NUMERIC = ("quantity_mt", "density", "sulphur_content", "flashpoint", "viscosity", "water_content")
#: Plausible ranges; outside them a number is dropped.
RANGES = {"density": (0.5, 1100.0), "sulphur_content": (0.0, 5.0), "flashpoint": (0.0, 200.0), "viscosity": (0.1, 800.0), "water_content": (0.0, 2.0)}
EXPECTED = ("vessel_name", "imo", "barge_name", "delivery_date", "start_time", "end_time", "port", "quantity_mt", "supplier")
LONGEST = {"vessel_name": 6, "imo": 1, "barge_name": 5, "barge_sb_number": 2, "delivery_date": 4, "start_time": 5, "end_time": 5, "port": 4, "supplier": 5, "fuel_type": 4, "seal_number_vessel": 2, "seal_number_marpol": 2, "seal_number_barge": 2}


def cap_words(value: Column, most: int) -> Column:
    """At most so many words, without punctuation at the ends."""
    return X.some(_cut_words(value, most))


def _cut_words(value: Column, most: int) -> Column:
    # Patterns of a replacement are compiled once, those of a split for every row.
    cut = F.substring_index(F.regexp_replace(value, r"\s+", " "), " ", most)
    return F.regexp_replace(cut, r"^[\s,;:.\-]+|[\s,;:\-]+$", "")


#: What ends a value, and words that are a heading rather than a value.
STOP = r"(?i)\s*(?:next\s+port|ticketing\s+number|bunker\s+metering|metering|[;|]{2}|[0-9]{2}:[0-9]{2}\s+\S)"
HEADERS = ("name", "no", "no.", "number", "date", "time", "note", "quantity", "volume", "mass", "total", "amount", "ref", "reference", "vessel", "barge", "ship", "tanker", "buyer", "receiver", "n/a", "-", "/")


def cap_value(value: Column, most: int, stop: bool = True) -> Column:
    """A value up to the first phrase that ends it, of at most so many words; null where that leaves nothing or a heading."""
    return X.let(cap_words(F.trim(_until_stop(value) if stop else value), most), lambda x: F.when(~F.lower(x).isin(*HEADERS), x))


def _until_stop(value: Column) -> Column:
    return F.regexp_replace(value, STOP + "(?s:.*)", "")


def is_garbage(value: Column) -> Column:
    """Too short, full of marks, or mostly neither letters nor digits."""
    meaning = F.length(F.regexp_replace(value, r"[^A-Za-z0-9]", "")) / F.greatest(F.length(value), F.lit(1))
    return (F.length(value) < 2) | (F.regexp_count(value, F.lit(r"[@<>=\\\[\]]")) >= 2) | value.rlike("^[a-z] ") | ((F.length(value) > 3) & (meaning < 0.7))


def plausible(value: Column, field: str) -> Column:
    low, high = RANGES[field]
    return F.when((value >= low) & (value <= high), value)


def plausible_text(value: Column, field: str) -> Column:
    """Null where a name has too few letters, a place or supplier too many digits, a supplier is a licence, a day has no digit, or a time an hour beyond 23."""
    n = F.greatest(F.length(value), F.lit(1))
    alpha, digits = F.length(F.regexp_replace(value, "[^A-Za-z]", "")) / n, F.length(F.regexp_replace(value, "[^0-9]", "")) / n
    keep = {"vessel_name": (alpha >= 0.5) & (F.length(value) >= 2), "barge_name": alpha >= 0.4, "port": digits <= 0.4, "supplier": (digits <= 0.4) & ~value.rlike(r"(?i)licence|license|lic\s*no"), "delivery_date": digits > 0}
    hour = F.regexp_extract(value, "([0-9]{2}):[0-9]{2}", 1)
    keep |= {f: (hour == "") | (hour < "24") for f in ("start_time", "end_time")}
    return F.when(keep[field], value) if field in keep else value


def _checked(found: DataFrame, fields: Iterable[str], kept: list[str], most: dict[str, int], number: Callable[[Column], Column] = X.to_number) -> DataFrame:
    """The kept columns and fields as checked values of found ones. Each projection names what the one before computed, so nothing is computed twice."""
    step = lambda df, change: df.select(*kept, *[change(f).alias(f) for f in fields])
    text = lambda f: f not in NUMERIC and f in most
    c = F.col
    cut = step(found, lambda f: number(c(f)) if f in NUMERIC else _cut_words(F.trim(c(f) if f in TIMES else _until_stop(c(f))), most[f]) if text(f) else c(f))
    named = step(cut, lambda f: F.when((c(f) != "") & ~F.lower(c(f)).isin(*HEADERS), c(f)) if text(f) else c(f))
    return step(named, lambda f: plausible(c(f), f) if f in RANGES else c(f) if f in NUMERIC else plausible_text(c(f), f))


def extract(notes: DataFrame, fields: dict[str, list[str]] = FIELDS, keep: tuple[str, ...] = ("note_id", "doc_type", "ocr_confidence", "font_variance", "raw_text", "received_s")) -> DataFrame:
    """The kept columns and each field as text or number; a note without a field has null there."""
    kept = [c for c in keep if c in notes.columns]
    # Projections: captures, first captures, checked values; each names what the one before computed.
    tried = (spread(notes.select(kept), "note_id") if "note_id" in kept else notes).select(*kept, *[F.regexp_extract(F.coalesce("raw_text", F.lit("")), p, 1).alias(f"{f}__{i}") for f, ps in fields.items() for i, p in enumerate(ps)])
    found = tried.select(*kept, *[F.coalesce(*[F.when(F.col(f"{f}__{i}") != "", F.col(f"{f}__{i}")) for i in range(len(ps))]).alias(f) for f, ps in fields.items()])
    return _checked(found, fields, kept, LONGEST)


def normalized(extracted: DataFrame) -> DataFrame:
    """All normalisers over extracted fields."""
    x = F.col
    return extracted.withColumns({"vessel_name": X.normalize_vessel_name(x("vessel_name")), "imo": X.normalize_imo(x("imo")), "barge_name": X.normalize_barge_name(x("barge_name")), "port": X.normalize_port(x("port")), "density": F.round(F.when(x("density") > 10, x("density") / 1000).otherwise(x("density")), 4)})


def extraction_confidence(fields: tuple[str, ...] = EXPECTED) -> Column:
    found = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return rounded(0.7 * found / len(fields) + 0.3 * F.coalesce("ocr_confidence", F.lit(0.0)), 3)


def anchored_times(extracted: DataFrame) -> DataFrame:
    """For handwritten notes: bare times inherit the delivery date."""
    bare = lambda c: (F.col("doc_type") == "HANDWRITTEN") & F.col(c).rlike(X.TIME_ONLY) & F.col("delivery_date").isNotNull()
    return extracted.withColumns({c: F.when(bare(c), F.concat_ws(" ", "delivery_date", X.normalize_time_only(F.col(c)))).otherwise(F.col(c)) for c in ("start_time", "end_time")})


#: The labels of each field.
LABELS: dict[str, tuple[str, ...]] = {
    "vessel_name": ("vessel name", "vessel's name", "ship name", "receiving vessel", "receiving vessel name", "mv", "m.v.", "motor vessel", "name of vessel", "name of ship"),
    "imo": ("imo number", "imo no", "imo no.", "imo", "imo#", "vessel imo", "vessel imo number", "vessel's imo no", "vessel's imo no."),
    "barge_name": ("barge name", "name of barge", "bunker barge", "bunker barge name", "bunker tanker", "bunker tanker name", "bunker tanker's name", "delivering vessel", "bunker vessel", "bunker craft", "barge", "craft"),
    "barge_sb_number": ("sb number", "sb no", "sb no.", "sb#", "small boat no", "craft no"),
    "delivery_date": ("delivery date", "date of delivery", "bunkering date", "date of bunkering", "date"),
    "start_time": ("commenced pumping", "commencement of pumping", "pumping start time", "pumping start", "start time", "start of pumping", "start of delivery", "hose on", "hose connected", "commencement"),
    "end_time": ("completed pumping", "completion of pumping", "pumping end time", "pumping end", "pumping stop", "pumping finish", "end time", "end of delivery", "hose off", "hose disconnected", "completion"),
    "port": ("port of delivery", "port", "bunkering port", "delivery port", "location", "delivery location", "anchorage", "place", "place of delivery"),
    "supplier": ("supplier", "supplier name", "supplied by", "seller", "bunker company", "bunker supplier", "physical supplier", "bunker trader"),
    "quantity_mt": ("quantity delivered", "quantity", "total quantity", "volume", "net volume", "mass", "metric tons delivered", "metric tons", "mt delivered"),
    "fuel_type": ("fuel type", "fuel grade", "grade", "product grade", "grade of product", "product"),
    "density": ("density", "density at 15c", "density at 15 degc", "specific gravity"),
    "sulphur_content": ("sulphur content", "sulphur", "sulfur", "s content", "sulphur %"),
    "flashpoint": ("flashpoint", "flash point", "fp", "flash pt"),
    "viscosity": ("viscosity", "viscosity at 50c", "viscosity at 40c", "kinematic viscosity"),
    "water_content": ("water content", "water", "h2o content", "water % v/v", "water content % v/v"),
    "seal_number_vessel": ("vessel seal", "ship seal", "seal vessel"),
    "seal_number_marpol": ("marpol seal", "seal marpol", "marpol"),
    "seal_number_barge": ("barge seal", "seal barge"),
    "bdn_reference": ("bdn no", "bdn no.", "bdn number", "bdn reference", "bdn ref"),
}
#: A label of so few letters must stand as it is.
SHORT = 4
_MARKS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letters(x: Column) -> Column:
    """A bit for each letter and digit of a lower-case text."""
    return sum((F.when(F.contains(x, F.lit(c)), 1 << i).otherwise(0).cast("bigint") for i, c in enumerate(_MARKS)), F.lit(0).cast("bigint"))


def _keyed_lines(notes: DataFrame, ahead: int, layouts: bool) -> DataFrame:
    """note_id, limit, line, key, value, sure: what may be label and value of each line.

    `label: value`, with `;`, `|` or a tab as well; where nothing follows, the next line with text within `ahead` that is no bare label is the
    value. With layouts also `label    value`, a label alone on its line, and the first words of a line; the last two count
    only as they stand (sure), the first words of two or more also where they look alike.
    """
    blank = F.lit(" \t\r")
    lines = F.split(F.coalesce("raw_text", F.lit("")), "\n")
    # Each line beside those that may hold its value.
    ahead_of = F.arrays_zip(lines.alias("l0"), *[F.slice(lines, k + 1, 1_000_000_000).alias(f"l{k}") for k in range(1, ahead + 1)])
    at = notes.select("note_id", "limit", F.posexplode(ahead_of).alias("line", "x"))
    at = at.select("note_id", "limit", "line", *[F.trim(F.col("x")[f"l{k}"], blank).alias(f"l{k}") for k in range(ahead + 1)]).where("l0 <> ''")
    bare = lambda x: x.rlike(r"^[^:;|\t]+[:;|\t]+$")
    after = None
    for k in range(1, ahead + 1):  # the first line with text decides: it is the value, unless it is a label of its own
        x = F.col(f"l{k}")
        after = F.when(x != "", F.when(~bare(x), x)) if after is None else after.when(x != "", F.when(~bare(x), x))
    split = r"^([^:;|\t]+)[:;|\t]+(.*)$"
    at = at.select("note_id", "limit", "line", F.col("l0").alias("text"), after.alias("next"), F.regexp_extract("l0", split, 1).alias("label"), F.trim(F.regexp_extract("l0", split, 2)).alias("rest"))
    low = lambda c: F.lower(F.trim(c))
    pair = lambda k, v, sure: F.struct(low(k).alias("key"), v.alias("value"), F.lit(sure).alias("sure"))
    key = F.col("label")
    own = F.array(pair(key, F.when(F.col("rest") != "", F.col("rest")).otherwise(F.col("next")), False))
    if not layouts:
        found = F.when(key != "", own)
    else:
        gap = r"^(\S(?:.*?\S)?)[\x20\t]{2,}(\S.*)$"
        aligned_ = F.array(pair(F.regexp_extract("text", gap, 1), F.regexp_extract("text", gap, 2), False))
        at = at.withColumn("words", F.split(F.regexp_replace("text", " +", " "), " "))
        # The first words are tried by one function of their number: written out, the compiled code grows too long to be optimized.
        first = lambda n: F.struct(low(F.array_join(F.slice("words", F.lit(1), n), " ")).alias("key"), F.array_join(F.slice("words", n + 1, F.lit(10)), " ").alias("value"), (n == 1).alias("sure"))
        plain = F.concat(F.array(pair(F.col("text"), F.col("next"), True)), F.transform(F.array(*[F.lit(n) for n in (1, 2, 3, 4)]), first))
        # Two blanks before the first mark: what stands behind them is the value, marks and all.
        found = F.when((key != "") & ~key.rlike(r"\S[\x20]{2,}\S"), own).when(F.col("text").rlike(gap), aligned_).when(key != "", own).when(F.size("words") <= 14, plain)
    # Outer: else the explosion's condition would be computed once more, from the texts.
    return at.select("note_id", "limit", "line", F.explode_outer(found).alias("x")).select("note_id", "limit", "line", "x.*").where("key <> '' and value <> ''")


def find_fuzzy(notes: DataFrame, labels: dict[str, list[str]] | dict[str, tuple[str, ...]], threshold: float | Column = 80.0, ahead: int = 3, layouts: bool = False) -> DataFrame:
    """note_id, field, value, score, line: for each field the line whose label is most like one of its labels; the first of equals.

    Labels are a literal dictionary. A line's label meets those of lengths that the limit allows, and of them it is compared
    only with those whose letters differ by no more than the edits that the limit allows; short labels must be equal, and a line whose
    label is one as it stands is no misread other one.
    """
    tried = _labelled(notes, labels, threshold, ahead, layouts)
    return _best(tried).select("note_id", "field", "b.value", rounded(F.col("b.score"), 3).alias("score"), "b.line")


def _best(tried: DataFrame) -> DataFrame:
    return tried.groupBy("note_id", "field").agg(F.max_by(F.struct("value", "score", "line"), F.struct("score", (-F.col("line")).alias("l"), (-F.length("value")).alias("w"))).alias("b"))


def _literal_rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """A small table of literal structs, without a Python worker."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def _labelled(notes: DataFrame, labels: dict[str, list[str]] | dict[str, tuple[str, ...]], threshold: float | Column, ahead: int, layouts: bool) -> DataFrame:
    """note_id, field, value, score, line: every line's value under each field that its label may name. A label's words are compared once,
    however many lines bear it."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    keyed = _keyed_lines(notes.withColumn("limit", limit), ahead, layouts)
    low = threshold if not isinstance(threshold, Column) else 50.0
    # Should all labels be short, one that no text bears stands for those that may be misread.
    known = [(f, x, len(x), sum(1 << i for i, c in enumerate(_MARKS) if c in x)) for f, xs in labels.items() for x in xs if len(x) > SHORT] or [("", "\n" * (SHORT + 1), SHORT + 1, 0)]
    spark = notes.sparkSession
    table = _literal_rows(spark, [F.struct(F.lit(f).alias("field"), F.lit(x).alias("known"), F.lit(m).alias("m"), F.lit(marks).cast("bigint").alias("known_marks")) for f, x, m, marks in known])
    # A line that bears one field's label as it stands is not a misread label of another.
    whole: dict[str, list[tuple[str, float]]] = {}
    for f, xs in labels.items():
        for x in dict.fromkeys(xs):
            whole.setdefault(x, []).append((f, 100.0))
    own = F.col("key").isin(*whole)
    keys = keyed.where(~F.col("sure") & ~own).select("key").where(F.length("key") * low <= 100 * max((m for _, _, m, _ in known), default=0)).distinct()
    keys = keys.withColumn("n", F.length("key")).withColumn("marks", _letters(F.col("key")))
    most = F.floor((1 - low / 100) * F.greatest("n", "m") + 1e-9).cast("int")
    only = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    met = keys.join(F.broadcast(table), (F.abs(F.col("n") - F.col("m")) <= most) & (only("marks", "known_marks") <= most) & (only("known_marks", "marks") <= most))
    scored = met.withColumn("score", 100 * (1 - F.levenshtein("key", "known") / F.greatest("n", "m", F.lit(1)))).where(F.col("score") >= low)
    fields = F.collect_list(F.struct("field", "score")).alias("fields")
    alike = staged(scored.groupBy("key", "field").agg(F.max("score").alias("score")).groupBy("key").agg(fields), "labels")
    exact = _literal_rows(spark, [F.struct(F.lit(x).alias("key"), F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("score")) for f, v in fs]).alias("fields")) for x, fs in whole.items()])
    named = keyed.where(~F.col("sure") | own).join(exact.unionByName(alike), "key")
    return named.select("note_id", "limit", "line", "value", F.explode("fields").alias("f")).where(F.col("f.score") >= F.col("limit")).select("note_id", "f.field", "value", "f.score", "line")


def aligned(notes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Each field's value where label and value stand apart by two blanks or more instead of a colon."""
    return notes.select("note_id", *[X.some(F.regexp_extract("raw_text", rf"(?im)^[ \t]*(?:{p})[ \t]{{2,}}([^\n]*[^\s])[ \t]*$", 1)).alias(f) for f, p in labels.items()])


def routed(notes: DataFrame, digital: float = 80.0, handwritten: float = 65.0) -> DataFrame:
    """Fields by patterns; fields that no pattern finds by the most similar label, in any layout, with the limit of the note's kind; bare
    times of handwritten notes take the delivery date. Only notes that lack a field are read by lines."""
    x = staged(extract(notes), "by-patterns")
    lacking = F.lit(False)
    for f in LABELS:
        lacking = lacking | F.col(f).isNull()
    limit = F.when(F.col("doc_type") == "HANDWRITTEN", handwritten).otherwise(digital)
    # One shuffle by note serves the best line of each field, the fields of a note, and the join with its patterns' values.
    best = _best(_labelled(x.where(lacking), LABELS, limit, 3, True).repartition("note_id"))
    found = best.groupBy("note_id").agg(*[F.max(F.when(F.col("field") == f, F.col("b.value"))).alias(f) for f in LABELS])
    number = lambda c: X.to_number(F.regexp_extract(c, "([0-9][0-9,]*\\.?[0-9]*)", 1))
    found = found.withColumn("imo", F.nullif(F.regexp_extract("imo", "([0-9]{7})", 1), F.lit("")))
    most = {f: LONGEST.get(f, 8) for f in LABELS if f != "imo"}
    found = _checked(found, LABELS, ["note_id"], most, number).select("note_id", *[F.col(f).alias(f"__{f}") for f in LABELS])
    x = x.join(found, "note_id", "left")
    return anchored_times(x.withColumns({f: F.coalesce(f, f"__{f}") for f in LABELS}).drop(*[f"__{f}" for f in LABELS]))
