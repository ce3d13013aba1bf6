"""Names, numbers and times in note text, as columns. A null or empty input gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def some(x: Column) -> Column:
    """Null for empty."""
    return let(x, lambda v: F.when(v != "", v))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def name_key(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), r"[^\p{L}\p{N}]", "")


def token_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def barge_key(x: Column, p: Params = DEFAULT) -> Column:
    """Upper case, without the first matching prefix, spaces and hyphens."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), f"^({'|'.join(p.name_prefixes)})", ""), "[ -]", "")


def normalize_imo(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) == 7, digits)


def title(x: Column) -> Column:
    return F.initcap(F.lower(x))


def normalize_port(x: Column) -> Column:
    return some(title(collapse(x)))


def normalize_vessel_name(x: Column) -> Column:
    cleaned = collapse(F.regexp_replace(F.trim(x), r"(?i)^(M\.?V\.?|M\.?T\.?)\s+", ""))
    return some(let(cleaned, lambda c: F.when((c == F.upper(c)) & (c != F.lower(c)) & (F.length(c) > 2), title(c)).otherwise(c)))


def normalize_barge_name(x: Column, p: Params = DEFAULT) -> Column:
    return some(collapse(F.regexp_replace(F.upper(F.trim(x)), f"^({'|'.join(p.name_prefixes)})", "")))


def to_number(x: Column) -> Column:
    """The digits and points of a text as a double; null if that is no number."""
    return F.regexp_replace(x, "[^0-9.]", "").try_cast("double")


def normalize_density(x: Column) -> Column:
    return let(to_number(x), lambda v: F.round(F.when(v > 10, v / 1000).otherwise(v), 4))


def clean_ocr_text(x: Column) -> Column:
    """Noise characters become spaces, hyphenated line breaks join, lines lose trailing blanks, at most two empty lines stay."""
    x = F.regexp_replace(x, r"[|~`^¦]", " ")
    x = F.regexp_replace(x, r"([A-Za-z])-\n([a-z])", "$1$2")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(x, r"\n{4,}", "\n\n\n"))


def has_keyword(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def bdn_reference(text: Column) -> Column:
    labelled = F.regexp_extract(text, r"(?i)\bBDN\s*(?:No|Number|Ref(?:erence)?)\.?\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]+)", 1)
    return F.coalesce(some(labelled), some(F.regexp_extract(text, r"\b(BDN-[A-Z0-9-]+)\b", 1)))


# Times. Every parser gives seconds since 1970 of a wall-clock time, or null.
ISO = r"^\s*(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2})(?::(\d{2}))?\s*$"
NAMED = rf"(?i)^\s*(\d{{1,2}})[- ]({MONTHS})[a-z]*[- ](\d{{4}})\s+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?\s*$"
SLASHED = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2})\s*$"
HRS_AT = r"(?i)^\s*(\d{1,2}):(\d{2})\s*hrs\.?\s*@\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
DATE_AT_HRS = r"(?i)^\s*(\d{1,2})-(\d{1,2})-(\d{4})\s*@\s*(\d{2})(\d{2})\s*HRS\.?\s*$"
TIME_ONLY = r"(?i)^\s*(\d{2}):?(\d{2})\s*(?:HRS\.?|H)?\s*$"


def _part(x: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(x, pattern, i)


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS.split("|")]), title(F.substring(name, 1, 3)))


def seconds_of(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column | None = None) -> Column:
    y, m, d, h, mi = (c.try_cast("int") for c in (year, month, day, hour, minute))
    s = F.coalesce(some(second).try_cast("int"), F.lit(0)) if second is not None else F.lit(0)
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when((h < 24) & (mi < 60) & (s < 60) & y.isNotNull() & date.isNotNull(), F.unix_date(date).cast("long") * 86400 + h * 3600 + mi * 60 + s)


def parse_iso(x: Column) -> Column:
    named = F.when(x.rlike(NAMED), seconds_of(_part(x, NAMED, 3), month_number(_part(x, NAMED, 2)).cast("string"), _part(x, NAMED, 1), _part(x, NAMED, 4), _part(x, NAMED, 5), _part(x, NAMED, 6)))
    return F.coalesce(F.when(x.rlike(ISO), seconds_of(*[_part(x, ISO, i) for i in range(1, 7)])), named)


def parse_slashed(x: Column) -> Column:
    """Day before month."""
    return F.when(x.rlike(SLASHED), seconds_of(_part(x, SLASHED, 3), _part(x, SLASHED, 2), _part(x, SLASHED, 1), _part(x, SLASHED, 4), _part(x, SLASHED, 5)))


def parse_hrs_at(x: Column) -> Column:
    return F.when(x.rlike(HRS_AT), seconds_of(_part(x, HRS_AT, 5), _part(x, HRS_AT, 4), _part(x, HRS_AT, 3), _part(x, HRS_AT, 1), _part(x, HRS_AT, 2)))


def parse_date_at_hrs(x: Column) -> Column:
    return F.when(x.rlike(DATE_AT_HRS), seconds_of(_part(x, DATE_AT_HRS, 3), _part(x, DATE_AT_HRS, 2), _part(x, DATE_AT_HRS, 1), _part(x, DATE_AT_HRS, 4), _part(x, DATE_AT_HRS, 5)))


def parse_time_only(x: Column) -> Column:
    """Minutes of the day."""
    h, m = _part(x, TIME_ONLY, 1).try_cast("int"), _part(x, TIME_ONLY, 2).try_cast("int")
    return F.when(x.rlike(TIME_ONLY) & (h < 24) & (m < 60), h * 60 + m)


def alongside_day(x: Column) -> Column:
    """Days since 1970 of the date in an "alongside" line: `1 MARCH 2026`, `01/03/2026` or ISO."""
    named, slashed, iso = rf"(?i)(\d{{1,2}})\s+({MONTHS})[a-z]*\s+(\d{{4}})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{4})-(\d{2})-(\d{2})"
    zero = F.lit("0")
    one = F.when(x.rlike(named), seconds_of(_part(x, named, 3), month_number(_part(x, named, 2)).cast("string"), _part(x, named, 1), zero, zero))
    two = F.when(x.rlike(slashed), seconds_of(_part(x, slashed, 3), _part(x, slashed, 2), _part(x, slashed, 1), zero, zero))
    three = F.when(x.rlike(iso), seconds_of(_part(x, iso, 1), _part(x, iso, 2), _part(x, iso, 3), zero, zero))
    return F.floor(F.coalesce(one, two, three) / 86400).cast("long")


def parse_pumping_times(start: Column, end: Column, alongside: Column) -> Column:
    """struct(start_s, end_s, method, crossed): both ends by the first format that reads both; an end before its start gains a day."""
    pairs = [(name, f(start), f(end)) for name, f in (("ISO", parse_iso), ("US_DATE", parse_slashed), ("HRS_AT", parse_hrs_at), ("DATE_AT_HRS", parse_date_at_hrs))]
    day = alongside_day(alongside) * 86400
    pairs.append(("INHERITED", day + parse_time_only(start) * 60, day + parse_time_only(end) * 60))
    tried = F.array(*[F.struct(a.cast("long").alias("s"), b.cast("long").alias("e"), F.lit(n).alias("m")) for n, a, b in pairs])
    read = F.filter(tried, lambda t: t["s"].isNotNull() & t["e"].isNotNull())
    late = lambda t: F.coalesce(t["e"] < t["s"], F.lit(False))
    return let(F.get(read, F.lit(0)), lambda t: F.struct(t["s"].alias("start_s"), (t["e"] + F.when(late(t), 86400).otherwise(0)).alias("end_s"), F.coalesce(t["m"], F.lit("FAILED")).alias("method"), late(t).alias("crossed")))


def normalize_time_only(x: Column) -> Column:
    """HH:MM from HHMM, HHMM HRS or H:MM AM/PM; else as it was."""
    x = F.trim(x)
    hhmm, clock = r"^(\d{2})(\d{2})\s*(?:HRS|hrs|H)?$", r"^(\d{1,2}):(\d{2})\s*(AM|PM|am|pm)"
    h = _part(x, clock, 1).try_cast("int")
    pm = F.upper(_part(x, clock, 3)) == "PM"
    hour = F.when(pm & (h != 12), h + 12).when(~pm & (h == 12), 0).otherwise(h)
    return some(F.when(x.rlike(r"^\d{2}:\d{2}$"), x).when(x.rlike(hhmm), F.concat(_part(x, hhmm, 1), F.lit(":"), _part(x, hhmm, 2))).when(x.rlike(clock), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), _part(x, clock, 2))).otherwise(x))


_DATE = rf"(?i)^(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}|\d{{4}}[/-]\d{{2}}[/-]\d{{2}}|\d{{1,2}}\s+(?:{MONTHS})[a-z]*\s+\d{{4}}|(?:{MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}})"


def normalize_timestamp(x: Column) -> Column:
    """The date as written and the time as HH:MM by the number of its digits; else as it was."""
    flat = F.regexp_replace(F.trim(x), r"\s+", " ")
    flat = F.regexp_replace(flat, rf"(?i)^(\d{{1,2}})({MONTHS})[a-z]*(\d{{4}}).*$", "$1 $2 $3")

    def clock(d: Column) -> Column:
        n = F.length(d)
        return F.when(n == 0, "00:00").when(n == 1, F.concat(F.lit("0"), d, F.lit(":00"))).when(n == 2, F.concat(d, F.lit(":00"))).when(n == 3, F.concat(F.lit("0"), F.substring(d, 1, 1), F.lit(":"), F.substring(d, 2, 2))).otherwise(F.concat(F.substring(d, 1, 2), F.lit(":"), F.substring(d, 3, 2)))

    rest = lambda t, date: F.regexp_replace(F.substr(t, F.length(date) + 1), "[^0-9]", "")
    dated = lambda t, date: F.when(date != "", F.concat(date, F.lit(" "), let(rest(t, date), clock)))
    return F.coalesce(let(flat, lambda t: let(F.regexp_extract(t, _DATE, 1), lambda date: dated(t, date))), some(F.trim(x)))


def duration_hours(start: Column, end: Column) -> Column:
    """Hours between two times written `1 June 2024 14:30`; null for other forms."""
    form = r"^\d{1,2} (January|February|March|April|May|June|July|August|September|October|November|December) \d{4} \d{1,2}:\d{2}$"
    at = lambda x: F.when(x.rlike(form), F.unix_timestamp(F.try_to_timestamp(x, F.lit("d MMMM yyyy H:mm"))))
    return (at(end) - at(start)) / 3600.0


def to_utc(seconds: Column, timezone: Column, utc_offset: Column) -> Column:
    """Seconds of a wall-clock time in a zone, as UTC; by its offset where the zone is null."""
    local = F.timestamp_seconds(seconds)
    zoned = F.unix_timestamp(F.to_utc_timestamp(local, F.coalesce(timezone, F.lit("UTC"))))
    return F.when(timezone.isNotNull(), zoned).otherwise(seconds - F.coalesce(utc_offset, F.lit(0)) * 3600)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length of the sorted upper-case tokens; 0 where one is null."""
    tokens = lambda x: F.array_join(F.array_sort(F.split(F.trim(F.upper(x)), r"\s+")), " ")
    s, t = tokens(a), tokens(b)
    return F.coalesce(1 - F.levenshtein(s, t) / F.greatest(F.length(s), F.length(t), F.lit(1)), F.lit(0.0))


#: Letters of the first text that one number's bits can stand for, with room for a carry.
_BITS = 62


def _common_by_bits(s: Column, t: Column) -> Column:
    """Length of the longest common subsequence: a bit for each letter of s, all columns of the classic table in one sum a letter of t."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(s)) - 1
    places = F.transform(letters(s), lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def mask(c: Column) -> Column:
        return F.aggregate(F.filter(places, lambda x: x["c"] == c), F.lit(0).cast("bigint"), lambda m, x: m + F.call_function("shiftleft", F.lit(1).cast("bigint"), x["i"]))

    masks = F.map_from_entries(F.transform(F.array_distinct(letters(s)), lambda c: F.struct(c, mask(c))))

    def column(held: Column) -> Column:
        def step(v: Column, c: Column) -> Column:
            hit = v.bitwiseAND(F.coalesce(F.try_element_at(held["masks"], c), F.lit(0).cast("bigint")))
            return let(hit, lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(held["every"]))

        return F.length(s) - F.bit_count(F.aggregate(letters(t), held["every"], step))

    return let(F.struct(masks.alias("masks"), every.alias("every")), column)


def _common_by_rows(s: Column, t: Column) -> Column:
    """The same by dynamic programming over one row, for texts of any length."""
    letters = F.filter(F.split(t, ""), lambda c: c != "")
    start = F.transform(F.concat(F.array(F.lit("")), letters), lambda c: F.lit(0))

    def row(above: Column, ch: Column) -> Column:
        # One pass over the letters of t: the new row grows by max(left, above, diagonal + 1 on equal letters).
        return F.aggregate(
            F.sequence(F.lit(1), F.size(letters)),
            F.array(F.lit(0)),
            lambda done, j: F.concat(done, F.array(F.when(F.get(letters, j - 1) == ch, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(done, j - 1))))),
        )

    return F.element_at(F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, row), -1)


def indel_ratio(s: Column, t: Column) -> Column:
    """200 * longest common subsequence / total length."""
    n, m = F.length(s), F.length(t)
    common = F.when(n <= _BITS, _common_by_bits(s, t)).when(m <= _BITS, _common_by_bits(t, s)).otherwise(_common_by_rows(s, t))
    return F.when((n == 0) | (m == 0), F.when(n + m == 0, 100.0).otherwise(0.0)).otherwise(200.0 * common / (n + m))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The indel ratio of the sorted tokens; null counts as empty."""
    tokens = lambda x: F.array_join(F.array_sort(F.split(F.trim(F.coalesce(x, F.lit(""))), r"\s+")), " ")
    return let(F.struct(tokens(a).alias("s"), tokens(b).alias("t")), lambda x: indel_ratio(x["s"], x["t"]))
