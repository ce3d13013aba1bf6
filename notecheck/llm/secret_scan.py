"""Secret scan: fixed patterns, and the entropy of windows that slide over candidate strings. DataFrame functions only, no shuffle.

Base kinds are patterns: an assignment to a name like `token`, an access key, a long run of hex digits. The method adds spans: candidates
are runs of at least 16 letters, digits and `+/_-` with a letter and a digit; by its characters a candidate is hex, letters of one case
with digits, or mixed. A window of its class slides over it; the counts of its characters are kept up by one step in and one step out,
and with them the sum of c log2 c, in whole millionths, so that an entropy is exact wherever the window came from. The span runs from
the first to the last window with at least the class's bits. Suppressed are what an allow list names (identifiers, paths and dates
whose parts are letters and then digits, UUIDs, alphabets, placeholders), what follows a digest's name or stands in a URL,
and what lies within a base span.

A span counts code points, its end is exclusive. Matches of one pattern are found in turn, as a regular expression finds them; their
places come from running sums over the pieces between them, by doubling, so that texts with very many stay cheap.

Nulls and edges: a null text counts as empty and has no span; every row gives a row, repeated and null ids too; texts are scanned whole, however
long; spans of one start stand in the order of KINDS; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds' patterns and the least length of what they hold.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The same matches, found sooner: a name begins with one of few letters; a run of hex digits ends where its class ends.
_ASSIGN, _LONG_HEX = "(?=[pPsStTaA])" + ASSIGN, "[0-9a-f]{24,}+"

#: A maximal run with a digit; `=` only closes it.
RUN = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
UNIT = 1_000_000


@dataclass(frozen=True)
class CharClass:
    """Strings that fit the pattern, read in small letters if `fold`; a window of `window` characters with at least `bits` is a find."""

    kind: str
    pattern: str
    alphabet: str
    fold: bool
    window: int
    bits: float

    def most(self) -> int:
        """The largest sum of c log2 c at which a window still has the bits."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * UNIT)


CLASSES = (
    CharClass("entropy_hex", "^[0-9a-fA-F]+$", "0123456789abcdef", True, 16, 2.75),
    CharClass("entropy_alnum", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", True, 20, 3.4),
    CharClass("entropy_mixed", "", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-=", False, 20, 3.6),
)
ALLOWED = (
    "^[A-Za-z]*[0-9]*([-_/+][A-Za-z]*[0-9]*)*=*$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "(?i)0123456789|abcdefghij|qwertyuiop|example|sample|dummy|placeholder|xxxx",
)
#: What stands directly before, in as many characters.
BEFORE, BEFORE_CHARS = "(?i)((sha-?[0-9]{1,3}|md5|checksum|integrity|etag|commit|uuid)[\"']?[\\x20:=-]{1,3}[\"']?|base64,|://[^\\x20\\x09-\\x0D\"'<>]*)$", 64
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))


@dataclass(frozen=True)
class SecretParams:
    classes: tuple[CharClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    before: str = BEFORE


def _running(steps: Column) -> Column:
    """Running sums of an array: each pass adds what stands 1, 2, 4, ... places before."""
    jumps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), F.size(steps)))).cast("int")), lambda d: F.pow(F.lit(2), d).cast("int"))
    return F.aggregate(jumps, steps, lambda sums, d: F.transform(sums, lambda v, i: v + F.when(i >= d, F.get(sums, i - d)).otherwise(F.lit(0).cast("bigint"))))


def _steps(found: str, pieces: str) -> Column:
    return F.transform(F.col(found), lambda x, i: (F.length(x) + F.length(F.get(F.col(pieces), i))).cast("bigint"))


def _spans(found: str, pieces: str, ends: str) -> Column:
    """start, end, text and what stands before, of each match."""
    return F.transform(
        F.col(found),
        lambda x, i: F.struct((F.get(F.col(ends), i) - F.length(x)).alias("start"), F.get(F.col(ends), i).alias("end"), x.alias("text"), F.substring(F.get(F.col(pieces), i), -BEFORE_CHARS, BEFORE_CHARS).alias("before")),
    )


def _windows(text: Column, of: CharClass) -> Column:
    """first and last: where the first window with enough bits begins and the last one ends; null without any."""
    table = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("bigint") for c in range(of.window + 1)])
    letters = F.regexp_extract_all(F.lower(text) if of.fold else text, F.lit("."), F.lit(0))
    codes = F.transform(letters, lambda c: F.instr(F.lit(of.alphabet), c) - 1)
    zero = F.struct(
        codes.alias("codes"), F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def step(s: Column, i: Column) -> Column:
        into, out = F.get(s["codes"], i), F.get(s["codes"], i - of.window)
        n_out = F.get(s["counts"], out)
        n_in = F.get(s["counts"], into) - F.when(into == out, 1).otherwise(0)
        gone = F.when(out.isNotNull(), F.get(table, n_out - 1) - F.get(table, n_out)).otherwise(F.lit(0).cast("bigint"))
        total = s["sum"] + gone + F.get(table, n_in + 1) - F.get(table, n_in)
        hot = (i >= of.window - 1) & (total <= of.most())
        counts = F.transform(s["counts"], lambda v, k: v + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
        return F.struct(s["codes"].alias("codes"), counts.alias("counts"), total.alias("sum"), F.coalesce(s["first"], F.when(hot, i - (of.window - 1))).alias("first"), F.when(hot, i + 1).otherwise(s["last"]).alias("last"))

    every = F.sequence(F.lit(0), F.length(text) - 1)
    return F.aggregate(every, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _judged(run: Column, params: SecretParams) -> Column:
    """kind, first and last of a candidate that is not allowed."""
    ok = run["text"].rlike("[A-Za-z]") & ~run["before"].rlike(params.before)
    for pattern in params.allowed:
        ok = ok & ~run["text"].rlike(pattern)
    kinds = [F.when(ok & run["text"].rlike(c.pattern), F.lit(i)) for i, c in enumerate(params.classes)]
    return F.struct(run["start"].alias("start"), run["text"].alias("text"), F.coalesce(*kinds).alias("class"))


def find_secrets(documents: DataFrame, keep: list[str], params: SecretParams = SecretParams(), text: str = "text") -> DataFrame:
    """The `keep` columns of every row and `spans`: start, ord (the place in KINDS), end and kind, in order."""
    patterns = {"assign": _ASSIGN, "access": ACCESS, "hex": _LONG_HEX, "run": RUN}
    rows = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kept = [f"k{i}" for i in range(len(keep))]
    rows = rows.select(*kept, "t", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()])
    # Few texts have a match; only they are cut into pieces.
    rows = rows.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).alias(f"p_{k}") for k, p in patterns.items()]).drop("t")
    rows = rows.select("*", *[_steps(f"m_{k}", f"p_{k}").alias(f"s_{k}") for k in patterns])
    rows = rows.select("*", *[F.when(F.size(f"m_{k}") > 0, _running(F.col(f"s_{k}"))).alias(f"e_{k}") for k in patterns])
    rows = rows.select(*kept, *[_spans(f"m_{k}", f"p_{k}", f"e_{k}").alias(k) for k in patterns])
    held = {"assign": lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)), "access": lambda x: F.length(x["text"]), "hex": lambda x: F.length(x["text"])}
    of = lambda k: F.transform(F.filter(F.col(k), lambda x: held[k](x) >= LEAST[k]), lambda x: F.struct(x["start"], F.lit(KINDS.index(k)).alias("ord"), x["end"]))
    rows = rows.select(*kept, F.sort_array(F.concat(of("assign"), of("access"), of("hex"))).alias("base"), F.transform("run", lambda r: _judged(r, params)).alias("runs"))
    rows = rows.select(*kept, "base", F.filter("runs", lambda r: r["class"].isNotNull()).alias("runs"))

    def measured(r: Column) -> Column:
        found = F.when(F.lit(False), F.lit(None))
        for i, c in enumerate(params.classes):
            found = F.when(r["class"] == i, _windows(r["text"], c)) if i == 0 else found.when(r["class"] == i, _windows(r["text"], c))
        return F.struct(r["start"].alias("start"), (r["class"] + len(LEAST)).alias("ord"), found.alias("w"))

    rows = rows.select(*kept, "base", F.filter(F.transform("runs", measured), lambda r: r["w"]["first"].isNotNull()).alias("hot"))
    hot = F.transform("hot", lambda r: F.struct((r["start"] + r["w"]["first"]).alias("start"), r["ord"].alias("ord"), (r["start"] + r["w"]["last"]).alias("end")))
    rows = rows.select(*kept, "base", hot.alias("hot"))
    new = F.filter("hot", lambda h: ~F.exists("base", lambda b: (b["start"] <= h["start"]) & (h["end"] <= b["end"])))
    name = F.array(*[F.lit(k) for k in (*LEAST, *(c.kind for c in params.classes))])
    spans = F.transform(F.sort_array(F.concat("base", new)), lambda s: F.struct(s["start"], s["ord"], s["end"], F.get(name, s["ord"]).alias("kind")))
    return rows.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns, the base spans' numbers by kind, a SHA-256 of them, all spans as text, and how many the entropy added."""
    base = F.filter("spans", lambda s: s["ord"] < len(LEAST))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(*keep, *[count(k) for k in LEAST], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_entropy"))


def scan_secrets(documents: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every row of documents."""
    return digests(find_secrets(documents, ["doc_id"], params), ["doc_id"])


def redact(documents: DataFrame, column: str = "text", mark: str = "[secret]", params: SecretParams = SecretParams()) -> DataFrame:
    """The rows of documents with `mark` in place of each span of the column (of overlapping spans, of all they cover together)."""
    names = documents.columns
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{column}`").alias("__text"))
    found = find_secrets(row, ["__row"], params, "__text")
    # A span's part that no earlier span covers; spans wholly covered by earlier ones vanish.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        text = F.col(f"__row.`{column}`")
        fresh = x["start"] >= s["at"]
        piece = F.when(fresh, F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(piece)).alias("out"))

    end = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(f"__row.`{column}`"), (s["at"] + 1).cast("int"), F.lit(2147483647)))
    clean = found.select("__row", F.when(F.col(f"__row.`{column}`").isNotNull(), F.aggregate("spans", start, step, end)).alias("__clean"))
    return clean.select(*[F.col("__clean").alias(c) if c == column else F.col(f"__row.`{c}`").alias(c) for c in names])
