"""Chroma audio fingerprints of a media column, and the alignment of recordings.

1. A recording (WAV, 8 or 16 bit PCM, mono) becomes frames of FRAME samples, HOP apart; each frame's spectrum is folded into 12
   pitch classes and scaled to sum 1.
2. Over the integral image of a recording's frames, 16 filters compare sums of two sets of rectangles, WIDTH frames wide;
   each gives 2 bits, Gray-coded, and the filters together a 32-bit code per position. Shorter recordings are repeated to WIDTH frames.
3. Recordings with equal codes are one class. Each class sends its positions to the index, marking as landmarks the codes whose
   hash is the least of any run of `run` positions. Of a run of equal codes its first and last position stand for all.
4. Queries ask for every position's code, also with any of its `weak` least certain bits flipped; those of fewer than `run` codes meet
   all positions, others the landmarks. So a common run of `run` codes, or of a shorter query, always meets.
5. Every offset met is tried: over an overlap of `overlap` positions, or the shorter recording if it has fewer, the share of
   differing bits must not exceed `error` (in proportion less where the overlap is below `full`, as few bits agree by chance). Of those that pass, the offset with most votes (then least error, nearest to 0, the smaller)
   aligns the two. One vote is enough: overlap and error decide.

Classes keep a group of equal recordings of any size to one row of the join; a frequent code, and a class of many recordings, are
split over tasks. What comes out of the search grows with the pairs of query classes and recordings that share a passage.

Nulls and edges: null, empty or unreadable media have no codes, no class and no match; a recording without sound has codes like any
other but no landmarks; null ids are kept as they are and never queries; repeated rows are members of one class; a very long
recording is measured BLOCK frames at a time and has a code per HOP samples like any other; ties between offsets are broken as in
step 5, ties between queries by error, votes, then the query's ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_split, materialize, mix, words

RATE, FRAME, HOP, WIDTH = 2000, 256, 64, 16
STEP_ROWS = 200  # rows that a task works on together before it sends what it made on
BLOCK = 4096  # frames whose spectra are in memory at once
UNIT = 1 << 16  # the energy of a frame, in whole parts: sums are exact, so codes do not depend on what is measured together


@dataclass(frozen=True)
class PrintParams:
    run: int = 8
    error: float = 0.25
    overlap: int = 8
    full: int = 16  # overlaps from which the whole of `error` is allowed
    weak: int = 4


def to_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """8-bit mono PCM."""
    raw = np.clip(samples * 127 + 128, 0, 255).astype(np.uint8).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(raw)) + raw


def from_wav(media: object) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] and the rate; none for what is not mono PCM of 8 or 16 bits."""
    nothing = (np.empty(0, np.float32), RATE)
    if not isinstance(media, (bytes, bytearray)) or len(media) < 44 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return nothing
    at, kind = 12, None
    while at + 8 <= len(media):
        name, size = bytes(media[at : at + 4]), struct.unpack("<I", media[at + 4 : at + 8])[0]
        body = bytes(media[at + 8 : at + 8 + size])
        if name == b"fmt " and len(body) >= 16:
            kind = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and kind and kind[:2] == (1, 1) and kind[5] in (8, 16):
            x = np.frombuffer(body, np.uint8).astype(np.float32) / 128 - 1 if kind[5] == 8 else np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
            return x, kind[2]
        at += 8 + size + size % 2
    return nothing


_HANN = np.hanning(FRAME).astype(np.float32)


_FOLDS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _fold(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins of the spectrum from 60 to 900 Hz in the order of their pitch class, where each class present begins, and these classes."""
    if rate not in _FOLDS:
        hz = np.fft.rfftfreq(FRAME, 1 / rate)
        use = np.flatnonzero((hz >= 60) & (hz <= 900))
        pitch = np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12
        order = np.argsort(pitch, kind="stable")
        present, starts = np.unique(pitch[order], return_index=True)
        _FOLDS[rate] = use[order], starts, present
    return _FOLDS[rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12), whole numbers; rows of sum UNIT but for rounding, or of zeros in silence."""
    bins, starts, present = _fold(rate)
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.zeros((len(views), 12), np.int64)
    if not len(bins):
        return out
    for lo in range(0, len(views), BLOCK):
        spectrum = np.fft.rfft(views[lo : lo + BLOCK] * _HANN)[:, bins]
        energy = np.add.reduceat(spectrum.real**2 + spectrum.imag**2, starts, axis=1)
        total = energy.sum(1, keepdims=True)
        out[lo : lo + BLOCK, present] = np.rint(UNIT * np.where(total > 1e-3, energy / np.maximum(total, 1e-9), 0))
    return out


def filter_bank() -> list[list[tuple[int, int, int, int, int]]]:
    """16 filters, each a list of (sign, frame from, frame to, class from, class to); built from a rule.

    The i-th filter stands on four pitch classes from 3 * (i % 4) and compares, by i // 4: early and late halves, low and high
    pairs, the two diagonals, and the middle with both ends.
    """
    out = []
    for i in range(16):
        y, h = 3 * (i % 4), WIDTH // 2
        a, b, c = y, min(12, y + 2), min(12, y + 4)
        if i // 4 == 0:
            out.append([(1, 0, h, a, c), (-1, h, WIDTH, a, c)])
        elif i // 4 == 1:
            out.append([(1, 0, WIDTH, a, b), (-1, 0, WIDTH, b, c)])
        elif i // 4 == 2:
            out.append([(1, 0, h, a, b), (1, h, WIDTH, b, c), (-1, h, WIDTH, a, b), (-1, 0, h, b, c)])
        else:
            out.append([(1, h // 2, h + h // 2, a, c), (-1, 0, h // 2, a, c), (-1, h + h // 2, WIDTH, a, c)])
    return out


_BANK = filter_bank()
_STEP = 0.35


def codes(samples: np.ndarray, rate: int) -> np.ndarray:
    """A uint32 per position."""
    return measure([(samples, rate)])[0][0]


def measure(sounds: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the sounds (samples, rate): a uint32 per position, and (positions, 32): how far each bit's level is from where the
    bit changes, highest bit first. Sounds of one rate stand one after the other in one buffer, so that numpy works on long arrays."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint32), np.empty((0, 32), np.float32))] * len(sounds)
    for rate in sorted({r for x, r in sounds if len(x)}):
        which = [i for i, (x, r) in enumerate(sounds) if len(x) and r == rate]
        padded = [x if len(x) >= FRAME else np.resize(x, FRAME) for x in (sounds[i][0] for i in which)]
        starts = np.concatenate(([0], np.cumsum([-(-len(x) // HOP) for x in padded])))
        buffer = np.zeros(starts[-1] * HOP + FRAME, np.float32)
        for at, x in zip(starts, padded, strict=False):
            buffer[at * HOP : at * HOP + len(x)] = x
        heard = chroma(buffer, rate)
        sizes = [(len(x) - FRAME) // HOP + 1 for x in padded]
        frames = np.concatenate([heard[at + np.arange(max(n, WIDTH)) % n] for at, n in zip(starts, sizes, strict=False)])
        found, margins = _filtered(frames)
        base = 0
        for i, n in zip(which, sizes, strict=True):
            n = max(n, WIDTH)
            out[i] = found[base : base + n - WIDTH + 1], margins[base : base + n - WIDTH + 1]
            base += n
    return out


def _filtered(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and margins at all positions of (frames, 12)."""
    image = np.zeros((len(frames) + 1, 13), np.int64)
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    n = len(frames) - WIDTH + 1
    out, margins = np.zeros(n, np.uint32), np.empty((n, 32), np.float32)
    high = np.exp(_STEP)
    for f, parts in enumerate(_BANK):
        plus, minus = np.full(n, UNIT // 100), np.full(n, UNIT // 100)
        for sign, t0, t1, y0, y1 in parts:
            area = image[t1 : t1 + n, y1] - image[t0 : t0 + n, y1] - image[t1 : t1 + n, y0] + image[t0 : t0 + n, y0]
            if sign > 0:
                plus += area
            else:
                minus += area
        quarter = (plus * high > minus).astype(np.uint32) + (plus > minus) + (plus > minus * high)
        out = (out << np.uint32(2)) | (quarter ^ (quarter >> 1)).astype(np.uint32)
        level = np.log(plus / minus)
        margins[:, 2 * f], margins[:, 2 * f + 1] = np.abs(level), np.abs(np.abs(level) - _STEP)
    return out, margins


def weak_bits(margins: np.ndarray, weak: int) -> np.ndarray:
    """(positions * weak): the numbers of each position's least certain bits (0: the lowest bit), least certain first."""
    return (31 - np.argsort(margins, 1, kind="stable")[:, :weak]).astype(np.int8).ravel()


def positions(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last position of each run of equal codes, and for every position the number of its run; silence has none."""
    edge = found[1:] != found[:-1]
    runs = np.concatenate(([0], edge.cumsum()))
    at = np.flatnonzero(np.concatenate(([True], edge)) | np.concatenate((edge, [True])))
    return at[found[at] != SILENT], runs


def landmarks(found: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and whether their code has the least hash of any run of `run` positions."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, bool)
    order = mix(found.astype(np.uint64))
    windows = np.lib.stride_tricks.sliding_window_view(order, min(run, len(found)))
    at, runs = positions(found)
    return at, np.isin(runs[at], runs[np.unique(windows.argmin(1) + np.arange(len(windows)))])


#: The code of silence.
SILENT = codes(np.zeros(FRAME, np.float32), RATE)[0]


def probes(found: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codes to ask for: each code with every set of its weak bits flipped. bits: as weak_bits() gives them."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    at, _ = positions(found)
    each = np.uint32(1) << bits.reshape(len(found), -1)[at].astype(np.uint32)
    flips = np.zeros((len(at), 1), np.uint32)
    for k in range(each.shape[1]):
        flips = np.concatenate((flips, flips ^ each[:, k : k + 1]), 1)
    return np.repeat(at, flips.shape[1]), (found[at][:, None] ^ flips).ravel()


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of STEP_ROWS rows at most: what a task makes of them is much larger than they are."""
    for b in batches:
        for lo in range(0, len(b), STEP_ROWS):
            yield b.iloc[lo : lo + STEP_ROWS]


def fingerprint(recordings: DataFrame, ids: list[str], params: PrintParams = PrintParams()) -> DataFrame:
    """ids, codes (array of int, the 32 bits of each) and weak (their weak_bits) for every row of recordings (ids, media)."""
    weak = params.weak

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            out = part[[f"__{c}" for c in ids]].copy()
            made = measure([from_wav(x) for x in part["media"]])
            out["codes"], out["weak"] = [c.view(np.int32) for c, _ in made], [weak_bits(m, weak) for _, m in made]
            yield out

    sent = recordings.select(*[F.col(c).cast("string").alias(f"__{c}") for c in ids], "media")
    kinds = {c: recordings.schema[c].dataType for c in ids}
    return sent.mapInPandas(prints, ", ".join([*(f"__{c} string" for c in ids), "codes array<int>", "weak array<tinyint>"])).select(*[F.col(f"__{c}").cast(kinds[c]).alias(c) for c in ids], "codes", "weak")


def align(prints: DataFrame, ids: list[str], is_query: Column, params: PrintParams = PrintParams()) -> DataFrame:
    """One row per recording: ids, n_codes, class_<id> (its class's first member), matches (classes of queries that align with its class),
    best_<id>, best_offset, best_votes and best_error (the closest of them; offset: own position less the query's)."""
    names = [f"__id{i}" for i in range(len(ids))]
    keyed = prints.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(ids, names, strict=True)], "codes", "weak", is_query.alias("__asked")).withColumn("__key", F.when(F.size("codes") > 0, F.sha2(F.array_join("codes", ","), 256))).withColumn("__ask", F.coalesce("__asked", F.lit(False)) & F.col("__key").isNotNull())
    keyed = materialize(keyed.withColumn("weak", F.when(F.col("__ask"), F.col("weak"))).withColumn("__row", F.monotonically_increasing_id()), "audio-prints")
    klass = keyed.where("__key is not null").groupBy("__key").agg(F.min(F.struct(*names)).alias("__first"), F.max("__ask").alias("__asked"), F.first("codes").alias("codes"), F.min("weak").alias("weak")).withColumn("__c", F.monotonically_increasing_id())
    klass = materialize(klass, "audio-classes")
    run = params.run

    def rows_of(parts: list[tuple], kinds: dict[str, type]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate([np.empty(0, k), *(np.asarray(p[i]) for p in parts)]).astype(k) for i, (c, k) in enumerate(kinds.items())})

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in chunks(batches):
            parts = []
            for c, found in zip(b["__c"], b["codes"], strict=True):
                found = np.asarray(found, np.int32)
                at, mark = landmarks(found.view(np.uint32), run)
                parts.append((np.full(len(at), c), at, found[at], mark))
            yield rows_of(parts, {"r": np.int64, "pos": np.int32, "code": np.int32, "mark": np.bool_})

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in chunks(batches):
            parts = []
            for c, found, bits in zip(b["__c"], b["codes"], b["weak"], strict=True):
                found = np.asarray(found, np.int32).view(np.uint32)
                at, code = probes(found, np.asarray(bits, np.int8))
                parts.append((np.full(len(at), c), at, code.view(np.int32), np.full(len(at), len(found) < run)))
            yield rows_of(parts, {"q": np.int64, "q_pos": np.int32, "code": np.int32, "short": np.bool_})

    index = materialize(klass.select("__c", "codes").mapInPandas(marks, "r long, pos int, code int, mark boolean"), "audio-index")
    asked = klass.where("__asked").select("__c", "codes", "weak").mapInPandas(asks, "q long, q_pos int, code int, short boolean")
    voted = join_split(asked, index, ["code"]).where("q <> r and (mark or short)").groupBy("q", "r", (F.col("pos") - F.col("q_pos")).alias("offset")).agg(F.count(F.lit(1)).cast("int").alias("votes"))
    # At most as many offsets as the two recordings have positions.
    met = materialize(voted.groupBy("q", "r").agg(F.collect_list(F.struct("offset", "votes")).alias("__o")), "audio-aligned")
    one, two = klass.select(F.col("__c").alias("q"), F.col("codes").alias("q_codes"), F.col("__first").alias("q_first")), klass.select(F.col("__c").alias("r"), F.col("codes").alias("r_codes"))
    both = join_split(two, materialize(join_split(one, met, ["q"]), "audio-met"), ["r"]).select("q", "r", "q_codes", "r_codes", "q_first", F.inline("__o"))
    # Overlap of the query with the other recording, shifted by the offset.
    start = F.greatest(F.lit(0), -F.col("offset"))
    length = F.least(F.size("q_codes") - start, F.size("r_codes") - start - F.col("offset"))
    both = both.withColumn("overlap", length).where(F.col("overlap") >= F.least(F.lit(params.overlap), F.size("q_codes"), F.size("r_codes")))
    bits = F.aggregate(F.zip_with(F.slice("q_codes", start + 1, F.col("overlap")), F.slice("r_codes", start + F.col("offset") + 1, F.col("overlap")), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    heard = both.withColumn("error", bits / (32.0 * F.col("overlap"))).where(F.col("error") <= F.lit(params.error) * F.least(F.lit(1.0), F.col("overlap") / float(params.full)))
    heard = heard.groupBy("q", "r").agg(F.min_by(F.struct("q_first", "offset", "votes", "error"), F.struct(-F.col("votes"), "error", F.abs("offset"), "offset")).alias("x")).select("q", "r", "x.*")
    matched = heard.groupBy(F.col("r").alias("__r")).agg(F.count(F.lit(1)).alias("__m"), F.min_by(F.struct("q_first", "offset", "votes", "error"), F.struct("error", -F.col("votes"), "q_first")).alias("__b"))
    named = klass.select("__key", "__first", F.col("__c").alias("__r")).join(matched, "__r", "left").drop("__r")
    thin = keyed.select(*names, "__key", "__row", F.greatest(F.lit(0), F.size("codes")).alias("n_codes"))
    blank = thin.where("__key is null").select(*thin.columns, *[F.lit(None).cast(t).alias(c) for c, t in named.drop("__key").dtypes])
    every = join_split(named, thin.where("__key is not null"), ["__key"]).unionByName(blank)
    both_names = list(zip(ids, names, strict=True))
    return every.select(*[F.col(n).alias(c) for c, n in both_names], "n_codes", *[F.col(f"__first.{n}").alias(f"class_{c}") for c, n in both_names], F.coalesce("__m", F.lit(0)).alias("matches"), *[F.col(f"__b.q_first.{n}").alias(f"best_{c}") for c, n in both_names], F.col("__b.offset").alias("best_offset"), F.col("__b.votes").alias("best_votes"), F.col("__b.error").alias("best_error"))


_TONE = np.arange(HOP, dtype=np.float32) / RATE
_NOTES = np.stack([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * _TONE) for k in range(36)]).astype(np.float32)


_HISS = np.random.default_rng(7).normal(0, 1, 1 << 14).astype(np.float32)


def sonify(text: object, noise: float = 0.0) -> bytes | None:
    """A recording of a text: each word sounds two notes of three octaves, chosen by its hash, for HOP samples. Null: null.

    noise: its level; equal texts have equal noise.
    """
    from .common import word_hashes

    if not isinstance(text, str):
        return None
    w = word_hashes(text, False)
    sound = ((_NOTES[(w % np.uint64(36)).astype(int)] + _NOTES[((w >> np.uint64(32)) % np.uint64(36)).astype(int)]) / 2).ravel()
    if noise and len(sound):
        first = int(w.sum(dtype=np.uint64) % np.uint64(len(_HISS)))
        sound = sound + noise * np.take(_HISS, first + np.arange(len(sound)), mode="wrap")
    return to_wav(sound)


def recordings_of(turns: DataFrame, ids: list[str], noise: float = 0.0) -> DataFrame:
    """ids and media: a WAV for every row of turns (ids, text)."""

    @F.pandas_udf("binary")
    def media(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([sonify(t, noise) for t in b], dtype=object)

    return turns.select(*ids, media(F.col("text")).alias("media"))


def rolling_turns(conversations: DataFrame, lead: int = 40) -> DataFrame:
    """conv_id, turn, text: each turn after the last `lead` words of the turn before it, as a recorder that starts early hears it.

    Of turns that repeat a number, the least by text stands before the next.
    """
    turns = conversations.select("conv_id", "turn", "text")
    before = turns.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("__before"))
    tail = F.array_join(F.reverse(F.slice(F.reverse(words(F.col("__before"))), 1, lead)), " ")
    return turns.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("text").isNotNull() & F.col("__before").isNotNull(), F.concat_ws(" ", tail, "text")).otherwise(F.col("text")).alias("text"))
