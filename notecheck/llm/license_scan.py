"""License scans: MinHash bands over overlapping text windows find templates, exact containment verifies them.

Texts and templates are lower-cased (A-Z), cut at white space and ASCII punctuation, and turned into shingles of five words
(a template with fewer words is one shingle, as are its windows). Every run of `window` shingles of a template, or all of a
shorter one, is a template window; the windows of a text are all its runs of the same length. A window's MinHash signature has `bands` bands of `rows` minima; a
text window with Jaccard similarity J to a template window shares a band with probability 1 - (1 - J^rows)^bands, 0.99996 at
J = 0.8 with the defaults, and 1 for an equal window. A template that shares a band is a candidate at that place; so is, where
its shingles stand, one of which the text holds enough shingles in all: texts shorter than a window and windows broken by inserted words
share no band for certain. Candidates are verified by the exact share of their shingles found in the text, `containment` at least,
within the template's length / `containment` + `slack` shingles. A shingle met again begins another place.

A signature's minimum is the hash of one of the window's shingles, so a window none of whose shingles stands in a template
cannot share a band: only windows around known shingles are hashed, whatever the length of the text.

`templates` are a parameter of at most MAX_TEMPLATES texts, sent with the task. Nothing is shuffled.

Nulls and edges: null and empty texts match nothing; doc_ids are kept as they are, null and repeated ones too; several places
of one template in a text are several rows, overlapping ones one row (the best; of ties the longer, then the first); a text with several templates has a row
each; a very long text costs one pass and the windows around known shingles; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shingle_hashes, word_hashes
from .license_texts import TEMPLATES

MAX_TEMPLATES = 10_000
K = 5
SCHEMA = "doc_id string, license string, containment double, start_word int, end_word int"

@dataclass(frozen=True)
class ScanParams:
    window: int = 12
    bands: int = 10
    rows: int = 2
    containment: float = 0.8
    slack: int = 16
    seed: int = 5


class TemplateIndex:
    """Bands of all template windows, by window length."""

    def __init__(self, templates: dict[str, str], params: ScanParams):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"at most {MAX_TEMPLATES} templates")
        self.p = params
        self.salts = np.random.default_rng(params.seed).integers(1, 2**63, params.bands * params.rows, dtype=np.uint64)
        self.names = sorted(templates)
        self.sets, self.bands = [], {}
        for t, name in enumerate(self.names):
            words = word_hashes(templates[name], True, plain=True)
            shingles = shingle_hashes(words, K)
            self.sets.append((*np.unique(shingles, return_counts=True), len(words)))
            width = min(params.window, len(shingles))
            if not width:
                continue
            by_key = self.bands.setdefault((min(K, len(words)), width), {})
            for row in self.signatures(shingles, width):
                for key in row.tolist():
                    by_key.setdefault(key, set()).add(t)
        self.known = {k: np.unique(np.concatenate([s for s, _, n in self.sets if len(s) and min(K, n) == k])) for k in {k for k, _ in self.bands}}
        self.holders: dict[tuple[int, int], list[int]] = {}
        for t, (own, _, n) in enumerate(self.sets):
            for x in own.tolist():
                self.holders.setdefault((min(K, n), x), []).append(t)

    def signatures(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """A row per window of `width` shingles, with a key per band."""
        mins = []
        for salt in self.salts:
            x = mix(shingles ^ salt)
            span = 1
            while span < width:  # doubling: minima of runs of `span`
                step = min(span, width - span)
                x = np.minimum(x[:-step], x[step:])
                span += step
            mins.append(x)
        m = np.stack(mins, 1).reshape(len(mins[0]), self.p.bands, self.p.rows)
        with np.errstate(over="ignore"):
            key = np.full(m.shape[:2], np.uint64(width)) + np.arange(self.p.bands, dtype=np.uint64)
            for r in range(self.p.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
        return key

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """license, containment, first word, word after the last, for every place."""
        words = word_hashes(text, True, plain=True)
        found: list[tuple[str, float, int, int]] = []
        for k, known in self.known.items():
            shingles = shingle_hashes(words, k, whole_if_short=False)
            if not len(shingles):
                continue
            at = np.searchsorted(known, shingles)
            hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == shingles)
            if not len(hits):
                continue
            places: dict[int, list[int]] = {}
            for (kk, width), by_key in self.bands.items():
                if kk != k:
                    continue
                starts = np.unique((hits[:, None] - np.arange(width)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts + width <= len(shingles))]
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    if len(run):
                        for s, row in zip(run.tolist(), self.signatures(shingles[run[0] : run[-1] + width], width), strict=True):
                            for t in set().union(*(by_key.get(key, ()) for key in row.tolist())):
                                places.setdefault(t, []).append(s)
            standing: dict[int, list[int]] = {}
            for s in hits.tolist():
                for t in self.holders[k, int(shingles[s])]:
                    standing.setdefault(t, []).append(s)
            for t, at_t in standing.items():
                if len(at_t) >= self.p.containment * len(self.sets[t][0]):
                    places.setdefault(t, []).extend(at_t)
            for t, starts_t in places.items():
                found += self._verify(t, sorted(set(starts_t)), shingles, k)
        return sorted(found, key=lambda x: (x[2], x[0]))

    def _verify(self, t: int, starts: list[int], shingles: np.ndarray, k: int) -> Iterator[tuple[str, float, int, int]] | list:
        own, times, n_words = self.sets[t]
        reach = max(1, n_words - k + 1)
        span = int(np.ceil(reach / self.p.containment)) + self.p.slack
        out, done = [], 0
        groups = np.split(np.array(starts), np.flatnonzero(np.diff(starts) > span) + 1)
        for g in groups:
            lo, hi = max(int(g[0]) - span, done), min(len(shingles), int(g[-1]) + 2 * span)
            if lo >= hi:
                continue
            part = shingles[lo:hi]
            inside = np.flatnonzero(np.isin(part, own))
            which, at = np.searchsorted(own, part[inside]).tolist(), inside.tolist()

            def place(i: int) -> tuple[float, int, int, int]:
                """Share, length (negative), first and last shingle of what begins at the i-th own shingle here."""
                seen: dict[int, int] = {}
                last = at[i]
                for j in range(i, len(at)):
                    w = which[j]
                    if at[j] >= at[i] + span or seen.get(w, 0) >= times[w]:
                        break
                    if w not in seen:
                        last = at[j]
                    seen[w] = seen.get(w, 0) + 1
                return len(seen) / len(own), at[i] - last, at[i], last

            i = 0
            while i < len(at):
                best = place(i)
                if best[0] < self.p.containment:
                    i += 1
                    continue
                # The best of those that begin before this one ends.
                end = best[3]
                i += 1
                while i < len(at) and at[i] <= end:
                    best = max(best, place(i), key=lambda x: x[:2])
                    i += 1
                out.append((self.names[t], float(best[0]), lo + best[2], lo + best[3] + k))
                done = lo + best[3] + 1
                i = int(np.searchsorted(inside, best[3] + 1))
        return out


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, params: ScanParams = ScanParams()) -> DataFrame:
    """doc_id, license, containment, start_word, end_word (words as cut here) for every place of a template in a text."""
    index = TemplateIndex(TEMPLATES if templates is None else templates, params)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(b["doc_id"], b["text"], strict=True) for x in index.scan(t)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # Ids travel as text: pandas would turn a column of longs with a null into doubles.
    kind = documents.schema["doc_id"].dataType
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(scan, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))
