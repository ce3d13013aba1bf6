"""Toxicity: a learnt lexicon in a trie, met by a Levenshtein automaton, and context windows around each hit.

1. Lexicon. From a bounded sample of labelled documents, terms (whole words, and stems: the first 4 to 6 letters) are counted in
   toxic and in clean documents. A term is kept if it stands in at least `support` toxic documents, after as many different
   words (copies of one text have only one), and if its smoothed share of toxic documents, at the natural class shares, is at
   least `precision`; a stem answers for all words of the sample that begin with it. Of what a kept stem covers, only words and stems
   shorter than `fuzzy_from` are left out: they add no match.
2. Matching. Words are run through the intersection of the trie with the Levenshtein automaton: no edit for terms shorter than
   `fuzzy_from`, two for those of `far_from` letters or more, else one; an edit is a letter more, less or other, or two neighbours
   swapped. It is determinised as words need it. A stem fits the start of a word, with an edit before its last letter at most: an edit of
   the last letter would leave the next shorter stem, which step 1 judged itself. Words with marks inside (`id*ot`) and letters set apart
   (`i d i o t`) are also tried as one word.
3. Context. A hit between an opening and a closing quotation mark, SPAN characters apart at most, or just after a word of saying,
   counts as quoted; a mark without its partner means nothing. A window of `window` words around each hit sums the other abusive hits.
4. Score. Logistic regression over counts of exact, misspelt and quoted hits, the largest window sum and the hits per 100 words.

Fitting uses at most `per_class` documents of each class (chosen by a hash of doc_id), and of rows that repeat a doc_id the least text.
Every text is scored whole, whatever its length.

Nulls and edges: a null or empty text has no hits and gets the score of such texts; a null doc_id is never held out and never
labelled; null labels are not used; with no labels, or one class alone, every score is the smoothed share of class 1; repeated
rows are scored alike; a word that two terms match counts by the fewer edits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality_cnn import bounded_sample, held_out, labelled

TOKEN = re.compile(r"\w+")
SPAN = 400
QUOTED = re.compile("|".join([rf'(?:(?<=[\s(\[])|^)"(?=\S)[^"]{{1,{SPAN}}}?(?<=\S)"(?!\w)', *(rf"{a}[^{a}{b}]{{1,{SPAN}}}{b}" for a, b in ("“”", "„“", "«»"))]))
# A match takes whole runs of letters, so none is tried from within one; most texts lack a mark between letters.
MARKED = re.compile(r"(?<!\w)\w++(?:[*@$#!.+-]\w++)+")
MARK = re.compile(r"(?<=\w)[*@$#!.+-](?=\w)")
SPACED = re.compile(r"\b(?:\w[ .*_-]){3,}\w\b")
# Words of saying.
SAYING = frozenset("said says say saying quote quoted quotes called calls wrote word term sagte sagt nannte zitat wort dit disait cite citation mot dijo dice cita palabra".split())
FEATURES = ["exact", "misspelt", "quoted", "window", "rate"]


@dataclass(frozen=True)
class ToxicParams:
    folds: int = 3
    fold: int = 1
    per_class: int = 4000
    support: int = 3
    precision: float = 0.9
    fuzzy_from: int = 5
    far_from: int = 9
    window: int = 10
    seed: int = 23
    threshold: float = 0.7


class LexiconAutomaton:
    """The words within the edit limits of any term. States are sets of (trie node, edits, letter read before its turn), made when first needed."""

    MOST_STATES = 100_000
    MOST_WORDS = 200_000
    DONE = 1  # the node of a completed stem, whatever follows

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int, far_from: int = 9):
        self.words, self.stems, self.fuzzy_from, self.far_from = words, stems, fuzzy_from, far_from
        self._build()

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "fuzzy_from": self.fuzzy_from, "far_from": self.far_from}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._build()

    def allowed(self, term: str) -> int:
        return 0 if len(term) < self.fuzzy_from else 1 if len(term) < self.far_from else 2

    def _build(self) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        self.ends: list[int] = [-1, 2]  # edits allowed at a word's end
        self.stem: list[int] = [-1, -1]  # edits allowed at a stem's end
        self.below: list[int] = [0, 2]  # most edits allowed by any term below
        for term, is_stem in [*((w, False) for w in self.words), *((s, True) for s in self.stems)]:
            allowed = self.allowed(term)
            node = 0
            self.below[0] = max(self.below[0], allowed)
            for ch in term:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.stem.append(-1)
                    self.below.append(0)
                node = self.next[node][ch]
                self.below[node] = max(self.below[node], allowed)
            to = self.stem if is_stem else self.ends
            to[node] = max(to[node], allowed)
        self._clear()

    def _clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[int | None] = []  # edits of the best match if the word ends here
        self.stop: list[bool] = []  # a stem is complete without edits
        self.cache: dict[str, int | None] = {}
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """With letters of the term left out in the word; of one place only the fewest edits."""
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, edits, early = todo.pop()
            if edits > self.below[node] or edits >= best.get((node, early), 9):
                continue
            best[node, early] = edits
            if not early and node != self.DONE:
                todo += [(c, edits + 1, "") for c in self.next[node].values()]
        return frozenset((n, e, early) for (n, early), e in best.items())

    def _state(self, items: frozenset) -> int:
        found = self.states.get(items)
        if found is None:
            found = self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            hits = [e for n, e, early in items if not early and e <= self.ends[n]]
            self.final.append(min(hits) if hits else None)
            self.stop.append((self.DONE, 0, "") in items)
        return found

    def _move(self, state: int, ch: str) -> int:
        items: set[tuple[int, int, str]] = set()

        def reach(node: int, edits: int, read: bool) -> None:
            items.add((node, edits, ""))
            if read and edits <= self.stem[node]:
                items.add((self.DONE, edits, ""))

        for node, edits, early in self.sets[state]:
            if node == self.DONE:
                items.add((node, edits, ""))
                continue
            to = self.next[node].get(ch)
            if early:  # the letter that the last one stood before
                if to is not None and early in self.next[to]:
                    reach(self.next[to][early], edits, True)
                continue
            if to is not None:
                reach(to, edits, True)
            if edits < self.below[node]:
                items.add((node, edits + 1, ""))  # one letter too many
                for x, c in self.next[node].items():
                    if x != ch:
                        reach(c, edits + 1, False)  # another letter
                        if ch in self.next[c]:
                            items.add((node, edits + 1, ch))  # two letters swapped
        return self._state(self._closed(items)) if items else -1

    def match(self, word: str) -> int | None:
        """0: a term or a word with a known stem; 1, 2: so many edits away from one; None: neither."""
        if word in self.cache:
            return self.cache[word]
        if len(self.sets) > self.MOST_STATES or len(self.cache) > self.MOST_WORDS:
            self._clear()
        at, out = self.start, None
        for ch in word:
            to = self.moves[at].get(ch)
            if to is None:
                to = self.moves[at][ch] = self._move(at, ch)
            if to == -1 or not self.sets[to]:
                break
            at = to
            if self.stop[at]:
                out = 0
                break
        else:
            out = self.final[at]
        self.cache[word] = out
        return out


def tokens_of(text: str, lexicon: LexiconAutomaton) -> list[tuple[str, int, int | None]]:
    """Words with their place in the text and how they match; marked or spaced-out words that match stand for their parts."""
    whole: dict[int, tuple[int, str, int]] = {}
    for pattern in (MARKED, SPACED):
        for m in pattern.finditer(text):
            word = m[0] if pattern is MARKED else re.sub("[ .*_-]", "", m[0])
            if len(word) >= lexicon.fuzzy_from and (hit := lexicon.match(word)) is not None:
                whole.setdefault(m.start(), (m.end(), word, max(1, hit)))
    out, end = [], 0
    for m in TOKEN.finditer(text):
        if m.start() < end:
            continue
        if m.start() in whole:
            end, word, hit = whole[m.start()]
            out.append((word, m.start(), hit))
        else:
            out.append((m[0], m.start(), lexicon.match(m[0])))
    return out


def features(text: object, lexicon: LexiconAutomaton, window: int) -> tuple[float, ...]:
    """The FEATURES of a whole text."""
    text = text.lower() if isinstance(text, str) else ""
    # Most texts hold nothing; each of their different words is asked for once.
    plain = any(lexicon.match(w) is not None for w in set(TOKEN.findall(text)))
    tokens = tokens_of(text, lexicon) if plain or MARK.search(text) or SPACED.search(text) else []
    if all(hit is None for _, _, hit in tokens):
        return (0.0,) * len(FEATURES)
    spans = [m.span() for m in QUOTED.finditer(text)]
    starts, said, counts = [a for a, _ in spans], -(10**9), [0, 0, 0]
    found: list[tuple[int, int, bool]] = []
    n = len(tokens)
    for at, (word, place, hit) in enumerate(tokens):
        if word in SAYING:
            said = at
        if hit is not None:
            span = bisect_right(starts, place) - 1
            quoted = (span >= 0 and place < spans[span][1]) or at - said <= 3
            counts[2 if quoted else min(hit, 1)] += 1
            found.append((at, hit, quoted))
    abusive = [(at, 0.5 if m else 1.0) for at, m, quoted in found if not quoted]
    best, total, lo = 0.0, 0.0, 0
    for hi, (at, weight) in enumerate(abusive):
        total += weight
        while abusive[lo][0] < at - window:
            total -= abusive[lo][1]
            lo += 1
        best = max(best, total)
    return (float(np.log1p(counts[0])), float(np.log1p(counts[1])), float(np.log1p(counts[2])), best, min(10.0, 100 * sum(w for _, w in abusive) / n))


def learn_lexicon(sample: DataFrame, share: float, sizes: dict[int, int], params: ToxicParams) -> LexiconAutomaton:
    """sample: doc_id, label, text. share: of class 1 among all labelled rows; sizes: sampled documents by class."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple[str, int, int]] = []
            for label, text in zip(b["label"], b["text"], strict=True):
                seen: dict[str, str] = {}
                before = ""
                for w in TOKEN.findall(text.lower()) if isinstance(text, str) else []:
                    if len(w) >= 3:
                        seen.setdefault(w, before)
                        for k in (4, 5, 6):
                            if len(w) > k:
                                seen.setdefault(f"{w[:k]}*", before)
                    before = w
                rows += [(w, int(label), hash_of(x)) for w, x in seen.items()]
            yield pd.DataFrame(rows, columns=["term", "label", "before"])

    counted = sample.mapInPandas(terms, "term string, label int, before long").groupBy("term", "label", "before").agg(F.count(F.lit(1)).alias("n"))
    # Two steps, so that a frequent term's contexts are not gathered in one row.
    by_term = counted.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"), F.count_if(F.col("label") == 1).alias("contexts"))
    bad = F.col("bad") * (share / max(1, sizes.get(1, 0)))
    good = (F.col("good") + 0.1) * ((1 - share) / max(1, sizes.get(0, 0)))
    kept = by_term.where((F.col("bad") >= params.support) & (F.col("contexts") >= params.support) & (bad / (bad + good) >= params.precision))
    rows = kept.select("term").orderBy("term").collect()  # of the sample's terms, those that several of its documents hold
    return lexicon_of([r[0] for r in rows], params.fuzzy_from, params.far_from)


def lexicon_of(terms: list[str], fuzzy_from: int, far_from: int = 9) -> LexiconAutomaton:
    """terms: words, and stems with a `*`. A covered term stays if misspellings of it can be matched."""
    stems = sorted(t[:-1] for t in terms if t.endswith("*"))
    covered = tuple(stems)

    def adds(term: str, by: tuple[str, ...]) -> bool:
        return len(term) >= fuzzy_from or not term.startswith(by)

    return LexiconAutomaton([t for t in terms if not t.endswith("*") and adds(t, covered)], [s for s in stems if adds(s, tuple(x for x in covered if x != s))], fuzzy_from, far_from)


def hash_of(word: str) -> int:
    """A value that is the same in every process."""
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, keep = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * q * (1 - q))[:, None]).T @ x + np.diag(keep), x.T @ (weights * (q - y)) + keep * w)
        w = w - np.clip(step, -1, 1)
    return w


@dataclass
class ToxicModel:
    lexicon: LexiconAutomaton
    weights: np.ndarray
    window: int

    def probability(self, text: object) -> float:
        z = float(np.dot(features(text, self.lexicon, self.window), self.weights[:-1]) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(documents: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> ToxicModel | float:
    known = labelled(labels, "toxic", params.folds, params.fold)
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return share
    sizes = {k: min(v, params.per_class) for k, v in counts.items()}
    sample = materialize(bounded_sample(documents, known, params.per_class, params.seed), "toxic-sample")
    lexicon = learn_lexicon(sample, share, sizes, params)
    window = params.window

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(int(y), *features(t, lexicon, window)) for y, t in zip(b["label"], b["text"], strict=True)], columns=["label", *FEATURES])

    seen = sorted(tuple(r) for r in sample.mapInPandas(measure, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).collect())
    y = np.array([r[0] for r in seen], float)
    if len(set(y)) < 2:
        return share
    natural = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return ToxicModel(lexicon, fit_logistic(np.array([r[1:] for r in seen]), y, natural), window)


def score_column(model: ToxicModel | float, text: Column) -> Column:
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.probability(t) for t in b], dtype="float64")

    return score(text)


def score_toxicity(documents: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents."""
    model = train(documents, labels, params)
    out = documents.select("doc_id", held_out(params.folds, params.fold).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
