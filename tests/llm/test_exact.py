"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notecheck.llm import audio_prints, chat, jaccard_join, license_scan, mixing, packing, quality_cnn, quality_rules, toxicity
from notecheck.llm.common import shingle_hashes, word_hashes
from notecheck.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def near_copies(seed, groups=12, size=9, words=60):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words)]
        if g % 3 == 0:
            base[10:40] = [f"common{i}" for i in range(30)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(words)] = f"e{rng.randrange(50)}"
            out.append(" ".join(t[: rng.choice([words, words, words - 4])]))
    return out


def brute_components(texts, k, num):
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("seed", "k", "num", "hot", "crowd"), [(1, 4, 85, 32, 64), (2, 5, 80, 3, 0), (3, 4, 70, 1, 1)])
def test_jaccard_components(spark, seed, k, num, hot, crowd):
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs, jaccard_join.JoinParams(k=k, num=num, hot=hot, crowd=crowd, small=4)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, k, num)


def families(seed, size):
    """Two families of near-equal texts around one stem, and texts that share only a passage with half of all."""
    rng, stem, out = random.Random(seed), [f"s{i}" for i in range(80)], []
    for tail in ("a", "b"):
        own = stem[:60] + [f"{tail}{i}" for i in range(20)]
        for _ in range(size):
            t = list(own)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(80)] = f"e{rng.randrange(9999)}"
            out.append(" ".join(t))
    shared = [f"c{i}" for i in range(6)]
    return out + [" ".join([f"u{j}x{i}" for i in range(20)] + shared) for j in range(2 * size)]


@pytest.mark.parametrize(("hot", "crowd"), [(32, 64), (4, 2), (500, 0)])
def test_jaccard_crowds(spark, hot, crowd, monkeypatch):
    from notecheck.llm import common

    monkeypatch.setattr(common, "SPLIT_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 25)
    texts = families(7, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs, jaccard_join.JoinParams(hot=hot, crowd=crowd, small=16)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 4, 85)


@pytest.mark.parametrize("own", [0, 400])
def test_jaccard_families(spark, own, monkeypatch):
    """Families make the pairs of all their regions, each once a family; with many own members a region stays alone."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = random.Random(own)
    who = [(i, rng.randrange(40, 60), rng.randrange(25) if i % 3 else 100 + i, 1 + (i % 5 == 0)) for i in range(60)]
    rows = [(g, i, n, c, rng.randrange(4), k) for g in range(9) for i, n, c, k in who if rng.random() < 0.85]
    rows += [(g, 1000 * (g + 1) + i, 50, 1000 * (g + 1) + i, 1, 1) for g in range(9) for i in range(own // 8)]
    members = spark.createDataFrame(rows, "g long, id long, n int, cell long, place int, kind int")
    crowds = jaccard_join._crowds(members, "t")
    plain = {(r.a, r.b) for r in jaccard_join._met(members, crowds, 85).collect()}
    got = [(r.a, r.b) for r in jaccard_join._met_in_families(members, crowds, 85, "t").collect()]
    families = jaccard_join._families(members, crowds, "t").select("family").distinct().count()
    assert plain and set(got) == plain and len(got) <= families * len(plain)
    assert families <= 4 if not own else families >= 1


def test_jaccard_frequent_pivots(spark, monkeypatch):
    """Regions of frequent shingles keep all rows, and only classes that fit their pivot in size come out of the join with it."""
    monkeypatch.setattr(jaccard_join, "_frequent", lambda p: p.groupBy("h").count().where("count > 20").select("h"))
    rng = random.Random(3)
    size = {i: rng.randrange(20, 200) for i in range(60)}
    rows = [(h, i, size[i], h) for i in size for h in range(40) if h < 2 or rng.random() < 0.1]
    shared = jaccard_join._regions(spark.createDataFrame(rows, "h long, id long, n int, rank int"))
    held = Counter(h for h, *_ in rows)
    assert sorted((r.h, r.id, r.n, r.rank) for r in shared.collect()) == sorted(r for r in rows if held[r[0]] > 1)
    assert {r.h for r in shared.where("pivot is null").collect()} == {h for h, c in held.items() if c > 20}
    first = {h: min(i for g, i, *_ in rows if g == h) for h in held}
    fit = lambda a, b: 100 * min(a, b) >= 85 * max(a, b)
    want = Counter((first[h], i) for h, i, *_ in rows if i != first[h] and fit(size[i], size[first[h]]))
    assert Counter((r.pivot, r.id) for r in jaccard_join._to_pivots(shared, 85).collect()) == want


def test_jaccard_rarest_first(spark, monkeypatch):
    """The order of whole sets is that of all their shingles, though those of one set do not go through the join."""
    seen, join = [], jaccard_join.join_split
    monkeypatch.setattr(jaccard_join, "join_split", lambda left, right, *a: seen.append((left, right)) or join(left, right, *a))
    rng = random.Random(5)
    sets = {i: rng.sample(range(50), 20) + [1000 * i + j for j in range(1, 1 + i % 7)] for i in range(1, 30)}
    full = spark.createDataFrame([(i, len(s), i % 4, h) for i, s in sets.items() for h in s], "id long, n int, cell long, h long")
    got = {(r.id, r.n, r.cell, r.h, r.c, r.place) for r in jaccard_join._rarest_first(full, 85).collect()}
    c, want = Counter(h for s in sets.values() for h in s), set()
    for i, s in sets.items():
        need = len(s) - -(-85 * len(s) // 100) + 1
        want |= {(i, len(s), i % 4, h, c[h], k) for k, h in enumerate(sorted(s, key=lambda h: (c[h], h))[:need]) if c[h] > 1}
    assert got == want and want
    assert seen[0][0].where("c = 1").isEmpty() and not {r.id for r in seen[0][1].select("id").distinct().collect()} >= set(sets)


def test_jaccard_firsts(spark, monkeypatch):
    """Of classes only the further rows are sent to the lowest hashes, which need no shuffle where those are few."""
    sent, small = [], jaccard_join._small
    monkeypatch.setattr(jaccard_join, "_small", lambda df: (df.columns == ["uid"] and sent.append(df.count())) or small(df))
    texts = [f"a{i} b c d{i} e f" for i in range(28)] + ["a3 b c d3 e f"] * 2
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i if i < 28 else 3 for i in range(30)} and sent == [2]


def test_jaccard_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, "x"), (2, "x"), (3, long + " y"), (None, "a b c d e f"), (4, "a b c d e f"), (5, None)]
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (None, None), (4, 4), (5, 5)}
    assert [r.n_shingles for r in got if r.doc_id is None] == [3] and sorted(r.n_shingles for r in got if r.doc_id == 1) == [1, 37]


def test_jaccard_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.component_id for r in QUERIES["op7_jaccard_join"](spark, SF).collect()}
    want = brute_components([r.text for r in docs], 4, 85)
    assert [got[r.doc_id] for r in docs] == [docs[i].doc_id for i in want]


def test_word_hashes():
    a = word_hashes("The  cat\n\tsat \u00e9t\u00e9 CAT", True)
    assert len(a) == 5 and a[1] == a[4] != a[0] and len(set(a.tolist())) == 4
    assert word_hashes("x" * 200_000 + " y", False)[1] == word_hashes("y", False)[0]
    assert len(shingle_hashes(a, 4)) == 2 and len(shingle_hashes(a[:2], 4)) == 1 and len(word_hashes(None, True)) == 0


def test_boundaries():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 30, 8))
        counts = rng.integers(1, 9, len(lengths))
        for k in (1, 2, 3):
            pad = lambda bs: sum(int(c) * (min(b for b in bs if b >= n) - int(n)) for n, c in zip(lengths, counts))  # noqa: E731,B023
            best = min(pad((*c, int(lengths[-1]))) for j in range(k) for c in itertools.combinations([int(x) for x in lengths[:-1]], j))
            assert pad(packing.optimal_boundaries(lengths, counts, k)) == best


def test_packing_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = packing.PackParams(max_len=500, buckets=5, budget=4000, shard_rows=7)
    got = packing.pack(docs, p).collect()
    sizes = Counter((r.batch_id, r.bucket_len) for r in got)
    assert all(n * b <= max(p.budget, b) for (_, b), n in sizes.items())
    assert len({(r.batch_id, r.slot) for r in got}) == len(got)
    full = Counter(b for (_, b), n in sizes.items() if n == max(1, p.budget // b))
    assert all(c - full[b] <= 1 for b, c in Counter(b for _, b in sizes).items())
    words = {r.doc_id: len(WORD.findall(r.text)) for r in docs.collect()}
    assert {i: sum(r.n_words for r in got if r.doc_id == i) for i in words} == words


def test_mix_targets(spark):
    rows = [(i, "w " * (1 + i % 7), None if s == 3 else "abc"[s]) for i, s in enumerate([0] * 2000 + [1] * 300 + [2] * 20 + [3] * 500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        x = by.setdefault(s, [0, r.target, r.source_size])
        x[0] += r.taken
        assert r.taken <= 3 * r.size
    total = sum(x[2] for x in by.values())
    assert by["c"][1] == 3 * by["c"][2] and abs(sum(x[1] for x in by.values()) - total) < 1e-6
    assert all(abs(x[0] - x[1]) <= 7 for x in by.values())


def test_license_places(spark):
    body = " ".join(f"w{i}" for i in range(300))
    text = f"{body} Released under the MIT License. {body} licensed under the APACHE license, version 2.0! {body}"
    got = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, body), (3, "licensed under the")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.start_word, r.end_word) for r in got] == [(1, "MIT-line", 300, 305), (1, "Apache-2.0-line", 605, 613)]
    notice = license_scan.TEMPLATES["GPL-notice"].split()
    notice[4] = "changed"
    near = license_scan.scan_licenses(spark.createDataFrame([(1, f"{body} {' '.join(notice)} {body}")], "doc_id long, text string")).collect()
    assert [(r.license, 0.8 <= r.containment < 1) for r in near] == [("GPL-notice", True)]


def test_license_cuts_and_insertions():
    index, rng = license_scan.TemplateIndex(license_scan.TEMPLATES, license_scan.ScanParams()), random.Random(8)
    got = index.scan("This work is licensed under the GNU General Public License, version")
    assert [(x[0], x[1]) for x in got] == [("GPL-3.0-line", 7 / 8)]
    tried = 0
    for n in range(600):
        name = rng.choice(sorted(license_scan.TEMPLATES))
        words = license_scan.TEMPLATES[name].split()
        own = set(shingle_hashes(word_hashes(license_scan.TEMPLATES[name], True, plain=True), 5).tolist())
        words = words[rng.randrange(3) : len(words) - rng.randrange(3)]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [f"new{n}"] * rng.randrange(1, 4)
        around = [f"x{i}" for i in range(rng.choice((0, 0, 40)))]
        text = " ".join(around + words + around)
        share = len(own & set(shingle_hashes(word_hashes(text, True, plain=True), 5, whole_if_short=False).tolist())) / len(own)
        best = max((x[1] for x in index.scan(text) if x[0] == name), default=0.0)
        tried += share >= 0.8
        assert best == (share if share >= 0.8 else 0.0), text
    assert tried > 150
    notice = license_scan.TEMPLATES["GPL-notice"]
    twice = index.scan(f"{notice.replace('Foundation', 'x')} {notice}")
    assert [x[0] for x in twice] == ["GPL-notice"] * 2


def edits(a, b):
    """Letters more, less, other, or neighbours swapped (and not edited again)."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def brute_license(text, template, p):
    """The largest share of the template's shingles in any run of the text as long as a match may be, trying every start."""
    own = set(shingle_hashes(word_hashes(template, True, plain=True), 5).tolist())
    words = word_hashes(template, True, plain=True)
    span = int(np.ceil(max(1, len(words) - min(5, len(words)) + 1) / p.containment)) + p.slack
    s = shingle_hashes(word_hashes(text, True, plain=True), min(5, len(words)), whole_if_short=False).tolist()
    return max((len(own & set(s[i : i + span])) / len(own) for i in range(len(s))), default=0.0)


def test_license_brute_force():
    """Every window and every template: edited copies of long texts are found just where their containment is reached."""
    p, rng = license_scan.ScanParams(), random.Random(21)
    index, names = license_scan.TemplateIndex(license_scan.TEMPLATES, p), sorted(license_scan.TEMPLATES)
    assert len(names) >= 30
    hits = missed = 0
    for n in range(150):
        words = license_scan.TEMPLATES[names[n % len(names)]].split()
        for _ in range(rng.randrange(1 + len(words) // 15)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(([f"e{n}"], [], [words[at], f"e{n}"], [words[at], "of", "the"]))
        around = [f"x{rng.randrange(500)}" for _ in range(rng.choice((0, 3, 60)))]
        text = " ".join(around + words + around)
        got = {}
        for name, share, *_ in index.scan(text):
            got[name] = max(share, got.get(name, 0))
        for name in names:
            best = brute_license(text, license_scan.TEMPLATES[name], p)
            assert got.get(name, 0) <= best + 1e-9
            hits += best >= p.containment
            missed += best >= p.containment and name not in got
    assert hits > 150 and missed <= hits * 0.01, (hits, missed)


def test_automaton():
    lex = toxicity.LexiconAutomaton(["idiot", "scum", "moron"], ["vequ"], 5)
    assert [lex.match(w) for w in ("idiot", "idiott", "idot", "idoit", "1diot", "scum", "scumm", "vequee", "vexuee", "moron", "mo", "")] == [0, 1, 1, 1, 1, 0, None, 0, None, 0, None, None]
    rng = random.Random(0)
    for terms, letters, most in ((["abcde", "abxyz", "bcdef", "abc"], "abcdefxyz", 8), (["abcabcabc", "acbacbacbb", "abcab"], "abc", 13)):
        lex = toxicity.LexiconAutomaton(terms, [], 5)
        for _ in range(4000):
            w = "".join(rng.choice(letters) for _ in range(rng.randrange(2, most)))
            if rng.random() < 0.5:
                t = list(rng.choice(terms))
                for _ in range(rng.randrange(3)):
                    t[rng.randrange(len(t))] = rng.choice([*letters, "", "aa"])
                w = "".join(t)
            near = [d for t in terms if (d := edits(w, t)) <= lex.allowed(t)]
            assert lex.match(w) == (min(near) if near else None), w


def plain_features(text, terms, window):
    """The features of a text for whole words, by edit distances and a scan of every window."""
    words = [(m[0], m.start()) for m in re.finditer(r"\w+", text.lower())]
    allowed = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    hits = []
    for i, (w, at) in enumerate(words):
        near = [d for t in terms if (d := edits(w, t)) <= allowed(t)]
        if near:
            open_ = text[:at].count("“") > text[:at].count("”")
            hits.append((i, min(near), open_ or any(x in toxicity.SAYING for x, _ in words[max(0, i - 3) : i + 1])))
    counts = [sum(not q and d == 0 for _, d, q in hits), sum(not q and d > 0 for _, d, q in hits), sum(q for _, _, q in hits)]
    free = [(i, 0.5 if d else 1.0) for i, d, q in hits if not q]
    best = max((sum(v for j, v in free if i - window <= j <= i) for i, _ in free), default=0.0)
    rate = min(10.0, 100 * sum(v for _, v in free) / len(words)) if hits else 0.0
    return (*(float(np.log1p(c)) for c in counts), best, rate)


def test_features_brute_force():
    rng, terms = random.Random(12), ["idiot", "scum", "disgusting", "clown"]
    lex = toxicity.LexiconAutomaton(terms, [], 5)
    pool = ["idiot", "idoit", "scum", "scun", "disgusting", "disgustnig", "clwon", "tree", "said", "river", "“stone”", "“clown idiot”", "of", "the"]
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))
        assert toxicity.features(text, lex, 10) == pytest.approx(plain_features(text, terms, 10)), text


def test_learnt_lexicon_misspellings(spark):
    rng, insults = random.Random(3), ["idiot", "stupid", "disgusting", "clown", "worthless"]
    rows = [(y, " ".join(f"w{rng.randrange(900)} {rng.choice(insults) if y else 'fine'}" for _ in range(12))) for y in (0, 1) * 60]
    sample = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, label int, text string")
    lex = toxicity.learn_lexicon(sample, 0.5, {0: 60, 1: 60}, toxicity.ToxicParams())
    assert [lex.match(w) for w in insults] == [0] * 5 and any("idiot".startswith(s) for s in lex.stems)
    for w in insults:
        for i in range(len(w)):
            assert lex.match(w[:i] + "0" + w[i + 1 :]) is not None and lex.match(w[:i] + w[i + 1 :]) is not None and lex.match(w[:i] + "0" + w[i:]) is not None
    assert [lex.match(w) for w in ("1diot", "fine", "ediiot", "w12")] == [1, None, None, None]


def test_stem_edits():
    lex = toxicity.LexiconAutomaton([], ["stupi"], 5)
    assert [lex.match(w) for w in ("stupidly", "stpidly", "sdupidest", "xstupid", "stup", "stupor", "stxxid", "stpi")] == [0, 1, 1, 1, None, None, None, 1]


def test_context():
    lex = toxicity.LexiconAutomaton(["idiot"], [], 5)
    of = lambda t: toxicity.features(t, lex, 10)
    open_, quoted = of("you idiot you idiot"), of('he said "idiot" then')
    assert open_[0] > 0 and open_[3] == 2 and quoted[0] == 0 and quoted[2] > 0
    # A lone mark quotes nothing; a pair far apart neither.
    assert of('a 5" pipe and you idiot you idiot you idiot')[3] == 3 and of('"you idiot' + " x" * 300 + '"')[0] > 0
    assert of('they wrote: "what an idiot" to me')[2] > 0 and of("« idiot »")[2] > 0
    assert of("you id*ot")[1] > 0 and of("you i d i o t")[1] > 0 and of("you i.d.i.o.t!")[1] > 0 and of("you idoit")[1] > 0
    assert of("")[0] == 0 and of(None) == (0.0,) * 5 and of("idiot " * 50_000)[4] == 10


def test_plain_convolution():
    """The network's logit by lookup tables and half chunks, against a plain convolution over every overlapping chunk."""
    p = quality_cnn.CnnParams(chunk=64, width=8, dims=3, filters=5, hidden=4)
    model, rng = quality_cnn.ByteCnn(p), random.Random(2)
    model.c[:] = np.random.default_rng(3).normal(0, 0.3, 5)

    def plain(text):
        raw = list(text.encode())
        raw += [0] * max(0, p.width + 1 - len(raw))
        n = -(-(len(raw) - p.width + 1) // quality_cnn.STRIDE)
        at = lambda j: np.concatenate([model.E[raw[j + i] if j + i < len(raw) else 0] for i in range(p.width)]) @ model.W
        y = np.array([at(j * quality_cnn.STRIDE) for j in range(n)])
        half = p.chunk // 2 // quality_cnn.STRIDE
        halves = [y[i : i + half].max(0) for i in range(0, n, half)]
        chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
        out = [np.maximum(np.maximum(c + model.c, 0) @ model.H + model.d, 0) @ model.o + model.e for c in chunks]
        return float(np.mean(out))

    for n in (1, 5, 8, 9, 31, 64, 65, 200, 32 * 64 - 1, 32 * 64, 32 * 64 + 1, 32 * 64 + 7, 5000):
        text = "".join(rng.choice("abcdefghij é") for _ in range(n))
        assert model.logit(text) == pytest.approx(plain(text), abs=1e-4), n


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.9), ("op9_quality_cnn", "quality", 0.9)])
def test_held_out(spark, name, label, least):
    d = "/root/testdata/sf0.1"
    x = QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", F.col(label).alias("y")).collect()
    s, y = np.array([r.score for r in x]), np.array([r.y for r in x])
    order = s.argsort().argsort() + 1.0
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc >= least
    folds, fold = (3, 1) if label == "toxic" else (5, 0)
    got = QUERIES[name](spark, SF).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in got)


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    got = {r.conv_id: r for r in QUERIES["op6_chat"](spark, SF).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    by = {-1: [("user", probe), ("assistant", probe)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.unescape(chat.escape("a\\<|\\n")) == "a\\<|\\n"


def test_rules_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    for r in docs:
        w = WORD.findall(r.text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in r.text), len(lines) - len(set(lines)), len(cover))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want


def test_rule_cutoffs(spark):
    good, bad = "plain words only here " * 10, "#loud! $noise! " * 20
    rows = [(i, f"{good}{i}" if i % 3 else f"{bad}{i} a b c", "en") for i in range(3000)]
    rows = [(i, " ".join(f"{w}{j}{i}" for j, w in enumerate(t.split())), s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(3000)], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 3 > 0) for r in got)
    few = quality_rules.quality_rules(docs, labels.limit(50)).collect()
    assert all(r.kept for r in few)  # too few labels for a guarantee


def test_fingerprints_of_noise():
    rng = np.random.default_rng(1)
    x = audio_prints.from_wav(audio_prints.sonify(" ".join(f"n{i}" for i in range(200))))[0]
    noisy = audio_prints.codes(x + rng.normal(0, 0.02, len(x)).astype(np.float32), 2000)
    clean, other = audio_prints.codes(x, 2000), audio_prints.codes(audio_prints.from_wav(audio_prints.sonify(" ".join(f"m{i}" for i in range(200))))[0], 2000)
    rate = lambda a, b: np.unpackbits((a ^ b).view(np.uint8)).mean()
    assert rate(clean, noisy) < 0.1 < 0.3 < rate(clean, other)


def aligned_pairs(spark, copies):
    """Share of wholes that some query matches, by kind, of copies (kind, query samples, whole samples)."""
    rows = [(2 * i + j, 0, audio_prints.to_wav(x)) for i, c in enumerate(copies) for j, x in enumerate(c[1:])]
    prints = audio_prints.fingerprint(spark.createDataFrame(rows, "a int, b int, media binary"), ["a", "b"])
    got = {r.a: r for r in audio_prints.align(prints, ["a", "b"], F.col("a") % 2 == 0).collect()}
    by = {}
    for i, c in enumerate(copies):
        by.setdefault(c[0], []).append(got[2 * i + 1].matches > 0 or got[2 * i + 1].class_a == 2 * i)
    return {k: sum(v) / len(v) for k, v in by.items()}


def test_audio_recall(spark):
    rng, copies = np.random.default_rng(4), []
    hop = audio_prints.HOP
    for i in range(20):
        x = audio_prints.from_wav(audio_prints.sonify(" ".join(f"r{i}n{k}" for k in range(90))))[0]
        cut = int(rng.integers(5, 40))
        copies.append(("clipped", x[cut * hop : (cut + 30) * hop], x))  # 12 codes
        copies.append(("short", x[cut * hop : (cut + 23) * hop], x))  # 5 codes
        copies.append(("one end", x[: 27 * hop], x[: 35 * hop]))
        copies.append(("noisy", x + rng.normal(0, 0.03, len(x)), x))
        copies.append(("short noisy", (y := x[: 22 * hop]) + rng.normal(0, 0.01, len(y)), y))
        tone = np.sin(2 * np.pi * (31.25 * (2 + i)) * np.arange(60 * hop) / audio_prints.RATE) * 0.9
        copies.append(("steady", tone[: 40 * hop], tone))
    got = aligned_pairs(spark, copies)
    assert min(got.values()) >= 0.9, got


def brute_aligned(a, b, p):
    """Whether some offset of b against a keeps within the error, by trying every one."""
    for off in range(1 - len(a), len(b)):
        lo = max(0, -off)
        n = min(len(a) - lo, len(b) - lo - off)
        if n >= min(p.overlap, len(a), len(b)) and np.unpackbits((a[lo : lo + n] ^ b[lo + off : lo + off + n]).view(np.uint8)).mean() <= p.error * min(1, n / p.full):
            return True
    return False


def test_audio_query_recall(spark):
    rng, p = random.Random(5), audio_prints.PrintParams()
    turns = [(c, t, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 90)))) for c in range(24) for t in range(5)]
    turns += [(30, 0, turns[0][2]), (31, 0, turns[0][2])]
    rolled = audio_prints.rolling_turns(spark.createDataFrame(turns, "conv_id long, turn long, text string"))
    media = audio_prints.recordings_of(rolled, ["conv_id", "turn"], noise=0.01)
    got = {(r.conv_id, r.turn): r for r in audio_prints.align(audio_prints.fingerprint(media, ["conv_id", "turn"]), ["conv_id", "turn"], F.col("conv_id") % 3 == 0).collect()}
    codes = {(r.conv_id, r.turn): audio_prints.measure([audio_prints.from_wav(bytes(r.media))])[0][0] for r in media.collect()}
    asked = {c.tobytes(): c for k, c in codes.items() if k[0] % 3 == 0}
    want = {k: sum(q != c.tobytes() and brute_aligned(x, c, p) for q, x in asked.items()) for k, c in codes.items()}
    assert all(got[k].matches <= want[k] for k in want)
    assert sum(want.values()) > 30 and sum(r.matches for r in got.values()) >= 0.9 * sum(want.values())
    long = [k for k in codes if k[0] % 3 == 0 and k[0] < 24 and 0 < k[1] and len(turns[k[0] * 5 + k[1] - 1][2].split()) >= 40]
    assert all(got[k].matches > 0 for k in long)
