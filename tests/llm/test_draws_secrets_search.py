"""Importance resampling, secret scan and lexical search against brute force, and their edges."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import pytest

from notecheck.llm import importance, lexical_search, secret_scan
from notecheck.llm.common import materialize

A_Z = str.maketrans({c: c.lower() for c in string.ascii_uppercase})
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, n long, t string, item long, k0 int, spans int, down int, rank int"
ITEMS = "item_id long, text string, doc_id long, uid int"
EXTRA = (None, 5, "clash", 6, 1, 2, 3, 4)


def plain_words(text):
    return WORDS.findall((text or "").translate(A_Z))


def texts(seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "İstanbul", "Kelvin", "UPPER", "x" * 90, "é" * 70 + "z"]
    out = [" ".join(rng.choice(vocabulary[: rng.choice([9, 60, 307])]) + rng.choice(["", ",", ".", "\n", "\t-"]) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 200]))) for _ in range(n)]
    return [*out, None, "", "\x00 -- !", "alone", out[3], out[3], "tok " * 3000 + "end"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS)


def drawn(rows, targets):
    """Plain Python, all rules of the contract."""

    def features(text):
        w = plain_words(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)

    seen = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(b for _, f, _ in seen for b in f), collections.Counter(b for x in targets for b in features(x)[0])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, f, n in seen:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    for place, o in enumerate(able[: 25 * len(able) // 100]):
        o[4] = place + 1
    return sorted(map(tuple, out), key=str)


def test_importance(spark):
    rows = list(enumerate(texts())) + [(7, "again " * 25), (7, "again " * 25), (None, "no id " * 30), (None, None)]
    targets = ["w1 w2 w3 Straße", None, "W5 again again"]
    target = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(targets)], ITEMS)
    got = importance.resample(documents(spark, rows), target)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(rows, targets)
    kept = importance.take_drawn(documents(spark, rows), target)
    assert kept.columns == documents(spark, rows).columns and 0 < kept.count() < len(rows)
    none = documents(spark, [])
    assert importance.resample(none, target).count() == 0
    assert sorted((tuple(r) for r in importance.resample(documents(spark, rows[:40]), target.where("false")).collect()), key=str) == drawn(rows[:40], [])


def test_importance_slices(spark, monkeypatch):
    rows = list(enumerate(texts(9, 40)))
    before = sorted(importance.bucket_counts(documents(spark, rows), 10_000).collect())
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(importance, "SLICE", 100)
    total = collections.Counter()
    for _, raw, offsets in importance._slices(pa.array([t for _, t in rows])):
        _, one, _, two = importance.feature_buckets(raw, offsets, 10_000)
        total.update(np.concatenate((one, two)).tolist())
    assert [tuple(r) for r in before] == sorted(total.items())


def test_kth_key(spark):
    """The selection finds the key of any place, with many ties, from chunks and medians of medians."""
    rng = random.Random(1)
    keys = [(rng.randint(-9, 9), rng.randint(0, 1), rng.randint(0, 5)) for _ in range(2000)]
    table = materialize(spark.createDataFrame(keys, "down long, last long, id long").repartition(3), "keys")
    for k in (1, 1400):
        assert importance.kth_key(table, k, few=40, chunk=30) == sorted(keys)[k - 1]
    assert importance.kth_key(table, 0) is None and importance.kth_key(table, 2001) is None


def found_secrets(text):
    """Plain Python: base spans by the contract's patterns, then every window counted anew."""
    text = text or ""
    any_case = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(f"(?:{any_case})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_-]{16,}={0,2}", text):
        run = m[0]
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or re.search(secret_scan.BEFORE, text[: m.start()][-64:]) or any(re.search(p, run) for p in secret_scan.ALLOWED):
            continue
        i, c = next((i, c) for i, c in enumerate(secret_scan.CLASSES) if re.search(c.pattern, run))
        run = run.lower() if c.fold else run
        bits = lambda x: math.log2(c.window) - sum(n * math.log2(n) for n in collections.Counter(x).values()) / c.window
        hot = [j for j in range(len(run) - c.window + 1) if bits(run[j : j + c.window]) >= c.bits - 1e-7]
        if hot:
            a, e = m.start() + hot[0], m.start() + hot[-1] + c.window
            if not any(b[0] <= a and e <= b[2] for b in out):
                more.append((a, 3 + i, e, c.kind))
    return sorted(out + more), len(more)


def secret_texts():
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed, capital, small = string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, "0123456789abcdef"
    out = [
        None, "", "token:token:abcdefgh", f'Api_Key = "AKIA{draw(capital, 16)}" é\U0001f600 AKIA{draw(capital, 16)} AKIA{draw(capital, 15)}', f"é\U0001f600 {draw(mixed, 40)} xx {draw(small, 20)} {draw(small, 23)} {draw(small, 24)} {draw(small.upper(), 32)}",
        f"sha256:{draw(small.upper(), 40)} https://h.org/a/{draw(mixed, 40)} 2024-01-15-how-to-install-things 123e4567-e89b-12d3-a456-426614174000 user123/img0001-old", "PASSWD=\"short\" secret=ab paſſword=abcdefgh KtoKen=abcdefgh toKEN=abcdefgh",
        " ".join(f"token={draw(mixed, 12)} {draw(mixed, 30)}" for _ in range(300)), draw(mixed, 2000) + "a" * 500 + draw(mixed, 50), "AKIA AKIAAKIA" + "A" * 30, "secret  =  'abc.def' key=Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg==", "0123456789abcdefGHIJKL", "zzzz1111zzzz1111zzzz1111",
    ]
    pick = [lambda: draw(mixed, rng.randint(5, 60)), lambda: draw(string.ascii_lowercase + string.digits, rng.randint(10, 40)), lambda: "token=" + draw(mixed, rng.randint(1, 9)), lambda: draw(small, rng.randint(15, 50)), lambda: "a/b-c_9" * 3]
    return out + [" ".join(rng.choice(pick)() for _ in range(15)) for _ in range(30)]


def test_secrets(spark):
    rows = list(enumerate(secret_texts())) + [(3, "token=repeated1"), (3, "token=repeated1"), (None, "token=withoutid")]
    join = lambda spans: ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in spans)
    want = []
    for i, text in rows:
        spans, more = found_secrets(text)
        base = [s for s in spans if s[1] < 3]
        n = collections.Counter(s[3] for s in base)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(spans), more))
    got = [tuple(r) for r in secret_scan.scan_secrets(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[6] for w in want) > 50 and {k for w in want for k in re.findall("entropy_[a-z]+", w[5])} == {c.kind for c in secret_scan.CLASSES}
    by = {w[0]: w[5] for w in want}
    assert by[2] == "" and by[5] == "" and by[11] == "" and by[12] == "" and by[6].count("assign") == 1
    assert secret_scan.scan_secrets(documents(spark, [])).count() == 0


def test_redact(spark):
    rows = [(1, "é token=abcdefgh x"), (2, None), (3, "plain"), (4, "secret: 0123456789abcdef01234567 0123456789abcdef01234567")]
    out = secret_scan.redact(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é [secret] x", 2: None, 3: "plain", 4: "[secret] [secret]"}


def ranking(rows, items, top=10):
    """Plain Python: every document's score for every item."""
    docs = [(i, collections.Counter(plain_words(t))) for i, t in rows]
    n, length, df = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs), collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(plain_words(text))
        scores = []
        for k, (i, c) in enumerate(docs):
            m = 25 + 75 * sum(c.values()) * n // max(1, length)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, place + 1, i, -score) for place, (score, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [lexical_search.SearchParams(), lexical_search.SearchParams(top=3, first=4, spread=3, leaders=3)])
def test_search(spark, params, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 60)
    rows = list(enumerate(texts())) + [(7, "w1 w2 twin"), (7, "w1 w2 twin"), (None, "w1 w9 orphan"), (500, "w1 w2 twin")]
    items = [(1, "w1 W2 w3, twin twin"), (2, None), (3, "unknownword"), (4, "orphan w250 w251 w252"), (1, "w1 W2 w3, twin twin"), (None, "Straße tok"), (6, " ".join(f"w{i}" for i in range(0, 300, 4)))]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    got = lexical_search.search(documents(spark, rows), asked, params)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranking(rows, items, params.top)


def test_search_edges(spark):
    docs, items = documents(spark, [(1, "a b")]), spark.createDataFrame([(1, "a", 1, 2)], ITEMS)
    assert lexical_search.search(docs.where("false"), items).count() == 0 and lexical_search.search(docs, items.where("false")).count() == 0
    assert lexical_search.search(documents(spark, [(1, None)]), items).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == ranking([(1, "a b")], [(1, "a")])
