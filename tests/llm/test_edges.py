"""Nulls, empty tables, long texts, ties, repeated rows and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from notecheck.llm import audio_prints, chat, jaccard_join, license_scan, mixing, packing, quality_cnn, quality_rules, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __text string, n_words long, kept boolean, score double, h int, __gone long"
LABELS = "doc_id long, quality int, toxic int"
LONG = "word " * 30_000 + "end"


def rows():
    text = " ".join(f"w{i % 97}x{i}" for i in range(60))
    some = [(1, text, "en", "a"), (2, text, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, LONG, "de", "a"), (None, text + " more", "en", None), (7, " \n\t ", None, "b"), (8, "one two", "en", "b"), (8, "one two", "en", "b"), (9, "Ünï\u00a0cödé " * 30, "fr", "c")]
    return [(*r, 1, "clash", 5, True, 0.5, 3, 4) for r in some]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None), (8, 0, 0), (8, 1, 1), (9, 1, 0)], LABELS)


def doc_ops(labels):
    return {
        "mix": mixing.mix_sources,
        "pack": packing.pack,
        "toxic": lambda d: toxicity.score_toxicity(d, labels),
        "license": license_scan.scan_licenses,
        "cnn": lambda d: quality_cnn.score_quality(d, labels, quality_cnn.CnnParams(epochs=1)),
        "rules": lambda d: quality_rules.quality_rules(d, labels),
        "jaccard": jaccard_join.link_documents,
    }


@pytest.mark.parametrize("op", ["mix", "pack", "toxic", "license", "cnn", "rules", "jaccard"])
def test_edges(docs, none, labels, op):
    f = doc_ops(labels)[op]
    got = f(docs).collect()
    assert f(none).count() == 0
    if op in ("mix", "toxic", "cnn", "rules"):
        assert len(got) == docs.count()
    if op == "jaccard":
        by = {r.doc_id: r for r in got if r.doc_id is not None}
        assert by[1].component_id == by[2].component_id == 1 and by[3].n_shingles == 0 and by[4].component_id == 4 and by[8].n_shingles == 1
        assert [r.component_id for r in got if r.doc_id is None] == [None]
    if op == "pack":
        assert sum(r.n_words for r in got) == docs.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
        assert max(r.slot for r in got) >= 0 and all(r.n_words <= r.bucket_len for r in got)
    if op in ("toxic", "cnn"):
        assert all(0 <= r.score <= 1 for r in got)
    if op == "rules":
        assert not any(r.kept for r in got if r.n_words < 20)


def test_stages_keep_columns(docs, none, labels):
    for f in (lambda d: quality_rules.keep_good(d, labels), lambda d: quality_cnn.keep_quality(d, labels, quality_cnn.CnnParams(epochs=1)), jaccard_join.keep_one, mixing.take_mix):
        out = f(docs)
        assert out.columns == docs.columns and f(none).count() == 0
        assert {r["__text"] for r in out.collect()} <= {"clash"}
    kept = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 4, 5, 7, 8, 9]


def test_no_labels(docs, spark):
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.5}
    assert {r.score for r in quality_cnn.score_quality(docs, empty).collect()} == {0.5}
    assert quality_rules.quality_rules(docs, empty).count() == docs.count()


def test_urls(spark):
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame([(1, "HTTP://A.Example.NET/en/1?x", "h"), (2, None, None), (3, "no scheme", ""), (4, "http://example.com/de/5#a", ""), (5, "x://y://z/p", ""), (None, "http://b.net", ""), (7, "http://q.net/x", ""), (8, "http://ex.org/fr/1", "")], "page_id long, url string, host string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].host, got[2].path, got[2].verdict) == ("", "", "allow") and got[3].host == ""
    assert got[4].rule == "example.com/de/" and got[4].verdict == "block" and got[5].host == "y:"
    assert got[None].rule is None and got[7].rule == "net/" and got[8].rule == "org/fr/"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_templates(spark):
    pages = [(i, f"http://h.com/bad/{i}.html") for i in range(40)] + [(100 + i, f"http://h.com/new/a{i}/x/{'y' if i % 2 else 'z'}/{i}") for i in range(40)] + [(200, "http://h.com/other")]
    pages += [(300 + i, f"http://u.com/u{i % 20}/p{i}") for i in range(100)]
    # Branches alike: only one of them has labels. Another shape has none.
    pages += [(1000 + 100 * b + i, f"http://s.com/{b}/{'xyz'[i % 3]}/{i}") for b in range(3) for i in range(60)] + [(2000 + i, f"http://s.com/q/{i}") for i in range(60)]
    params = url_filter.UrlParams(rules=(("h.com", "/bad/1", "block"), ("h.com", "/bad/2", "block"), ("s.com", "/1/", "block")))
    run = lambda rows: {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), params).collect()}
    got = run(pages)
    assert got[5].rule is None and got[5].verdict == "block" and got[5].template == "/bad/*"
    assert got[105].template == "/new/*/x/(y|z)/*" and got[105].verdict == "allow" and got[200].verdict == "allow"
    assert {got[300 + i].template for i in range(100)} == {"/*/*"}
    assert got[1007].template == "/(0|1|2)/(x|y|z)/*" and got[1007].rule is None and got[1007].verdict == "block" and got[1207].verdict == "block"
    assert got[2007].template == "/q/*" and got[2007].verdict == "allow"
    assert run(pages * 3) == got


def test_url_edges(spark):
    rows = [(1, "http://a.b/" + "x/" * 5000 + "end", 1, "c", 2), (2, "http://a.b/*/*", 1, "c", 2), (2, "http://a.b/*/*", 1, "c", 2), (3, None, 1, "c", 2)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, segs int, node string, host int")).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"} and max(len(r.path) for r in got) == 10004


def test_chat(spark):
    turns = [(1, 0, "user", "a\\n<|im_end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "<|x\\"), (1, 3, "user", "tail"), (2, 0, None, "only"), (None, None, "assistant", "z"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 0, "we\nird<", "<")]
    made = chat.expand_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digest_examples(made).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 4 and got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].loss_chars == 1 and got[3].n_turns == 3
    longest = max((r.formatted for r in made.where("conv_id = 1").collect()), key=len)
    assert chat.read_back(longest) == [("user", "a\\n<|im_end|>"), ("assistant", ""), ("assistant", "<|x\\"), ("user", "tail")]
    assert made.where("conv_id = 1").count() == 3 and chat.read_back(made.where("conv_id = 3").orderBy("example").first().formatted)[0] == ("we\nird<", "<")
    assert chat.digest_examples(chat.expand_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_audio(spark):
    ids = ["a", "b"]
    text = " ".join(f"q{i * 7919 % 499}" for i in range(120))
    part = " ".join(text.split()[30:100])
    rows = [(20, 0, text), (21, 0, text), (22, 0, part), (23, 0, None), (24, 0, ""), (25, 0, "x"), (26, 0, part + " zz yy"), (27, 0, "other " * 50), (None, 1, text)]
    media = audio_prints.recordings_of(spark.createDataFrame(rows, "a long, b long, text string"), ids)
    got = {r.a: r for r in audio_prints.align(audio_prints.fingerprint(media, ids), ids, F.col("a") % 20 == 0).collect()}
    assert got[21].class_a == got[20].class_a and got[22].matches == 1 and got[22].best_offset == -30 and got[22].best_error == 0
    assert got[26].matches == 1 and got[26].best_error < 0.1 and got[27].matches == 0 and got[23].n_codes == 0 and got[23].class_a is None and got[24].n_codes == 0
    bad = spark.createDataFrame([(1, 1, bytearray(b"RIFFxx")), (2, 1, None)], "a long, b long, media binary")
    assert [r.n_codes for r in audio_prints.align(audio_prints.fingerprint(bad, ids), ids, F.lit(True)).collect()] == [0, 0]


def test_audio_edges(spark):
    ids = ["codes_of", "__key"]
    long = " ".join(f"z{i * 31 % 9973}" for i in range(9000))
    rows = [(20, 1, long, "x"), (1, 1, " ".join(long.split()[4000:4100]), "x"), (None, 1, "lone " * 50, "x"), (None, 1, "lone " * 50, "x")]
    turns = spark.createDataFrame(rows, "codes_of long, __key long, text string, q_codes string")
    got = audio_prints.align(audio_prints.fingerprint(audio_prints.recordings_of(turns, ids), ids), ids, F.col("codes_of") == 20).collect()
    by = {r.codes_of: r for r in got}
    assert len(got) == 4 and by[1].matches == 1 and by[1].best_offset == -4000 and by[20].n_codes == 9000 - 18 and by[None].class___key == 1
    none = spark.createDataFrame([], "codes_of long, __key long, media binary")
    assert audio_prints.align(audio_prints.fingerprint(none, ids), ids, F.lit(True)).count() == 0
