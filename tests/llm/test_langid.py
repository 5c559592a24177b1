"""Cross-parsing against a naive longest match, ties, long texts, and what a worker keeps."""

import math
import random

import pytest

from plenum.llm import langid

SAMPLES = {"a": b" abra cadabra zoo ", "b": b" der die das und \xc3\xa4 ", "c": b" x "}


def naive(sample: bytes, text: bytes) -> int:
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


@pytest.mark.parametrize("side_by_side", [1, 24, 10_000])
def test_phrases(monkeypatch, side_by_side):
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", side_by_side)
    rng, parser = random.Random(1), langid.Parser(SAMPLES)
    texts = [bytes(rng.choice(b"abdruciezx  s\xc3\xa4") for _ in range(rng.choice((0, 1, 5, 60, 700)))) for _ in range(80)]
    found = parser.phrases(texts)
    assert all(found[k, i] == naive(SAMPLES[lang], t) for k, lang in enumerate(parser.langs) for i, t in enumerate(texts))


def test_predictions_are_those_of_the_naive_parse(monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 50)
    parser = langid.Parser(SAMPLES)
    texts = ["Abra, der cadabra", "die DAS und", "12 !", None, "", "x", "zzz qqq", "ी", "²"]
    for text, (lang, score, _) in zip(texts, parser.predict(texts), strict=True):
        t = langid.normal(text)
        if not t:
            assert (lang, score) == ("und", 0) and not any(map(str.isalpha, text or ""))
            continue
        cost = sorted((naive(s, t) * math.log2(len(s) + 1) / len(t), x) for x, s in SAMPLES.items())
        assert lang == cost[0][1] and math.isclose(score, 1 - cost[0][0] / cost[1][0])


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "..."), (1, "one two three")], "doc_id long, text string")
    same = {x: b" one two three " for x in ("q", "p", "r")}
    assert sorted(tuple(r) for r in langid.identify(docs, same).select("doc_id", "lang_pred", "score").collect()) == [(1, "p", 0.0), (1, "p", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert [x[:2] for x in langid.Parser({"one": b" word "}).predict(["word", "other"])] == [("one", 1.0)] * 2


def test_very_long_texts():
    parser = langid.Parser(SAMPLES)
    texts = ["abra cadabra " * 40_000, "die und das " * 30_000 + "abra"] + ["die"] * 30
    assert [x[0] for x in parser.predict(texts)] == ["a"] + ["b"] * 31


def test_a_worker_keeps_one_set_of_tables():
    langid.parser.cache_clear()
    for i in range(3):
        langid.parser((("a", b" sample %d " % i),))
    assert langid.parser.cache_info().currsize == 1
    big = langid.Parser({x: bytes(random.Random(x).choices(range(97, 123), k=5000)) for x in "abcd"}, most=1 << 20)
    assert big.table.nbytes <= 1 << 20


def test_sample_is_bounded_and_not_held_out(spark):
    rows = [(i, "word " * 50 + str(i), "en" if i % 2 else "de") for i in range(300)] + [(None, "none", "xx"), (5000, None, "en"), (5001, "123", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(docs, most=600)
    assert set(samples) == {"de", "en"} and all(0 < len(t) <= 600 for t in samples.values())
    held = {r.doc_id for r in docs.filter(langid.held_out()).collect()}
    only = docs.filter(langid.held_out() & docs.lang.isNotNull())
    assert len(held) > 50 and langid.learn(only) == {}


def test_stage_rejects_what_no_language_explains(spark):
    de = "der die und das nicht ist ein zu haben werden mit schön für".split()
    en = "the and that not is one to have will with good for".split()
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(w, k=30)), lang if i % 10 else None) for k, (lang, w) in enumerate((("de", de), ("en", en)), 1) for i in range(k * 1000, k * 1000 + 60)]
    noise = [(10 + i, "".join(rng.choices("абвгдежзийк", k=400)), None) for i in range(5)]
    docs = spark.createDataFrame(rows + noise + [(1, None, "en"), (2, "12", "en"), (3, "the", None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS size")
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs).collect()}
    assert set(kept) == {r[0] for r in rows} | {3}
    assert all(kept[i] == lang for i, lang in ((1000, "de"), (2000, "en"), (1050, "de")))


def test_held_out_accuracy(spark):
    """On invented prose in four languages, learnt from the rows that aren't held out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(found) > 200 and sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
