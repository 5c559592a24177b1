"""Column functions, frame operators and sources on small frames with worked values."""

import datetime

import pytest
from pyspark.sql import functions as F

from plenum.functions import dates, scores, text
from plenum.operators import tables
from plenum.sources import tables as sources

L = F.lit
DAY = datetime.date


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: text.blank_or(L(""), L("x")), "x"),
        (lambda: text.strip(L("\t a b\n")), "a b"),
        (lambda: text.listed(L(" a, ,b ")), ["a", "b"]),
        (lambda: text.joined(", ", L("a"), L(""), L(None).cast("string"), L("b")), "a, b"),
        (lambda: text.price_range(L("$350 - $1,100")), (350, 1100)),
        (lambda: text.price_range(L("free")), (0, 0)),
        (lambda: text.price_range(L("$5, $6 or $7")), (5, 7)),
        (lambda: text.country_and_venue(L("France (Hall 1)")), ("France", "Hall 1")),
        (lambda: text.country_and_venue(L("France")), ("France", None)),
        (lambda: text.slug(L("Dr. Ana-Maria B!")), "dr.ana.maria.b"),
        (lambda: text.clipped(L("x" * 221)), "x" * 220 + "…"),
        (lambda: text.clipped(L("x" * 220)), "x" * 220),
        (lambda: text.short_code(L("user_ab12cd34")), "AB12CD34"),
        (lambda: text.initials(L("ada maria lovelace")), "AL"),
        (lambda: text.initials(L("ada")), "AD"),
        (lambda: text.initials(L(" ")), "?"),
        (lambda: text.xml_escaped(L("<a & 'b'>")), "&lt;a &amp; &apos;b&apos;&gt;"),
        (lambda: text.hash31(L("\U0001f600")), 1772899),
        (lambda: text.hash31(L("")), 0),
        (lambda: text.certificate_code(L("ab")), "0x" + f"{97 * 31 + 98:016x}"),
        (lambda: text.compact(L(999)), "999"),
        (lambda: text.compact(L(1000)), "1K"),
        (lambda: text.compact(L(8412)), "8.4K"),
        (lambda: text.compact(L(1_204_000)), "1.2M"),
        (lambda: text.plural(L(1)), ""),
        (lambda: dates.long_date(L(DAY(2026, 6, 25))), "Jun 25, 2026"),
        (lambda: dates.month_short(L(DAY(2026, 6, 25))), "JUN"),
        (lambda: dates.date_range(L(DAY(2026, 6, 25)), L(DAY(2026, 6, 28))), "Jun 25 – 28, 2026"),
        (lambda: dates.date_range(L(DAY(2026, 6, 25)), L(DAY(2026, 7, 2))), "Jun 25 – Jul 2, 2026"),
        (lambda: dates.date_range(L(DAY(2025, 12, 30)), L(DAY(2026, 1, 2))), "Dec 30, 2025 – Jan 2, 2026"),
        (lambda: dates.days_inclusive(L(DAY(2026, 6, 25)), L(DAY(2026, 6, 28))), 4),
        (lambda: F.hour(dates.in_zone(L(datetime.datetime(2026, 1, 1, 12)).cast("timestamp"), L(-8))) - F.hour(L(datetime.datetime(2026, 1, 1, 12)).cast("timestamp")), -8),
        (lambda: dates.overlaps(L(None).cast("date"), L(None).cast("date"), L(DAY(2026, 1, 1)), L(DAY(2026, 1, 2))), True),
        (lambda: scores.rounded(L(-2.5)), -2),
        (lambda: scores.bar_width(L(5.0), L(0.0)), 0.0),
        (lambda: scores.sponsor_match(L("AI"), F.array(L("ai research"), L("farming")), L(5.0)), 60),
        (lambda: scores.sponsor_match(L("AI"), F.array().cast("array<string>"), L(None).cast("double")), 35),
        (lambda: scores.available(L(2), L(5)), 0),
        (lambda: scores.pair(L("b"), L("a")), ("a", "b")),
        (lambda: scores.other_party(L("a"), L("a"), L("b")), "b"),
        (lambda: scores.next_of(["x", "y", "z"], L("z")), "x"),
    ],
)
def test_functions(spark, column, expected):
    found = spark.range(1).select(column().alias("v")).head().v
    assert (tuple(found) if isinstance(expected, tuple) else found) == expected


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyed_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(tables.toggle(old, new, ["k"])) == [(1, "a"), (3, "d")]
    assert rows(tables.upsert(old.limit(0), new, ["k"])) == [(2, "c"), (3, "d")]


def test_mark_read(spark):
    m = spark.createDataFrame([("c", "me", None), ("c", "you", None), ("d", "you", None), ("c", "you", 1)], "conversation_id string, sender_id string, read_at long")
    assert [r.read_at for r in tables.mark_read(m, L("c"), L("me"), L(9)).collect()] == [None, 9, None, 1]


def test_latest_search_facets(spark):
    t = spark.createDataFrame([(1, 5, "Deep 50% Sea", ["x"]), (1, 7, None, ["Deep"]), (2, 5, "air", None)], "k long, at long, title string, topics array<string>")
    assert [r.at for r in tables.latest(t, ["k"], F.desc("at")).orderBy("k").collect()] == [7, 5]
    assert tables.search(t, "DEEP", ["title"], ["topics"]).count() == 2
    assert tables.search(t, "0%", ["title"]).count() == 1
    assert tables.facets(t, title="All", k=[]).count() == 3
    assert tables.facets(t, title="air", k=[1, 2]).count() == 1


def test_json_columns(spark, tmp_path):
    t = spark.createDataFrame([('{"a": 1.5}', '["x"]', 1), ("broken", None, 2)], "scores string, keywords string, id long")
    assert sources.decoded(t).orderBy("id").collect() == [({"a": 1.5}, ["x"], 1), (None, None, 2)]
    sources.write_json(t, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_new_ids(spark):
    from plenum.functions import text

    ids = [r[0] for r in spark.range(50).select(text.new_id("m_")).collect()]
    assert len(set(ids)) == 50 and all(i.startswith("m_") and len(i) == 38 for i in ids)


def test_plain_compact_counts_and_uris(spark):
    from plenum.functions import text

    rows = spark.createDataFrame([(999,), (1000,), (1500,), (999_960,), (1_000_000,), (1_204_000,)], "n long")
    assert [r[0] for r in rows.select(text.compact_plain(rows.n)).collect()] == ["999", "1K", "1.5K", "1000K", "1M", "1.2M"]
    uri = spark.createDataFrame([("a b+c/é",), ("",), (None,)], "t string")
    assert [r[0] for r in uri.select(text.uri_encoded(uri.t)).collect()] == ["a%20b%2Bc%2F%C3%A9", "", None]
