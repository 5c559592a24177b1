"""Search over conferences by up to ten facets, and what the search form offers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import price_range
from plenum.operators.ordering import by_locale

ALL = "All"
# What the price filter spans where nothing is known.
PRICE_BOUNDS = (0, 1000)


@dataclass(frozen=True)
class Search:
    """The facets; each has a value that lets everything pass."""

    keyword: str = ""
    industry: str = ALL
    cfp_status: str = ALL
    location: str = ""
    formats: tuple[str, ...] = ()
    since: date | None = None
    until: date | None = None
    price_least: int | None = None
    price_most: int | None = None
    accommodation: bool = False
    brochure: bool = False
    city_map: bool = False


def active_facets(searches: DataFrame) -> Column:
    """How many facets are in use in a row of saved searches (columns named as in Search; those that are missing are not in use), the keyword apart.

    Null, empty and 'All' let everything pass; either price bound uses the one price facet.
    """
    def used(name: str) -> Column:
        if name not in searches.columns:
            return F.lit(False)
        kind = dict(searches.dtypes)[name]
        if kind == "boolean":
            return F.coalesce(F.col(name), F.lit(False))
        if kind.startswith("array"):
            return F.coalesce(F.size(name) > 0, F.lit(False))
        return F.col(name).isNotNull() & ~F.col(name).isin("", ALL) if kind == "string" else F.col(name).isNotNull()

    single = ("industry", "cfp_status", "location", "formats", "since", "until", "accommodation", "brochure", "city_map")
    facets = [used(c) for c in single] + [used("price_least") | used("price_most")]
    return reduce(lambda x, y: x + y, [f.cast("int") for f in facets])


def _holds(text: Column, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))


def predicates(s: Search) -> list[Column]:
    """A condition per facet in use. Days that can't be read and prices without a number pass or count as 0, as the columns below define."""
    found = []
    if s.keyword:
        found.append(_holds(F.col("title"), s.keyword) | _holds(F.col("description"), s.keyword) | F.coalesce(F.exists("topics", lambda t: _holds(t, s.keyword)), F.lit(False)))
    if s.industry != ALL:
        found.append(F.col("industry") == s.industry)
    if s.cfp_status != ALL:
        found.append(F.col("cfp_status") == s.cfp_status)
    if s.location:
        found.append(_holds(F.concat_ws(" ", "city", "country", "venue"), s.location))
    if s.formats:
        found.append(F.col("format").isin(list(s.formats)))
    if s.since is not None:
        found.append(F.coalesce(F.to_date(F.col("end_day")) >= F.lit(s.since), F.lit(True)))
    if s.until is not None:
        found.append(F.coalesce(F.to_date(F.col("start_day")) <= F.lit(s.until), F.lit(True)))
    if s.price_least is not None or s.price_most is not None:
        price = price_range(F.col("price_range"))
        if s.price_least is not None:
            found.append(price["high"] >= s.price_least)
        if s.price_most is not None:
            found.append(price["low"] <= s.price_most)
    if s.accommodation:
        found.append(F.coalesce(F.length(F.trim("accommodation")) > 0, F.lit(False)))
    if s.brochure:
        found.append(F.coalesce("has_brochure", F.lit(False)))
    if s.city_map:
        found.append(F.coalesce("has_city_map", F.lit(False)))
    return found


def search(conferences: DataFrame, s: Search) -> DataFrame:
    """Conferences that meet all facets in use."""
    conditions = predicates(s)
    return conferences.filter(reduce(lambda a, b: a & b, conditions)) if conditions else conferences


def industries(conferences: DataFrame) -> DataFrame:
    """The industries on offer, in the order of the locale."""
    return conferences.filter("industry <> ''").select("industry").distinct().orderBy(by_locale(F.col("industry")))


def price_bounds(conferences: DataFrame) -> DataFrame:
    """low, high over all price ranges; a fixed span without any."""
    p = conferences.select(price_range(F.col("price_range")).alias("p"))
    return p.agg(F.coalesce(F.min("p.low"), F.lit(PRICE_BOUNDS[0])).alias("low"), F.coalesce(F.max("p.high"), F.lit(PRICE_BOUNDS[1])).alias("high"))


def web_results(items: DataFrame, most: int = 10) -> DataFrame:
    """Records from the items of a search service's answer (value: JSON text of one answer with query and items), the first ones in their order."""
    schema = "query string, items array<struct<title:string,link:string,snippet:string,displayLink:string>>"
    answers = items.select(F.from_json("value", schema).alias("a")).filter("a.items IS NOT NULL")
    each = answers.select("a.query", F.posexplode(F.slice("a.items", 1, most)).alias("place", "i"))
    return each.select("query", F.col("place").cast("long").alias("place"), F.coalesce("i.title", F.lit("")).alias("title"), "i.link", F.coalesce("i.snippet", F.lit("")).alias("snippet"), F.col("i.displayLink").alias("site"))


def conference_document(form: DataFrame) -> DataFrame:
    """Conference documents from a form's flat rows, with defaults for what is missing and lists from comma-separated texts."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    place = F.struct(F.coalesce("city", F.lit("")).alias("city"), F.coalesce("country", F.lit("")).alias("country"), F.coalesce("venue", F.lit("TBA")).alias("venue"))
    days = F.struct(F.col("start_day").alias("start"), F.coalesce("end_day", "start_day").alias("end"))
    return form.select("id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), listed("topics").alias("topics"), place.alias("location"), days.alias("dates"), F.coalesce("format", F.lit("Physical")).alias("format"), F.lit("Open").alias("cfp_status"))
