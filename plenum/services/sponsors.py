"""Sponsorship packages, applications, sponsors' statistics and matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scores import available, sponsor_match
from plenum.functions.text import blank_or
from plenum.operators.ordering import newest_first, placed

# The least rating of a verified sponsor, what stands for a missing company, the role of reviewing organizers, and the mark between an opportunity and a tier.
VERIFIED_FROM, UNKNOWN, ORGANIZER, KEY_MARK = 3.0, "Unknown Sponsor", "Organizer", "__"


def package_documents(packages: DataFrame, applications: DataFrame) -> DataFrame:
    """Packages with their benefits as a list and the slots that are left, newest first per organizer."""
    taken = applications.filter("status = 'Approved'").groupBy(F.col("package_id").alias("id")).agg(F.count(F.lit(1)).alias("taken"))
    rows = packages.join(taken, "id", "left").withColumn("available_slots", available(F.col("total_slots"), F.col("taken")))
    rows = rows.withColumn("benefits", F.coalesce(F.from_json("benefits", "array<string>"), F.array().cast("array<string>"))).drop("taken")
    return newest_first(rows, "organizer_id", "created_at", "id")


def applications_of(applications: DataFrame, packages: DataFrame, sponsor: str | None = None) -> DataFrame:
    """A sponsor's applications, or each one's, with their packages' columns, newest first."""
    p = packages.select(F.col("id").alias("package_id"), "tier", "conference_title", "price")
    return newest_first(applications.join(p, "package_id"), "sponsor_id", "created_at", "id", sponsor)


def history(applications: DataFrame, packages: DataFrame, now: Column) -> DataFrame:
    """sponsor_id, title, tier, year, place: approved applications, the last decided first; those without a time of decision count as of now and come last."""
    p = packages.select(F.col("id").alias("package_id"), F.col("conference_title").alias("title"), "tier")
    rows = applications.filter("status = 'Approved'").join(p, "package_id")
    rows = newest_first(rows, "sponsor_id", "decided_at", "id")
    return rows.select("sponsor_id", "title", "tier", F.year(F.coalesce("decided_at", now)).alias("year"), "place")


def histories(applications: DataFrame, packages: DataFrame, now: Column, told: Callable[[Column], Column] = lambda past: past) -> DataFrame:
    """sponsor_id, history: each sponsor's history() as a list of place, title, tier and year, or what told makes of that list, once per sponsor."""
    lists = history(applications, packages, now).groupBy("sponsor_id").agg(F.array_sort(F.collect_list(F.struct("place", "title", "tier", "year"))).alias("history"))
    return lists.select("sponsor_id", told(F.col("history")).alias("history"))


def statistics(applications: DataFrame, reviews: DataFrame, sponsors: DataFrame | None = None) -> DataFrame:
    """sponsor_id, rating, reviews, approved: over all organizers, for the sponsors in the given frame (sponsor_id) or all.

    Sponsors are cut by semi join before anything is aggregated. Approved applications count whether or not their package is there.
    What they were for is history(), one row each, or histories(), one list per sponsor.
    """
    if sponsors is not None:
        ids = sponsors.select("sponsor_id").distinct()
        applications, reviews = (t.join(ids, "sponsor_id", "left_semi") for t in (applications, reviews))
    rated = reviews.groupBy("sponsor_id").agg(F.avg("rating").alias("rating"), F.count(F.lit(1)).alias("reviews"))
    active = applications.filter("status = 'Approved'").groupBy("sponsor_id").agg(F.count(F.lit(1)).alias("approved"))
    both = rated.join(active, "sponsor_id", "full")
    return both.select("sponsor_id", F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("approved", F.lit(0)).alias("approved"))


def company(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("sponsor_id"), blank_or(F.col("organization"), blank_or(F.col("name"), F.lit(UNKNOWN))).alias("company"))


def applicants(applications: DataFrame, packages: DataFrame, users: DataFrame, reviews: DataFrame, organizer: str | None = None, now: Column | None = None, told: Callable[[Column], Column] = lambda past: past) -> DataFrame:
    """Applications to an organizer's packages, or each one's, newest first, with the sponsors' companies and statistics; unknown sponsors stay.

    With now, each has its sponsor's history too: the list of histories(), empty for none, or what told makes of it before it is joined.
    A list is copied to each of its sponsor's applications, so told should keep what the reader needs; without now, sponsor_id refers to history().
    """
    p = packages.select(F.col("id").alias("package_id"), "organizer_id", "tier", "conference_title")
    if organizer is not None:
        p = p.filter(F.col("organizer_id") == organizer)
    rows = applications.join(p, "package_id")
    asked = rows if organizer is not None else None
    stats = statistics(applications, reviews, asked)
    if now is not None:
        shown = applications if asked is None else applications.join(asked.select("sponsor_id").distinct(), "sponsor_id", "left_semi")
        stats = stats.join(histories(shown, packages, now, told), "sponsor_id", "left")
    rows = rows.join(stats, "sponsor_id", "left").join(company(users), "sponsor_id", "left")
    zero = {"rating": 0.0, "reviews": 0, "approved": 0}
    rows = rows.fillna(zero).withColumn("company", F.coalesce("company", F.lit(UNKNOWN)))
    if now is not None:
        none = F.array().cast("array<struct<place:bigint,title:string,tier:string,year:int>>")
        rows = rows.withColumn("history", F.coalesce("history", told(none)))
    return newest_first(rows, "organizer_id", "created_at", "id")


def reviewable(applications: DataFrame, packages: DataFrame, users: DataFrame) -> DataFrame:
    """organizer_id, sponsor_id, company: sponsors that an organizer approved, once each; unknown ones stay."""
    p = packages.select(F.col("id").alias("package_id"), "organizer_id")
    ids = applications.filter("status = 'Approved'").join(p, "package_id").select("organizer_id", "sponsor_id").distinct()
    return ids.join(company(users), "sponsor_id", "left").withColumn("company", F.coalesce("company", F.lit(UNKNOWN)))


def may_review(asked: DataFrame, applications: DataFrame, packages: DataFrame) -> DataFrame:
    """asked (organizer_id, sponsor_id) with allowed: whether the organizer has approved the sponsor. One semi join for all pairs."""
    p = packages.select(F.col("id").alias("package_id"), "organizer_id")
    approved = applications.filter("status = 'Approved'").join(p, "package_id").select("organizer_id", "sponsor_id").distinct().withColumn("allowed", F.lit(True))
    return asked.join(approved, ["organizer_id", "sponsor_id"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def reviews_of(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """A sponsor's reviews with the organizers' names, newest first."""
    who = users.select(F.col("id").alias("organizer_id"), F.col("name").alias("reviewer"))
    rows = newest_first(reviews.join(who, "organizer_id"), "sponsor_id", "created_at", "id")
    return rows.select("sponsor_id", "place", "reviewer", F.lit(ORGANIZER).alias("reviewer_role"), "rating", F.split_part(F.col("created_at").cast("string"), F.lit(" "), F.lit(1)).alias("day"))


def decided(applications: DataFrame, packages: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """applications with the decisions (id, organizer_id, status) of those organizers who own the package; others change nothing."""
    owner = packages.select(F.col("id").alias("package_id"), "organizer_id")
    allowed = decisions.filter(F.col("status").isin("Approved", "Rejected")).withColumnRenamed("status", "_to")
    allowed = allowed.join(applications.select("id", "package_id"), "id").join(owner, ["package_id", "organizer_id"], "left_semi").select("id", "_to")
    rows = applications.join(allowed, "id", "left")
    met = F.col("_to").isNotNull()
    return rows.withColumns({"status": F.coalesce("_to", "status"), "decided_at": F.when(met, now).otherwise(F.col("decided_at"))}).select(applications.columns)


def verified(reviews: Column, rating: Column) -> Column:
    """New sponsors, and those rated from VERIFIED_FROM."""
    return (F.coalesce(reviews, F.lit(0)) == 0) | (F.coalesce(rating, F.lit(0.0)) >= VERIFIED_FROM)


def verification_reason(reviews: Column, rating: Column) -> Column:
    shown = F.format_string("%.1f", F.round(rating, 1))
    return F.when(F.coalesce(reviews, F.lit(0)) == 0, "New sponsor, not yet reviewed").when(verified(reviews, rating), F.concat(F.lit("Rated "), shown, F.lit(" by organizers"))).otherwise(F.concat(F.lit("Rated "), shown, F.lit(", below the required "), F.lit(f"{VERIFIED_FROM:.1f}")))


def matched(packages: DataFrame, opportunities: DataFrame, industry: Column, rating: Column) -> DataFrame:
    """Packages made from an opportunity, with a score of how well it fits, the best first in each conference; the others have none and come last.

    The opportunity is the first part of the key; opportunities are a catalog of a few dozen rows.
    """
    key = F.split_part("source_opportunity_id", F.lit(KEY_MARK), F.lit(1))
    o = opportunities.select(F.col("id").alias("opportunity_id"), F.col("name").alias("opportunity"), "ideal_sectors")
    rows = packages.withColumn("opportunity_id", key).join(o, "opportunity_id", "left")
    made = (F.coalesce("source_opportunity_id", F.lit("")) != "") & F.col("opportunity").isNotNull()
    rows = rows.withColumn("score", F.when(made, sponsor_match(industry, F.col("ideal_sectors"), rating)))
    return placed(rows, ["conference_id"], F.col("score").desc_nulls_last(), F.col("id"))


def standing_alone(packages: DataFrame) -> DataFrame:
    """Packages that come from no opportunity."""
    return packages.filter(F.coalesce("source_opportunity_id", F.lit("")) == "")


def catalog(opportunities: DataFrame, packages: DataFrame) -> DataFrame:
    """Each tier of each opportunity (tiers: array), and whether a package was made from it."""
    tiers = opportunities.select("id", F.explode("tiers").alias("tier")).withColumn("key", F.concat("id", F.lit(KEY_MARK), "tier"))
    made = packages.filter("source_opportunity_id <> ''").select(F.col("source_opportunity_id").alias("key")).distinct().withColumn("active", F.lit(True))
    return tiers.join(made, "key", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def with_application(packages: DataFrame, applications: DataFrame, sponsor: str | Column) -> DataFrame:
    """Packages with the status of a sponsor's application; of several, the last by time and id counts."""
    mine = applications.filter(F.col("sponsor_id") == sponsor).groupBy(F.col("package_id").alias("id")).agg(F.max_by("status", F.struct("created_at", "id")).alias("my_status"))
    return packages.join(mine, "id", "left")


def revenue(packages: DataFrame, applications: DataFrame) -> DataFrame:
    """organizer_id, revenue, most: what approved applications bring, and the most that one package does, 1 at least."""
    docs = package_documents(packages, applications).withColumn("earned", F.col("price") * (F.col("total_slots") - F.col("available_slots")))
    return docs.groupBy("organizer_id").agg(F.round(F.sum("earned"), 2).alias("revenue"), F.greatest(F.lit(1.0), F.round(F.max("earned"), 2)).alias("most"))


def profile(users: DataFrame, stats: DataFrame) -> DataFrame:
    """Sponsors' profiles: identity and derived statistics in one struct each."""
    rows = users.filter("role = 'sponsor'").join(stats.withColumnRenamed("sponsor_id", "id"), "id", "left")
    identity = F.struct("name", blank_or(F.col("organization"), F.col("name")).alias("company"), F.coalesce("country", F.lit("")).alias("country"))
    derived = F.struct(F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("approved", F.lit(0)).alias("approved"), verified(F.col("reviews"), F.col("rating")).alias("verified"))
    return rows.select("id", identity.alias("identity"), derived.alias("derived"))
