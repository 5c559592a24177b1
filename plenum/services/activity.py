"""Submissions, reviews, registrations, interactions, feedback and the organizers' feed. Frames in, frames out; owners are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import blank_or, strip
from plenum.operators.nested import steps
from plenum.operators.ordering import by_locale, newest_first, placed
from plenum.operators.tables import as_map, lists_by

# The labels of the timeline, what a recommendation makes of a submission, and the states that end it.
TIMELINE = ("Submitted", "Under Review", "Reviews In", "Decision", "Final")
BY_RECOMMENDATION = {"Accept": "Accepted for Oral Presentation", "Accept as Poster": "Accepted for Poster Presentation", "Minor Revision": "Revisions Requested", "Major Revision": "Revisions Requested", "Reject": "Rejected"}
FINAL = ("Accepted for Oral Presentation", "Accepted for Poster Presentation", "Rejected")
REVISED = "Revised Abstract Submitted"

CO_AUTHORS = "array<struct<name:string,affiliation:string,email:string>>"


def mean_score(scores: Column, decimals: int) -> Column:
    """Mean of the values of a map, rounded; 0 for an empty map and for null."""
    values = F.map_values(scores)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(values) > 0, F.round(total / F.size(values), decimals)).otherwise(0.0)


def status_after(recommendation: Column, status: Column) -> Column:
    """The status that a review's recommendation gives; an unknown one leaves it."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in BY_RECOMMENDATION.items() for x in kv))[recommendation], status)


def timeline(status: Column, reviewed: Column) -> Column:
    """Five steps with their states: at the last for a final status, at the fourth with reviews, else at the second."""
    final = F.coalesce(status.isin(list(FINAL)), F.lit(False))
    return steps(TIMELINE, F.when(final, 4).when(reviewed, 3).otherwise(1), final)


def reviews_of(reviews: DataFrame) -> DataFrame:
    """submission_id, reviews: the reviews of each submission as an array, by time and id. The children of one submission, which it shows whole."""
    one = F.struct("created_at", "id", "reviewer_id", "reviewer_name", "overall_score", "recommendation")
    return reviews.groupBy("submission_id").agg(F.array_sort(F.collect_list(one)).alias("reviews"))


def submission_documents(submissions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Nested documents of all submissions: author, lists from JSON, reviews, timeline, day of submission; place: newest first per submitter."""
    joined = submissions.join(reviews_of(reviews).withColumnRenamed("submission_id", "id"), "id", "left")
    found = F.coalesce("reviews", F.array())
    rows = joined.select(
        "id",
        "submitter_id",
        "conference_id",
        "conference_title",
        "title",
        blank_or(F.col("track"), F.lit("General")).alias("track"),
        F.coalesce(F.from_json("keywords", "array<string>"), F.array().cast("array<string>")).alias("keywords"),
        F.struct(F.col("primary_author_name").alias("name"), F.col("primary_author_email").alias("email"), blank_or(F.col("primary_author_affiliation"), F.lit("")).alias("affiliation")).alias("author"),
        F.coalesce(F.from_json("co_authors", CO_AUTHORS), F.array().cast(CO_AUTHORS)).alias("co_authors"),
        "status",
        "submission_date",
        F.split_part(F.col("submission_date").cast("string"), F.lit(" "), F.lit(1)).alias("day"),
        "revisions_count",
        found.alias("reviews"),
        timeline(F.col("status"), F.size(found) > 0).alias("timeline"),
    )
    return newest_first(rows, "submitter_id", "submission_date", "id")


def review_of(documents: DataFrame, reviewer: str) -> DataFrame:
    """Submissions with the reviewer's first review, null where there is none."""
    mine = F.filter("reviews", lambda r: r["reviewer_id"] == reviewer)
    return documents.withColumn("mine", F.try_element_at(mine, F.lit(1)))


def pending_and_done(documents: DataFrame, reviewer: str) -> tuple[DataFrame, DataFrame]:
    done = F.exists("reviews", lambda r: r["reviewer_id"] == reviewer)
    return documents.filter(~done), documents.filter(done)


def add_reviews(reviews: DataFrame, new: DataFrame, users: DataFrame) -> DataFrame:
    """reviews and new ones (id, submission_id, reviewer_id, scores as a map, comments_to_author, recommendation, created_at), with the reviewers' names looked up and the mean score to one decimal."""
    who = users.select(F.col("id").alias("reviewer_id"), F.col("name").alias("reviewer_name"), F.col("organization").alias("reviewer_org"))
    rows = new.join(who, "reviewer_id").withColumn("overall_score", mean_score(F.col("scores"), 1)).withColumn("scores", F.to_json("scores"))
    return reviews.unionByName(rows.withColumn("confidential_comments", F.lit(None).cast("string")).select(reviews.columns))


def statuses(submissions: DataFrame, reviews: DataFrame, revisions: DataFrame) -> DataFrame:
    """submissions with the status after their last review (by time, then id) and, if one came later, their last revision, and the number of revisions added."""
    last = reviews.groupBy(F.col("submission_id").alias("id")).agg(F.max(F.struct("created_at", "id", "recommendation")).alias("r"))
    revised = revisions.groupBy(F.col("submission_id").alias("id")).agg(F.max("created_at").alias("revised_at"), F.count(F.lit(1)).alias("more"))
    rows = submissions.join(last, "id", "left").join(revised, "id", "left")
    later = F.col("revised_at").isNotNull() & (F.col("r").isNull() | (F.col("revised_at") >= F.col("r.created_at")))
    status = F.when(later, F.lit(REVISED)).otherwise(status_after(F.col("r.recommendation"), F.col("status")))
    return rows.withColumns({"status": status, "revisions_count": F.col("revisions_count") + F.coalesce("more", F.lit(0))}).select(submissions.columns)


def registrations_of(registrations: DataFrame, user: str | None = None) -> DataFrame:
    """The registrations of one user, or of each, newest first."""
    rows = newest_first(registrations, "user_id", "registered_at", "id", user)
    return rows.select("user_id", "place", "conference_id", "conference_title", "package_name", "registered_at")


def registration_counts(registrations: DataFrame) -> DataFrame:
    """conference_id, n: the entries of the map of registrations per conference, for all conferences that have any, known or not."""
    return registrations.groupBy("conference_id").agg(F.count(F.lit(1)).alias("n"))


def registration_maps(registrations: DataFrame, conferences: DataFrame) -> DataFrame:
    """organizer_id, entries: how many registrations each of an organizer's conferences has, as a map; 0 for those without any."""
    counts = registration_counts(registrations).withColumnRenamed("conference_id", "id")
    own = conferences.select("id", "organizer_id").join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return as_map(own, "organizer_id", "id", "n")


def interactions_of(interactions: DataFrame) -> DataFrame:
    """user_id, saved, followed: the conferences of each kind."""
    return lists_by(interactions, "user_id", "conference_id", saved=F.col("type") == "saved", followed=F.col("type") == "followed")


def opportunities_of(volunteers: DataFrame) -> DataFrame:
    """reviewer_id, opportunities: the ids that a reviewer volunteered for."""
    return lists_by(volunteers, "reviewer_id", "opportunity_id", opportunities=F.lit(True))


def broadcasts_of(broadcasts: DataFrame, organizer: str | None = None) -> DataFrame:
    return newest_first(broadcasts, "organizer_id", "created_at", "id", organizer).select("organizer_id", "place", "id", "recipient_group", "subject", "created_at")


def conference_documents(created: DataFrame) -> DataFrame:
    """created with document: data as VARIANT, so that documents need no common schema; null where data isn't JSON."""
    return created.withColumn("document", F.try_parse_json("data"))


def conferences_of(created: DataFrame, organizer: str | None = None) -> DataFrame:
    """The conferences that one organizer made, or each one's, newest first: organizer_id, place, id, created_at, document."""
    rows = newest_first(conference_documents(created), "organizer_id", "created_at", "id", organizer)
    return rows.select("organizer_id", "place", "id", "created_at", "document")


def all_conferences(created: DataFrame) -> DataFrame:
    """The conferences of everybody, newest first: organizer_id, id, created_at, document. Sorted by ranges of time, not numbered."""
    rows = conference_documents(created).select("organizer_id", "id", "created_at", "document")
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())


def conference_fields(documents: DataFrame, **paths: str) -> DataFrame:
    """documents with a column for each path ('$.a.b[0] type') into document; null where the path is missing or holds something else."""
    split = {name: p.rsplit(" ", 1) for name, p in paths.items()}
    return documents.withColumns({name: F.try_variant_get("document", path, kind) for name, (path, kind) in split.items()})


def new_conferences(asked: DataFrame) -> DataFrame:
    """asked (organizer_id, data: JSON text) with id, and reason: 'conference' where data isn't a JSON object with a non-empty id and a title, null for what can be stored."""
    rows = asked.withColumn("_v", F.try_parse_json("data"))
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get("_v", p, "variant")) == "STRING", F.try_variant_get("_v", p, "string"))
    rows = rows.withColumn("id", text("$.id"))
    good = (F.col("id") != "") & (strip(text("$.title")) != "")
    return rows.withColumn("reason", F.when(~F.coalesce(good, F.lit(False)), "conference")).drop("_v")


def with_feedback(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """feedback and new rows, whose ratings are a map, with their mean to two decimals."""
    rows = new.withColumn("overall_score", mean_score(F.col("ratings"), 2)).withColumn("ratings", F.to_json("ratings"))
    return feedback.unionByName(rows.select(feedback.columns))


def feedback_summaries(feedback: DataFrame, conferences: DataFrame) -> DataFrame:
    """organizer_id, average, n over the feedback on an organizer's conferences; 0 for those without any."""
    own = conferences.select("organizer_id", F.col("id").alias("conference_id"))
    found = own.join(feedback.select("conference_id", "overall_score"), "conference_id", "left").groupBy("organizer_id")
    return found.agg(F.coalesce(F.avg("overall_score"), F.lit(0.0)).alias("average"), F.count("overall_score").alias("n"))


def organizer_feed(actions: DataFrame, submissions: DataFrame, users: DataFrame, conferences: DataFrame, organizer: str | None = None) -> DataFrame:
    """Interest actions and submissions for an organizer's conferences, or each one's, newest first; columns that one kind lacks are null.

    The conferences come by inner join, so that an organizer without any has an empty feed. All feeds at once are placed in runs on disk.
    Ids of the feed have a prefix of the kind.
    """
    own = conferences.select("organizer_id", F.col("id").alias("conference_id"))
    if organizer is not None:
        own = own.filter(F.col("organizer_id") == organizer)
    who = users.select(F.col("id").alias("actor_id"), F.col("name").alias("actor"), F.col("organization").alias("actor_org"))
    interest = actions.join(own, "conference_id").select("organizer_id", F.concat(F.lit("cia_"), "id").alias("id"), "kind", F.col("user_id").alias("actor_id"), "conference_title", F.col("created_at").alias("at"))
    sent = submissions.join(own, "conference_id").select("organizer_id", F.concat(F.lit("sub_"), "id").alias("id"), F.lit("abstract_submission").alias("kind"), F.col("submitter_id").alias("actor_id"), "conference_title", F.col("submission_date").alias("at"), F.col("title").alias("submission_title"))
    feed = interest.unionByName(sent, allowMissingColumns=True).join(who, "actor_id")
    return newest_first(feed, "organizer_id", "at", "id", few=organizer is None).drop("actor_id")


def attended(registrations: DataFrame, conferences: DataFrame) -> DataFrame:
    """Registrations with their conference's title; the registration's own, then a fixed text, where the conference isn't known. The day comes from either form of time."""
    titles = conferences.select(F.col("id").alias("conference_id"), F.col("title").alias("known"))
    rows = registrations.join(titles, "conference_id", "left")
    return rows.select("user_id", "conference_id", blank_or(F.col("known"), blank_or(F.col("conference_title"), F.lit("Conference"))).alias("title"), F.to_date("registered_at").alias("day"))


def profile_history(achievements: DataFrame, lived: DataFrame) -> DataFrame:
    """Achievements and the items of timelines (id, title, year, ordinal each), the first of each title and year, latest year first, with place per profile."""
    both = achievements.withColumn("source", F.lit(0)).unionByName(lived.withColumn("source", F.lit(1)))
    w = Window.partitionBy("id", "title", "year").orderBy("source", "ordinal")
    once = both.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return placed(once, ["id"], F.col("year").desc_nulls_last(), F.col("source"), F.col("ordinal"), F.col("title")).drop("source", "ordinal")


def track_totals(sessions: DataFrame) -> DataFrame:
    """sessions: oral, poster per track. Their totals, and the most sessions of one track, 1 at least."""
    most = F.max(F.greatest("oral", "poster"))
    return sessions.agg(F.coalesce(F.sum("oral"), F.lit(0)).alias("oral"), F.coalesce(F.sum("poster"), F.lit(0)).alias("poster"), F.greatest(F.lit(1), F.coalesce(most, F.lit(0))).alias("most"))


def reviewed_titles(reviews: DataFrame, submissions: DataFrame) -> DataFrame:
    """reviewer_id, conferences: how many different conferences a reviewer has reviewed for."""
    title = submissions.select(F.col("id").alias("submission_id"), "conference_title")
    return reviews.select("reviewer_id", "submission_id").join(title, "submission_id").groupBy("reviewer_id").agg(F.count_distinct("conference_title").alias("conferences"))


def agenda_places(items: DataFrame, day: str, time: str, *order: str) -> DataFrame:
    """Program items by day, then time as text in the order of the locale, then the given columns, with place in the whole day."""
    return placed(items, [day], by_locale(F.col(time)), *(F.col(c) for c in order))


def removed_at(items: Column, place: int) -> Column:
    """An array without the element at a place (from 0)."""
    return F.filter(items, lambda x, i: i != place)
