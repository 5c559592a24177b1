"""The services as registered queries over the stand-in tables, each with SQL for DuckDB that was written on its own.

Lists that the application shows in an order carry their place; nested results are shown as text.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import dates, scores, text
from plenum.operators import ordering, tables, trigrams
from plenum.plans.standins import Tables, with_ctes
from plenum.services import activity, discovery, messages, people, posts, sponsors
from plenum.sources import schemas
from plenum.sources.tables import work_folder

#: What stands for the present, so that results don't change.
NOW = "TIMESTAMP '2024-06-01 12:00:00'"

QUERIES: dict = {}


def query(sql: str | None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _joined(items: Column | str, one=lambda x: x, by: str = ",") -> Column:
    return F.array_join(F.transform(items, one), by)


def _seconds(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


SECONDS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# Submissions and reviews


@query(
    """SELECT s.id, submitter_id, row_number() OVER (PARTITION BY submitter_id ORDER BY submission_date DESC, s.id DESC) - 1 AS place, conference_title, CASE o_orderpriority WHEN '5-LOW' THEN 'General' WHEN '1-URGENT' THEN 'General' ELSE o_orderpriority END AS track,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority || ',' || o_orderstatus END AS keywords, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS affiliation, o_orderpriority AS co_authors, strftime(submission_date, '%Y-%m-%d') AS day, coalesce(n, 0) AS reviews, coalesce(who, '') AS reviewers,
    CASE WHEN o_orderstatus = 'F' THEN 'completed,completed,completed,completed,completed' WHEN n > 0 THEN 'completed,completed,completed,current,upcoming' ELSE 'completed,current,upcoming,upcoming,upcoming' END AS timeline
    FROM submissions s LEFT JOIN (SELECT submission_id, count(*) AS n, string_agg(reviewer_id, ',' ORDER BY created_at, id) AS who FROM reviews GROUP BY submission_id) r ON submission_id = s.id"""
)
def submission_documents(t: Tables) -> DataFrame:
    d = activity.submission_documents(t.submissions, t.reviews)
    return d.select("id", "submitter_id", "place", "conference_title", "track", _joined("keywords").alias("keywords"), "author.affiliation", _joined("co_authors", lambda a: a["name"]).alias("co_authors"), "day", F.size("reviews").cast("long").alias("reviews"), _joined("reviews", lambda r: r["reviewer_id"]).alias("reviewers"), _joined("timeline", lambda s: s["state"]).alias("timeline"))


@query("SELECT submission_id AS id, arg_min(recommendation, created_at || id) AS recommendation FROM reviews WHERE reviewer_id = 's3' GROUP BY submission_id")
def own_reviews(t: Tables) -> DataFrame:
    d = activity.review_of(activity.submission_documents(t.submissions, t.reviews), "s3")
    return activity.pending_and_done(d, "s3")[1].select("id", "mine.recommendation")


@query("SELECT id FROM submissions WHERE id NOT IN (SELECT submission_id FROM reviews WHERE reviewer_id = 's3')")
def waiting_for_review(t: Tables) -> DataFrame:
    return activity.pending_and_done(activity.submission_documents(t.submissions, t.reviews), "s3")[0].select("id")


@query("SELECT id, round((CAST(l_quantity AS INTEGER) % 5 + l_linenumber) / 2.0, 1) AS one_decimal, round((CAST(l_quantity AS INTEGER) % 5 + l_linenumber) / 2.0, 2) AS two_decimals, CAST(2 AS BIGINT) AS n FROM reviews")
def review_score_means(t: Tables) -> DataFrame:
    scored = t.reviews.select("id", F.from_json("scores", "map<string,double>").alias("scores"))
    return scored.select("id", activity.mean_score(F.col("scores"), 1).alias("one_decimal"), activity.mean_score(F.col("scores"), 2).alias("two_decimals"), F.size("scores").cast("long").alias("n"))


@query("SELECT r.id, round((CAST(l_quantity AS INTEGER) % 5 + l_linenumber) / 2.0, 1) AS overall_score, name AS reviewer_name FROM reviews r JOIN users u ON u.id = reviewer_id")
def reviews_added(t: Tables) -> DataFrame:
    new = t.reviews.select("id", "submission_id", "reviewer_id", F.from_json("scores", "map<string,double>").alias("scores"), F.lit("fine").alias("comments_to_author"), "recommendation", "created_at")
    return activity.add_reviews(schemas.empty(t.spark, "submission_reviews"), new, t.users).select("id", "overall_score", "reviewer_name")


@query(
    """SELECT s.id, CASE WHEN rev AND NOT coalesce(tm > TIMESTAMP '1998-01-01', false) THEN 'Revised Abstract Submitted' WHEN rec = 'Accept' THEN 'Accepted for Oral Presentation' WHEN rec = 'Reject' THEN 'Rejected' WHEN rec = 'Minor Revision' THEN 'Revisions Requested' ELSE status END AS status, CASE WHEN rev THEN 1 ELSE 0 END AS revisions_count
    FROM (SELECT *, o_orderstatus = 'O' AS rev FROM submissions) s LEFT JOIN (SELECT submission_id, arg_max(recommendation, strftime(created_at, '%Y%m%d%H%M%S') || id) AS rec, max(created_at) AS tm FROM reviews GROUP BY submission_id) r ON submission_id = s.id"""
)
def submission_statuses(t: Tables) -> DataFrame:
    revisions = t.submissions.filter("status = 'Submitted'").select(F.col("id").alias("submission_id"), F.expr("TIMESTAMP '1998-01-01'").alias("created_at"))
    return activity.statuses(t.submissions, t.reviews, revisions).select("id", "status", "revisions_count")


@query("SELECT reviewer_id, count(DISTINCT conference_title) AS conferences FROM reviews r JOIN submissions s ON s.id = submission_id GROUP BY reviewer_id")
def conferences_reviewed_for(t: Tables) -> DataFrame:
    return activity.reviewed_titles(t.reviews, t.submissions)


@query("SELECT CAST(sum(oral) AS BIGINT) AS oral, CAST(sum(poster) AS BIGINT) AS poster, greatest(1, max(greatest(oral, poster))) AS most FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS oral, count(*) FILTER (WHERE o_orderstatus = 'P') AS poster FROM orders GROUP BY 1) s")
def track_totals(t: Tables) -> DataFrame:
    per = tables.counted(t.raw("orders"), ["o_orderpriority"], oral=F.col("o_orderstatus") == "F", poster=F.col("o_orderstatus") == "P")
    return activity.track_totals(per)


# Registrations, interactions, feeds


@query(f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY registered_at DESC, id DESC) - 1 AS place, conference_id, package_name, {SECONDS.format('registered_at')} AS at FROM registrations")
def registrations_by_user(t: Tables) -> DataFrame:
    return activity.registrations_of(t.registrations).select("user_id", "place", "conference_id", "package_name", _seconds("registered_at").alias("at"))


@query("SELECT conference_id, row_number() OVER (ORDER BY registered_at DESC, id DESC) - 1 AS place FROM registrations WHERE user_id = 'u7'")
def registrations_of_one_user(t: Tables) -> DataFrame:
    return activity.registrations_of(t.registrations, "u7").select("conference_id", "place")


@query("SELECT conference_id, count(*) AS n FROM registrations GROUP BY conference_id")
def registration_counts(t: Tables) -> DataFrame:
    return activity.registration_counts(t.registrations)


@query("SELECT organizer_id, string_agg(id || '=' || n, ',' ORDER BY id) AS counts FROM (SELECT c.organizer_id, c.id, count(r.id) AS n FROM conferences c LEFT JOIN registrations r ON c.id = conference_id GROUP BY ALL) x GROUP BY organizer_id")
def registration_maps(t: Tables) -> DataFrame:
    found = activity.registration_maps(t.registrations, t.conferences)
    return found.select("organizer_id", _joined(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("counts"))


_FIELDS = {"title": "$.title string", "city": "$.location.city string", "first_topic": "$.topics[0] string", "price": "$.price double"}
_DOCUMENT = "json_valid(data) AS valid, CASE WHEN json_valid(data) THEN data->>'$.title' END AS title, CASE WHEN json_valid(data) THEN data->>'$.location.city' END AS city, CASE WHEN json_valid(data) THEN data->>'$.topics[0]' END AS first_topic, CASE WHEN json_valid(data) THEN TRY_CAST(data->>'$.price' AS DOUBLE) END AS price"


@query(f"SELECT organizer_id, row_number() OVER (PARTITION BY organizer_id ORDER BY created_at DESC NULLS LAST, id DESC) - 1 AS place, id, {_DOCUMENT} FROM created")
def conferences_by_organizer(t: Tables) -> DataFrame:
    rows = activity.conference_fields(activity.conferences_of(t.created_conferences), **_FIELDS)
    return rows.select("organizer_id", "place", "id", F.col("document").isNotNull().alias("valid"), *_FIELDS)


@query(f"SELECT organizer_id, id, {_DOCUMENT}, {SECONDS.format('created_at')} AS created_at FROM created")
def all_conferences(t: Tables) -> DataFrame:
    rows = activity.conference_fields(activity.all_conferences(t.created_conferences), **_FIELDS)
    return rows.select("organizer_id", "id", F.col("document").isNotNull().alias("valid"), *_FIELDS, _seconds("created_at").alias("created_at"))


@query("SELECT id AS asked, CASE WHEN NOT json_valid(data) OR json_type(data, '$.id') IS DISTINCT FROM 'VARCHAR' OR coalesce(trim(data->>'$.title'), '') = '' OR json_type(data, '$.title') <> 'VARCHAR' THEN 'conference' END AS reason FROM created")
def conferences_checked(t: Tables) -> DataFrame:
    asked = t.created_conferences.select(F.col("id").alias("asked"), "organizer_id", "data")
    return activity.new_conferences(asked).select("asked", "reason")


@query("SELECT 'u' || o_custkey AS organizer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'b' || o_orderkey DESC) - 1 AS place, 'b' || o_orderkey AS id, o_orderpriority AS recipient_group FROM orders")
def broadcasts_by_organizer(t: Tables) -> DataFrame:
    sent = t.raw("orders").selectExpr("concat('b', o_orderkey) AS id", "concat('u', o_custkey) AS organizer_id", "o_orderpriority AS recipient_group", "o_orderstatus AS subject", "o_orderdate AS created_at")
    return activity.broadcasts_of(sent).select("organizer_id", "place", "id", "recipient_group")


@query("SELECT id, round((a + b) / 2.0, 2) AS overall_score FROM (SELECT 'f' || event_id AS id, user_id % 5 + 1 AS a, event_id % 4 + 1 AS b FROM events) e")
def feedback_added(t: Tables) -> DataFrame:
    new = t.raw("events").selectExpr("concat('f', event_id) AS id", "concat('u', user_id) AS user_id", "map('venue', CAST(user_id % 5 + 1 AS DOUBLE), 'talks', CAST(event_id % 4 + 1 AS DOUBLE)) AS ratings")
    old = new.limit(0).selectExpr("id", "user_id", "to_json(ratings) AS ratings", "CAST(NULL AS DOUBLE) AS overall_score")
    return activity.with_feedback(old, new).select("id", "overall_score")


@query("SELECT user_id, coalesce(string_agg(conference_id, ',' ORDER BY conference_id) FILTER (WHERE type = 'saved'), '') AS saved, coalesce(string_agg(conference_id, ',' ORDER BY conference_id) FILTER (WHERE type = 'followed'), '') AS followed FROM interactions GROUP BY user_id")
def saved_and_followed(t: Tables) -> DataFrame:
    return activity.interactions_of(t.interactions).select("user_id", _joined("saved").alias("saved"), _joined("followed").alias("followed"))


@query("SELECT user_id AS reviewer_id, string_agg(conference_id, ',' ORDER BY conference_id) AS opportunities FROM interactions GROUP BY user_id")
def volunteered_for(t: Tables) -> DataFrame:
    v = t.interactions.select(F.col("user_id").alias("reviewer_id"), F.col("conference_id").alias("opportunity_id"))
    return activity.opportunities_of(v).select("reviewer_id", _joined("opportunities").alias("opportunities"))


@query(
    f"""SELECT organizer_id, row_number() OVER (PARTITION BY organizer_id ORDER BY tm DESC, id DESC) - 1 AS place, id, kind, actor, {SECONDS.format('tm')} AS at, submission_title FROM (
    SELECT organizer_id, 'cia_' || a.id AS id, kind, name AS actor, a.created_at AS tm, NULL AS submission_title FROM actions a JOIN conferences c ON c.id = conference_id JOIN users u ON u.id = user_id
    UNION ALL SELECT organizer_id, 'sub_' || s.id, 'abstract_submission', name, submission_date, s.title FROM submissions s JOIN conferences c ON c.id = conference_id JOIN users u ON u.id = submitter_id) f"""
)
def organizer_feeds(t: Tables) -> DataFrame:
    feed = activity.organizer_feed(t.actions, t.submissions, t.users, t.conferences)
    return feed.select("organizer_id", "place", "id", "kind", "actor", _seconds("at").alias("at"), "submission_title")


@query("SELECT organizer_id, round(coalesce(avg(rating), 0.0), 6) AS average, count(rating) AS n FROM conferences c LEFT JOIN (SELECT 'c' || (l_partkey + 20) AS cid, l_quantity AS rating FROM lineitem WHERE l_returnflag = 'N') f ON cid = c.id GROUP BY organizer_id")
def feedback_summaries(t: Tables) -> DataFrame:
    feedback = t.raw("lineitem").filter("l_returnflag = 'N'").selectExpr("concat('c', CAST(l_partkey + 20 AS STRING)) AS conference_id", "l_quantity AS overall_score")
    return activity.feedback_summaries(feedback, t.conferences).withColumn("average", F.round("average", 6))


@query("SELECT user_id, conference_id, coalesce(nullif(c.title, ''), nullif(conference_title, ''), 'Conference') AS title, CAST(registered_at AS DATE) AS day FROM registrations LEFT JOIN conferences c ON c.id = conference_id")
def attended_titles(t: Tables) -> DataFrame:
    return activity.attended(t.registrations, t.conferences)


@query(
    """SELECT id, title, year, row_number() OVER (PARTITION BY id ORDER BY year DESC, source, ordinal, title) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY id, title, year ORDER BY source, ordinal) AS r FROM (
    SELECT o_custkey AS id, o_orderpriority AS title, year(o_orderdate) AS year, o_orderkey AS ordinal, 0 AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, unnest([o_orderpriority, o_orderstatus]), year(o_orderdate), o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F') u) v WHERE r = 1"""
)
def profile_histories(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.col("o_custkey").alias("id"), "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("ordinal"))
    achieved = rows.filter("o_orderstatus = 'F'").select("id", F.col("o_orderpriority").alias("title"), "year", "ordinal")
    timelines = rows.filter("o_orderstatus <> 'F'").select("id", F.array("o_orderpriority", "o_orderstatus").alias("items"), "year", "ordinal")
    lived = timelines.select("id", F.explode("items").alias("title"), "year", "ordinal")
    return activity.profile_history(achieved, lived).withColumn("year", F.col("year").cast("long"))


@query(
    """SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY tm COLLATE en, id) - 1 AS place FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN lower(o_orderpriority) WHEN 'O' THEN replace(o_orderpriority, 'E', 'É') ELSE o_orderpriority END AS tm FROM orders) x"""
)
def program_by_day_and_time(t: Tables) -> DataFrame:
    items = t.raw("orders").selectExpr("to_date(o_orderdate) AS day", "CASE o_orderstatus WHEN 'F' THEN lower(o_orderpriority) WHEN 'O' THEN replace(o_orderpriority, 'E', 'É') ELSE o_orderpriority END AS time", "o_orderkey AS id")
    return activity.agenda_places(items, "day", "time", "id").drop("time")


# Sponsors


@query(
    """SELECT p.id, organizer_id, row_number() OVER (PARTITION BY organizer_id ORDER BY created_at DESC, p.id DESC) - 1 AS place, benefits, greatest(0, total_slots - coalesce(n, 0)) AS available_slots
    FROM packages p LEFT JOIN (SELECT package_id, count(*) AS n FROM applications WHERE status = 'Approved' GROUP BY 1) a ON package_id = p.id"""
)
def package_documents(t: Tables) -> DataFrame:
    return sponsors.package_documents(t.packages, t.applications).select("id", "organizer_id", "place", _joined("benefits").alias("benefits"), "available_slots")


@query(f"SELECT sponsor_id, row_number() OVER (PARTITION BY sponsor_id ORDER BY a.created_at DESC, a.id DESC) - 1 AS place, tier, p.conference_title, status, {SECONDS.format('a.created_at')} AS at FROM applications a JOIN packages p ON p.id = package_id")
def applications_by_sponsor(t: Tables) -> DataFrame:
    return sponsors.applications_of(t.applications, t.packages).select("sponsor_id", "place", "tier", "conference_title", "status", _seconds("created_at").alias("at"))


_HISTORY = "SELECT sponsor_id, p.conference_title AS title, tier, year(coalesce(decided_at, TIMESTAMP '2024-06-01 12:00:00')) AS year, row_number() OVER (PARTITION BY sponsor_id ORDER BY decided_at DESC NULLS LAST, a.id DESC) - 1 AS place FROM applications a JOIN packages p ON p.id = package_id WHERE status = 'Approved'"


@query(_HISTORY)
def sponsor_histories(t: Tables) -> DataFrame:
    return sponsors.history(t.applications, t.packages, F.expr(NOW)).withColumn("year", F.col("year").cast("long"))


@query(
    f"""SELECT 'application' AS kind, a.id, organizer_id AS owner, row_number() OVER (PARTITION BY organizer_id ORDER BY a.created_at DESC, a.id DESC) - 1 AS place, a.sponsor_id, tier, status, coalesce(nullif(u.organization, ''), nullif(u.name, ''), 'Unknown Sponsor') AS title, round(coalesce(rating, 0.0), 6) AS rating, coalesce(n_reviews, 0) AS reviews, coalesce(approved, 0) AS approved, coalesce(md5(h), md5('')) AS history, CAST(NULL AS BIGINT) AS year
    FROM applications a JOIN packages p ON p.id = package_id LEFT JOIN users u ON u.id = a.sponsor_id LEFT JOIN (SELECT sponsor_id, avg(rating) AS rating, count(*) AS n_reviews FROM sponsor_reviews GROUP BY 1) r ON r.sponsor_id = a.sponsor_id
    LEFT JOIN (SELECT sponsor_id, count(*) AS approved FROM applications WHERE status = 'Approved' GROUP BY 1) s ON s.sponsor_id = a.sponsor_id
    LEFT JOIN (SELECT sponsor_id, string_agg(title || '/' || tier || '/' || year, ',' ORDER BY place) AS h FROM ({_HISTORY}) x GROUP BY 1) g ON g.sponsor_id = a.sponsor_id
    UNION ALL SELECT 'history', NULL, sponsor_id, place, sponsor_id, tier, NULL, title, NULL, NULL, NULL, NULL, year FROM ({_HISTORY}) h"""
)
def applicant_documents(t: Tables) -> DataFrame:
    """The applications of each organizer with a digest of their sponsor's whole history, and the rows of each history."""

    def digest(past: Column) -> Column:
        told = _joined(past, lambda h: F.concat(h["title"], F.lit("/"), h["tier"], F.lit("/"), h["year"].cast("string")))
        return F.md5(told.cast("binary"))

    d = sponsors.applicants(t.applications, t.packages, t.users, t.sponsor_reviews, now=F.expr(NOW), told=digest)
    d = d.select(F.lit("application").alias("kind"), "id", F.col("organizer_id").alias("owner"), "place", "sponsor_id", "tier", "status", F.col("company").alias("title"), F.round("rating", 6).alias("rating"), "reviews", "approved", "history")
    past = sponsors.history(t.applications, t.packages, F.expr(NOW)).select(F.lit("history").alias("kind"), F.col("sponsor_id").alias("owner"), "place", "sponsor_id", "tier", "title", F.col("year").cast("long").alias("year"))
    return d.unionByName(past, allowMissingColumns=True)


@query("SELECT a.id, row_number() OVER (ORDER BY a.created_at DESC, a.id DESC) - 1 AS place, coalesce(approved, 0) AS approved FROM applications a JOIN packages p ON p.id = package_id LEFT JOIN (SELECT sponsor_id, count(*) AS approved FROM applications WHERE status = 'Approved' GROUP BY 1) s ON s.sponsor_id = a.sponsor_id WHERE organizer_id = 'Brand#12'")
def applicants_of_one_organizer(t: Tables) -> DataFrame:
    return sponsors.applicants(t.applications, t.packages, t.users, t.sponsor_reviews, "Brand#12").select("id", "place", "approved")


@query("SELECT DISTINCT organizer_id, sponsor_id, coalesce(nullif(u.organization, ''), nullif(u.name, ''), 'Unknown Sponsor') AS company FROM applications a JOIN packages p ON p.id = package_id LEFT JOIN users u ON u.id = sponsor_id WHERE status = 'Approved'")
def reviewable_sponsors(t: Tables) -> DataFrame:
    return sponsors.reviewable(t.applications, t.packages, t.users)


@query("SELECT p.organizer_id, a.sponsor_id, bool_or(coalesce(x.allowed, false)) AS allowed FROM (SELECT DISTINCT organizer_id FROM packages UNION SELECT 'nobody') p CROSS JOIN (SELECT DISTINCT sponsor_id FROM applications WHERE status = 'Pending') a LEFT JOIN (SELECT organizer_id, sponsor_id, true AS allowed FROM applications JOIN packages q ON q.id = package_id WHERE status = 'Approved') x ON x.organizer_id = p.organizer_id AND x.sponsor_id = a.sponsor_id WHERE EXISTS (SELECT 1 FROM applications b JOIN packages q ON q.id = b.package_id WHERE b.status = 'Pending' AND b.sponsor_id = a.sponsor_id AND (q.organizer_id = p.organizer_id OR p.organizer_id = 'nobody')) GROUP BY ALL")
def sponsors_that_may_be_reviewed(t: Tables) -> DataFrame:
    """Whether organizers may review the sponsors with a pending application to them; nobody stands for one without packages."""
    pending = t.applications.filter("status = 'Pending'").join(t.packages.select(F.col("id").alias("package_id"), "organizer_id"), "package_id")
    asked = pending.select(F.explode(F.array("organizer_id", F.lit("nobody"))).alias("organizer_id"), "sponsor_id").distinct()
    return sponsors.may_review(asked, t.applications, t.packages)


@query("SELECT sponsor_id, row_number() OVER (PARTITION BY sponsor_id ORDER BY r.created_at DESC, r.id DESC) - 1 AS place, name AS reviewer, 'Organizer' AS reviewer_role, rating, strftime(r.created_at, '%Y-%m-%d') AS day FROM sponsor_reviews r JOIN users u ON u.id = organizer_id")
def reviews_by_sponsor(t: Tables) -> DataFrame:
    return sponsors.reviews_of(t.sponsor_reviews, t.users)


@query(
    """SELECT a.id, CASE WHEN hit THEN 'Approved' ELSE status END AS status, strftime(CASE WHEN hit THEN TIMESTAMP '2024-06-01 12:00:00' ELSE decided_at END, '%Y-%m-%d %H:%M:%S') AS decided_at
    FROM (SELECT a.*, status = 'Pending' AND organizer_id = 'Brand#12' AS hit FROM applications a JOIN packages p ON p.id = package_id) a"""
)
def applications_decided(t: Tables) -> DataFrame:
    decisions = t.applications.filter("status = 'Pending'").select("id", F.lit("Brand#12").alias("organizer_id"), F.lit("Approved").alias("status"))
    return sponsors.decided(t.applications, t.packages, decisions, F.expr(NOW)).select("id", "status", _seconds("decided_at").alias("decided_at"))


@query(
    """SELECT id, status, CASE WHEN n = 0 THEN 'New sponsor, not yet reviewed' WHEN r >= 3.0 THEN 'Rated ' || printf('%.1f', round(r, 1)) || ' by organizers' ELSE 'Rated ' || printf('%.1f', round(r, 1)) || ', below the required 3.0' END AS reason
    FROM (SELECT u.id, count(rating) AS n, round(avg(rating), 6) AS r, count(rating) = 0 OR avg(rating) >= 3.0 AS status FROM users u LEFT JOIN sponsor_reviews s ON s.sponsor_id = u.id WHERE role = 'sponsor' GROUP BY u.id) x"""
)
def verification_reasons(t: Tables) -> DataFrame:
    rated = t.sponsor_reviews.groupBy(F.col("sponsor_id").alias("id")).agg(F.avg("rating").alias("r"), F.count(F.lit(1)).alias("n"))
    rows = t.users.filter("role = 'sponsor'").select("id").join(rated, "id", "left").withColumn("r", F.round("r", 6))
    return rows.select("id", sponsors.verified(F.col("n"), F.col("r")).alias("status"), sponsors.verification_reason(F.col("n"), F.col("r")).alias("reason"))


@query("SELECT tier, count(DISTINCT a.sponsor_id) AS sponsors FROM applications a JOIN packages p ON p.id = package_id LEFT JOIN (SELECT sponsor_id, avg(rating) AS r FROM sponsor_reviews GROUP BY 1) s ON s.sponsor_id = a.sponsor_id WHERE r IS NULL OR r >= 3.0 GROUP BY tier")
def verified_sponsors_by_tier(t: Tables) -> DataFrame:
    rated = t.sponsor_reviews.groupBy("sponsor_id").agg(F.avg("rating").alias("r"), F.count(F.lit(1)).alias("n"))
    rows = t.applications.join(t.packages.select(F.col("id").alias("package_id"), "tier"), "package_id").join(rated, "sponsor_id", "left")
    return rows.filter(sponsors.verified(F.col("n"), F.col("r"))).groupBy("tier").agg(F.count_distinct("sponsor_id").alias("sponsors"))


@query(
    """SELECT p.id, conference_id, row_number() OVER (PARTITION BY conference_id ORDER BY score DESC NULLS LAST, p.id) - 1 AS place, opportunity, score FROM (SELECT p.*, o.name AS opportunity, CASE WHEN o.id IS NOT NULL THEN CAST(greatest(35, least(99, floor(80 * share + 14 + 0.5))) AS BIGINT) END AS score
    FROM packages p LEFT JOIN (VALUES ('opp0', 'Opportunity 0', 0.5), ('opp1', 'Opportunity 1', 0.0), ('opp2', 'Opportunity 2', 0.0), ('opp3', 'Opportunity 3', 0.0), ('opp4', 'Opportunity 4', 1.0)) o(id, name, share) ON o.id = split_part(source_opportunity_id, '__', 1)) p"""
)
def suggested_matches(t: Tables) -> DataFrame:
    return sponsors.matched(t.packages, t.opportunities, F.lit("MACHINERY"), F.lit(3.5)).select("id", "conference_id", "place", "opportunity", "score")


@query("SELECT id FROM packages WHERE coalesce(source_opportunity_id, '') = ''")
def packages_standing_alone(t: Tables) -> DataFrame:
    return sponsors.standing_alone(t.packages).select("id")


@query("SELECT o.id, tier, coalesce('opp' || o.n || '__' || tier IN (SELECT source_opportunity_id FROM packages WHERE source_opportunity_id IS NOT NULL), false) AS active FROM (SELECT 'opp' || n AS id, n FROM range(5) r(n)) o, (VALUES ('PROMO'), ('SMALL')) t(tier)")
def catalog_tiers(t: Tables) -> DataFrame:
    return sponsors.catalog(t.opportunities, t.packages).select("id", "tier", "active")


@query("SELECT p.id, my_status FROM packages p LEFT JOIN (SELECT package_id, arg_max(status, strftime(created_at, '%Y%m%d%H%M%S') || id) AS my_status FROM applications WHERE sponsor_id = 's5' GROUP BY 1) a ON package_id = p.id")
def packages_with_own_application(t: Tables) -> DataFrame:
    return sponsors.with_application(t.packages, t.applications, "s5").select("id", "my_status")


@query("SELECT organizer_id, round(sum(e), 2) AS revenue, greatest(1.0, round(max(e), 2)) AS most FROM (SELECT organizer_id, price * (total_slots - greatest(0, total_slots - coalesce(n, 0))) AS e FROM packages p LEFT JOIN (SELECT package_id, count(*) AS n FROM applications WHERE status = 'Approved' GROUP BY 1) a ON package_id = p.id) x GROUP BY organizer_id")
def organizer_revenue(t: Tables) -> DataFrame:
    return sponsors.revenue(t.packages, t.applications)


@query("SELECT u.id, coalesce(nullif(organization, ''), name) AS company, coalesce(country, '') AS country, round(coalesce(r, 0.0), 6) AS rating, coalesce(n, 0) = 0 OR r >= 3.0 AS verified FROM users u LEFT JOIN (SELECT sponsor_id, avg(rating) AS r, count(*) AS n FROM sponsor_reviews GROUP BY 1) s ON sponsor_id = u.id WHERE role = 'sponsor'")
def sponsor_profiles(t: Tables) -> DataFrame:
    stats = sponsors.statistics(t.applications, t.sponsor_reviews)
    return sponsors.profile(t.users, stats).select("id", "identity.company", "identity.country", F.round("derived.rating", 6).alias("rating"), "derived.verified")


@query("SELECT id FROM packages WHERE conference_id IN (SELECT id FROM conferences WHERE organizer_id = 'Brand#12')")
def packages_for_own_conferences(t: Tables) -> DataFrame:
    own = t.conferences.filter("organizer_id = 'Brand#12'").select(F.col("id").alias("conference_id"))
    return t.packages.join(own, "conference_id", "left_semi").select("id")


# Messages


@query(
    f"""WITH sides AS (SELECT conversation_id, sender_id AS me, other AS partner_id FROM messages UNION SELECT conversation_id, other, sender_id FROM messages), last AS (SELECT conversation_id, arg_max(text, created_at) AS t, max(created_at) AS tm FROM messages GROUP BY 1), un AS (SELECT conversation_id, sender_id, count(*) AS n FROM messages WHERE read_at IS NULL GROUP BY 1, 2)
    SELECT me, row_number() OVER (PARTITION BY me ORDER BY tm DESC, conversation_id DESC) - 1 AS place, partner_id, name AS partner, t AS last_message, {SECONDS.format('tm')} AS last_time, coalesce(n, 0) AS unread
    FROM (SELECT s.conversation_id, me, partner_id, t, tm, n FROM sides s JOIN last l ON l.conversation_id = s.conversation_id LEFT JOIN un ON un.conversation_id = s.conversation_id AND un.sender_id = partner_id
          UNION ALL SELECT id, user_a, user_b, NULL, created_at, NULL FROM quiet UNION ALL SELECT id, user_b, user_a, NULL, created_at, NULL FROM quiet) x JOIN users u ON u.id = partner_id"""
)
def conversations_by_user(t: Tables) -> DataFrame:
    rows = messages.conversations_of(t.conversations.unionByName(t.quiet_conversations), t.messages, t.users)
    return rows.select("me", "place", "partner_id", "partner", "last_message", _seconds("last_time").alias("last_time"), "unread")


@query("SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS place, id, sender_id, text, read_at IS NOT NULL AS read FROM messages")
def threads(t: Tables) -> DataFrame:
    return messages.thread(t.messages).drop("created_at")


@query("SELECT me, coalesce(n, 0) AS unread FROM (SELECT sender_id AS me FROM messages UNION SELECT other FROM messages) e LEFT JOIN (SELECT other AS m, count(*) AS n FROM messages WHERE read_at IS NULL GROUP BY 1) x ON m = me")
def unread_by_user(t: Tables) -> DataFrame:
    return messages.unread_totals(t.conversations, t.messages)


@query("SELECT other AS me, count(*) AS unread FROM messages m JOIN users u ON u.id = sender_id WHERE read_at IS NULL GROUP BY other")
def unread_summed_over_threads(t: Tables) -> DataFrame:
    listed = messages.conversations_of(t.conversations, t.messages, t.users)
    return listed.groupBy("me").agg(F.sum("unread").alias("unread")).filter("unread > 0")


@query("SELECT least(a, b) AS user_a, greatest(a, b) AS user_b FROM (SELECT sender_id AS a, other AS b FROM messages UNION SELECT 'u1', 'u140' UNION SELECT 'u999', 'u1000') x GROUP BY ALL")
def conversations_opened(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([("n1", "u140", "u1"), ("n2", "u1", "u140"), ("n3", "u999", "u1000"), ("n4", "u5", "u5")], "id string, a string, b string").withColumn("created_at", F.expr(NOW))
    return messages.opened(t.conversations, asked).select("user_a", "user_b")


@query("SELECT other AS \"to\", 'message' AS type, sender_id AS partner_id, name AS partner, m.id AS message_id, text FROM messages m JOIN users u ON u.id = sender_id")
def message_events(t: Tables) -> DataFrame:
    return messages.pushed(t.messages, t.conversations, t.users).select("to", "type", "partner_id", F.col("partner.name").alias("partner"), F.col("message.id").alias("message_id"), "message.text")


@query("SELECT id, name FROM users WHERE name ILIKE '%r#0000_01%' AND id <> 'u11' ORDER BY name, id LIMIT 10")
def people_search(t: Tables) -> DataFrame:
    """The first ten for a query with white space around it; an empty query adds nobody."""
    return messages.people_search(t.users, " r#0000_01 ", "u11").unionByName(messages.people_search(t.users, "  ", "u11")).select("id", "name")


@query(
    """WITH un AS (SELECT other AS me, conversation_id, sender_id, count(*) AS n FROM messages WHERE read_at IS NULL GROUP BY ALL), last AS (SELECT conversation_id, max(created_at) AS tm FROM messages GROUP BY 1)
    SELECT me, id, message, row_number() OVER (PARTITION BY me ORDER BY tm DESC, id DESC) - 1 AS place FROM (SELECT me, 'msg_' || un.conversation_id AS id, 'You have ' || n || ' unread message' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' from ' || name AS message, tm FROM un JOIN users u ON u.id = sender_id JOIN last l ON l.conversation_id = un.conversation_id
    UNION ALL SELECT 'u' || (CAST(substr(a.id, 2) AS BIGINT) % 23), 'act_' || a.id, CASE kind WHEN 'committee_interest' THEN name || ' would like to join the committee of ' || conference_title ELSE name || ' asked about sponsoring ' || conference_title END, a.created_at FROM actions a JOIN users u ON u.id = user_id) x"""
)
def notification_lists(t: Tables) -> DataFrame:
    who = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("actor"))
    acts = t.actions.join(who, "user_id").select(F.concat(F.lit("u"), (F.expr("CAST(substr(id, 2) AS BIGINT) % 23")).cast("string")).alias("me"), "id", "kind", "actor", "conference_title", F.col("created_at").alias("at"))
    return messages.notifications(messages.conversations_of(t.conversations, t.messages, t.users), acts).drop("type")


@query(
    """SELECT me, count(*) FILTER (WHERE kind = 'message') AS waiting_messages, count(*) FILTER (WHERE kind = 'activity') AS waiting_activity FROM (SELECT DISTINCT other AS me, 'message' AS kind, conversation_id AS id FROM messages m JOIN users u ON u.id = sender_id WHERE read_at IS NULL
    UNION ALL SELECT 'u' || (event_id % 23), 'activity', CAST(event_id AS VARCHAR) FROM events WHERE event_type IN ('click', 'purchase')) x GROUP BY me"""
)
def notification_counts(t: Tables) -> DataFrame:
    acts = t.actions.select(F.expr("concat('u', CAST(CAST(substr(id, 2) AS BIGINT) % 23 AS STRING))").alias("me"), "id", "kind", F.col("user_id").alias("actor"), "conference_title", F.col("created_at").alias("at"))
    return messages.bell(messages.notifications(messages.conversations_of(t.conversations, t.messages, t.users), acts))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(text, ' ' || chr(10)) = '' THEN 'empty' WHEN length(trim(text, ' ' || chr(10))) > 4000 THEN 'too long' END AS reason FROM documents) x GROUP BY reason")
def message_checks(t: Tables) -> DataFrame:
    return messages.acceptable(t.raw("documents").select("text")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# People


@query("SELECT id, email, role, name, organization, title, country, coalesce(reviewer_available, false) AS reviewer_available, google_id IS NOT NULL AS external FROM users")
def public_users(t: Tables) -> DataFrame:
    """Public users, and whether their account signs in elsewhere."""
    users = t.users.withColumns({c: F.lit(None).cast("string") for c in ("department", "city", "bio")})
    external = F.col("google_id").isNotNull().alias("external")
    return people.public(users, external).select("id", "email", "role", "name", "organization", "title", "country", "reviewer_available", "external")


@query("SELECT id, name, title, organization FROM users")
def user_summaries(t: Tables) -> DataFrame:
    return messages.summaries(t.users).drop("avatar")


@query(
    """SELECT c_custkey AS id, CASE WHEN c_nationkey = 1 THEN 'email' WHEN c_nationkey = 2 THEN 'password' WHEN c_nationkey = 3 THEN 'name' WHEN c_nationkey = 4 THEN 'role' WHEN c_nationkey = 5 THEN 'taken' END AS reason FROM customer"""
)
def sign_ups(t: Tables) -> DataFrame:
    asked = t.raw("customer").selectExpr("c_custkey AS id", "CASE c_nationkey WHEN 1 THEN 'no address' WHEN 5 THEN concat(' ', upper(c_name), '@MAIL.test ') ELSE concat('new', c_name, '@x.org') END AS email", "CASE c_nationkey WHEN 2 THEN 'short' ELSE 'long enough' END AS password", "CASE c_nationkey WHEN 3 THEN '  ' ELSE c_name END AS name", "CASE c_nationkey WHEN 4 THEN 'guest' ELSE 'sponsor' END AS role")
    return people.checked(asked, t.users).select("id", "reason")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice <= 300000 THEN o_totalprice END AS number, CASE WHEN o_totalprice <= 300000 AND o_totalprice = floor(o_totalprice) THEN o_totalprice END AS whole FROM orders")
def numbers_checked(t: Tables) -> DataFrame:
    shown = F.col("o_totalprice").cast("string")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), people.number_between(shown, 0, 300_000).alias("number"), people.number_between(shown, 0, 300_000, whole=True).alias("whole"))


@query(
    """SELECT u.id, CASE WHEN good AND c_nationkey IN (0, 3) THEN 'New ' || u.id ELSE name END AS name, CASE WHEN good AND c_nationkey = 1 THEN NULL WHEN good AND c_nationkey = 3 THEN 'Prof.' ELSE title END AS title, CASE WHEN good AND c_nationkey IN (2, 3) THEN NULL ELSE country END AS country
    FROM users u LEFT JOIN (SELECT 'u' || c_custkey AS id, c_nationkey, c_nationkey < 4 AS good FROM customer) c ON c.id = u.id"""
)
def profiles_updated(t: Tables) -> DataFrame:
    """Fields that are given replace or clear the old ones, others stay; an empty name or a bio that is too long changes nothing."""
    fields = (
        F.when(F.col("c_nationkey") == 0, F.create_map(F.lit("name"), F.concat(F.lit(" New u"), F.col("c_custkey").cast("string"), F.lit(" ")), F.lit("role"), F.lit("organizer")))
        .when(F.col("c_nationkey") == 1, F.create_map(F.lit("title"), F.lit(None).cast("string")))
        .when(F.col("c_nationkey") == 2, F.create_map(F.lit("country"), F.lit("  ")))
        .when(F.col("c_nationkey") == 3, F.create_map(F.lit("name"), F.concat(F.lit("New u"), F.col("c_custkey").cast("string")), F.lit("title"), F.lit("Prof."), F.lit("country"), F.lit(""), F.lit("bio"), F.repeat(F.lit("b"), 600)))
        .when(F.col("c_nationkey") == 4, F.create_map(F.lit("name"), F.lit("  "), F.lit("title"), F.lit("lost")))
        .otherwise(F.create_map(F.lit("title"), F.lit("lost"), F.lit("bio"), F.repeat(F.lit("b"), 601)))
    )
    changes = t.raw("customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"), fields.alias("fields"))
    return people.profile_updates(t.users, changes).select("id", "name", "title", "country")


@query("SELECT c_nationkey AS nation, c_nationkey < 3 AS allowed, count(*) AS n FROM customer GROUP BY ALL")
def avatars_checked(t: Tables) -> DataFrame:
    url = F.when(F.col("c_nationkey") == 0, F.lit(None)).when(F.col("c_nationkey") < 3, F.concat(F.lit("data:image/png;base64,"), F.col("c_name"))).when(F.col("c_nationkey") == 3, F.concat(F.lit("data:image/"), F.repeat(F.lit("x"), people.AVATAR_MOST))).otherwise(F.concat(F.lit("https://"), F.col("c_name")))
    return t.raw("customer").select(F.col("c_nationkey").alias("nation"), people.allowed_avatar(url).alias("allowed")).groupBy("nation", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, reviewer_available OR id = 'u5' AS available FROM users")
def availability_set(t: Tables) -> DataFrame:
    return people.availability(t.users, "u5", True).select("id", F.col("reviewer_available").alias("available"))


# Search


@query("SELECT id FROM listed WHERE (contains(lower(p_name), 'st') OR contains(lower(p_type), 'st') OR contains(lower(p_brand), 'st')) AND p_size < 40 AND contains(lower('City' || (p_size % 9) || CASE WHEN p_type = 'PROMO' THEN '' ELSE ' ' || p_type END || ' Hall'), 'city') AND p_size % 2 = 0 AND NOT coalesce(e < DATE '2026-02-01', false) AND NOT coalesce(s > DATE '2026-08-01', false) AND high >= 30 AND low <= 400 AND p_size <= 25 AND p_size <> 9 AND p_size % 5 > 1 AND p_size % 7 > 0 AND p_size < 20")
def search_with_all_facets(t: Tables) -> DataFrame:
    s = discovery.Search("St", discovery.ALL, "Open", "CITY", ("Online",), date(2026, 2, 1), date(2026, 8, 1), 30, 400, True, True, True)
    return discovery.search(t.listed_conferences, s).select("id")


@query("SELECT id FROM listed")
def search_without_facets(t: Tables) -> DataFrame:
    return discovery.search(t.listed_conferences, discovery.Search()).select("id")


@query("SELECT id FROM listed WHERE p_brand = 'Brand#12' AND NOT coalesce(s > DATE '2026-03-01', false)")
def search_one_industry(t: Tables) -> DataFrame:
    return discovery.search(t.listed_conferences, discovery.Search(industry="Brand#12", until=date(2026, 3, 1))).select("id")


@query("SELECT id FROM listed WHERE contains(lower(p_brand), '#1') OR contains(lower(p_type || ' topic'), '#1')")
def search_topics(t: Tables) -> DataFrame:
    return discovery.search(t.listed_conferences.withColumns({"title": F.lit(None).cast("string"), "description": F.lit("")}), discovery.Search("#1")).select("id")


@query("SELECT p_partkey AS id, CAST(p_size % 2 = 0 AS INT) + CAST(p_size % 3 = 0 AS INT) + CAST(p_size % 5 = 0 AS INT) + CAST(p_size % 7 = 0 AS INT) + CAST(p_size > 20 AS INT) + CAST(p_size % 4 = 1 OR p_size % 6 = 1 AS INT) + CAST(p_size % 11 = 0 AS INT) AS active FROM part")
def active_facets(t: Tables) -> DataFrame:
    """How many facets each of many saved searches uses."""
    searches = t.raw("part").selectExpr("p_partkey AS id", "p_name AS keyword", "if(p_size % 2 = 0, p_brand, 'All') AS industry", "if(p_size % 3 = 0, 'Open', NULL) AS cfp_status", "if(p_size % 5 = 0, p_type, '') AS location", "if(p_size % 7 = 0, array('Online'), array()) AS formats", "if(p_size > 20, DATE '2026-01-01', NULL) AS since", "if(p_size % 4 = 1, 10, NULL) AS price_least", "if(p_size % 6 = 1, 99, NULL) AS price_most", "p_size % 11 = 0 AS brochure")
    return searches.select("id", discovery.active_facets(searches).alias("active"))


@query(
    """SELECT industry, row_number() OVER (ORDER BY industry COLLATE en) - 1 AS place FROM (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN replace(p_type, 'E', 'É') WHEN 2 THEN replace(lower(p_type), 'e', 'é') WHEN 3 THEN p_type ELSE p_brand END AS industry FROM part) x"""
)
def industry_options(t: Tables) -> DataFrame:
    mixed = "CASE p_size % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN replace(p_type, 'E', 'É') WHEN 2 THEN replace(lower(p_type), 'e', 'é') WHEN 3 THEN p_type ELSE p_brand END AS industry"
    options = discovery.industries(t.raw("part").selectExpr(mixed))  # a few dozen
    return ordering.placed(options.withColumn("_all", F.lit(1)), ["_all"], ordering.by_locale(F.col("industry"))).drop("_all")


@query("SELECT min(low) AS low, max(high) AS high FROM listed")
def parsed_price_bounds(t: Tables) -> DataFrame:
    return discovery.price_bounds(t.listed_conferences)


@query("SELECT id, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM listed")
def parsed_prices(t: Tables) -> DataFrame:
    p = text.price_range(F.col("price_range"))
    return t.listed_conferences.select("id", p["low"].alias("low"), p["high"].alias("high"))


@query("SELECT query, place, title, snippet FROM (SELECT 'q' || p_partkey // 15 AS query, row_number() OVER (PARTITION BY p_partkey // 15 ORDER BY p_partkey) - 1 AS place, p_name AS title, '' AS snippet FROM part) x WHERE place < 10")
def web_search_results(t: Tables) -> DataFrame:
    """The first ten of the 15 items of each answer; what isn't an answer is left out."""
    item = F.struct("p_partkey", F.struct(F.col("p_name").alias("title"), F.lit("https://x").alias("link")).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])
    answers = t.raw("part").groupBy(F.concat(F.lit("q"), F.expr("p_partkey div 15").cast("string")).alias("query")).agg(items.alias("items")).select(F.to_json(F.struct("query", "items")).alias("value"))
    return discovery.web_results(answers.unionByName(t.spark.createDataFrame([("not JSON",), ('{"query":"q"}',)], "value string"))).select("query", "place", "title", "snippet")


@query("SELECT id, coalesce(nullif(CASE WHEN p_size = 1 THEN '' ELSE p_name END, ''), 'Untitled') AS title, p_brand || '|' || p_type AS topics, 'TBA' AS venue, s AS start_day, coalesce(e, s) AS end_day, 'Open' AS cfp_status FROM listed")
def conference_documents(t: Tables) -> DataFrame:
    form = t.listed_conferences.withColumns({"title": F.when(F.col("title").isNotNull() & (F.element_at("topics", 1) != ""), F.col("title")), "topics": F.concat(F.col("industry"), F.lit(" , ,"), F.split_part("description", F.lit(" "), F.lit(1))), "venue": F.lit(None).cast("string")})
    form = form.join(t.raw("part").select(F.col("p_partkey").alias("id"), "p_size"), "id").withColumn("title", F.when(F.col("p_size") == 1, "").otherwise(F.col("title")))
    d = discovery.conference_document(form)
    return d.select("id", "title", _joined("topics", by="|").alias("topics"), "location.venue", F.col("dates.start").alias("start_day"), F.col("dates.end").alias("end_day"), "cfp_status")


# Posts and small lists


def _posts(t: Tables) -> DataFrame:
    r = F.struct(*((F.col("n_chars") % k).alias(c) if k != 5 else F.when(F.col("n_chars") % 2 == 0, F.col("n_chars") % k).alias(c) for c, k in (("likes", 7), ("celebrates", 5), ("insightful", 3), ("kudos", 2))))
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("author"), F.when(F.col("lang") == "fr", "celebration").otherwise("update").alias("post_type"), "n_chars", r.alias("reactions"))


@query("SELECT source AS author, CAST(sum(n_chars % 7 + CASE WHEN n_chars % 2 = 0 THEN n_chars % 5 ELSE 0 END + n_chars % 3 + n_chars % 2) AS BIGINT) AS total FROM documents WHERE lang <> 'fr' GROUP BY source")
def reactions_by_author(t: Tables) -> DataFrame:
    return posts.total_reactions(_posts(t))


@query("SELECT doc_id AS id, n_chars % 7 + CASE WHEN n_chars % 2 = 0 THEN n_chars % 5 ELSE 0 END + n_chars % 3 + n_chars % 2 AS total FROM documents WHERE source = 'src3'")
def reactions_of_posts(t: Tables) -> DataFrame:
    return posts.by_author(_posts(t), "src3").select("id", posts.reactions().alias("total"))


@query("SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def visible_posts(t: Tables) -> DataFrame:
    labels = t.raw("labels")
    shown = posts.visible(_posts(t), labels.filter("toxic = 1").select(F.col("doc_id").alias("post_id")))
    return posts.with_keys(shown, labels.filter("quality = 1").select(F.col("doc_id").alias("id")), "good").select("id", "good")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (1, 4)")
def invited(t: Tables) -> DataFrame:
    flags = F.create_map(F.lit(1), F.lit(True), F.lit(2), F.lit(False), F.lit(4), F.lit(True))
    return posts.flagged(t.raw("supplier").select(F.col("s_suppkey").alias("id")), flags)


@query("SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'likes' WHEN 'view' THEN 'kudos' END AS counter FROM events")
def reaction_counters(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "like").when(F.col("event_type") == "view", "kudos").otherwise(F.col("event_type"))
    return t.raw("events").select(F.col("event_id").alias("id"), posts.counter_of(kind).alias("counter"))


@query("SELECT o_orderkey AS id, 'new,' || o_orderstatus || ',' || o_orderpriority AS prepended, o_orderpriority AS removed, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus || ',' || o_orderpriority || ',F' END AS toggled, CASE WHEN o_orderstatus = 'F' THEN 'F,' || o_orderpriority ELSE o_orderstatus || ',' || o_orderpriority || ',F' END AS added, o_orderstatus AS first_one FROM orders")
def list_edits(t: Tables) -> DataFrame:
    items = F.array("o_orderstatus", "o_orderpriority")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), _joined(posts.prepended(F.lit("new"), items)).alias("prepended"), _joined(activity.removed_at(items, 0)).alias("removed"), _joined(posts.toggled(items, F.lit("F"))).alias("toggled"), _joined(posts.added(items, F.lit("F"))).alias("added"), _joined(F.slice(items, 1, 1)).alias("first_one"))


@query("SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 3")
def first_three(t: Tables) -> DataFrame:
    return ordering.first_k(t.raw("customer").select(F.col("c_custkey").alias("id")), 3, F.col("id"))


@query("SELECT 'known' AS asked, 7 AS id UNION ALL SELECT 'unknown', 0")
def lookup_or_first(t: Tables) -> DataFrame:
    ids = t.raw("customer").select(F.col("c_custkey").cast("int").alias("id"))
    one = lambda asked, k: ordering.first_match(ids, F.col("id") == k, F.col("id")).select(F.lit(asked).alias("asked"), "id")
    return one("known", 7).unionByName(one("unknown", -1))


@query("SELECT s_suppkey AS id, s_acctbal >= 5000 AS high, row_number() OVER (PARTITION BY s_acctbal >= 5000 ORDER BY s_acctbal DESC, s_suppkey) - 1 AS place FROM supplier")
def recommended_and_others(t: Tables) -> DataFrame:
    high, low = ordering.split_by(t.raw("supplier"), F.col("s_acctbal") >= 5000)
    both = high.withColumn("high", F.lit(True)).unionByName(low.withColumn("high", F.lit(False)))
    return ordering.placed_in_runs(both, ["high"], F.col("s_acctbal").desc(), F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), "high", "place")


@query("SELECT s_name AS name, 'roster' AS origin FROM supplier UNION ALL SELECT c_name, 'invited' FROM customer WHERE c_nationkey = 1")
def committee_choices(t: Tables) -> DataFrame:
    roster = t.raw("supplier").select(F.col("s_name").alias("name"), F.lit("roster").alias("origin"))
    asked = t.raw("customer").filter("c_nationkey = 1").select(F.col("c_name").alias("name"), F.lit("invited").alias("origin"))
    return tables.union_all(roster, asked)


@query("SELECT s_nationkey AS track, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, s_name) - 1 AS place FROM (SELECT s_nationkey, s_name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) x")
def roster_by_participation(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n")).join(t.raw("supplier"), "s_suppkey")
    return ordering.placed(rows.select(F.col("s_nationkey").alias("track"), F.col("s_name").alias("name"), "n"), ["track"], F.col("n").desc(), F.col("name")).drop("n")


@query("SELECT s_suppkey AS id, least(97, 94 - 5 * (r - 1)) AS score, s_name AS name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) x")
def matches_in_pool(t: Tables) -> DataFrame:
    from plenum.operators.nested import ranked

    pool = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    ranks = ranked(pool.select("id"), "id").select("id", F.least(F.lit(97), 94 - 5 * (F.col("rank") - 1)).alias("score"))
    return tables.union_all(ranks, t.spark.createDataFrame([(-5, 90)], "id long, score long")).join(pool, "id")


# Functions


@query(
    """SELECT o_orderkey AS id, CASE WHEN n >= 1000000 THEN rtrim(rtrim(printf('%.1f', round(n / 1000000.0, 1)), '0'), '.') || 'M' WHEN n >= 1000 THEN replace(printf('%.1f', round(n / 1000.0, 1)), '.0', '') || 'K' ELSE format('{:,}', n) END AS short, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'P' THEN 'F' ELSE 'O' END AS next_status, round(least(100.0, o_totalprice / 500000 * 100), 6) AS bar, round(o_totalprice / greatest(1, 0) * 100, 4) AS slider
    FROM (SELECT *, CAST(floor(o_totalprice * 4) AS BIGINT) AS n FROM orders) o"""
)
def number_labels(t: Tables) -> DataFrame:
    n = F.floor(F.col("o_totalprice") * 4)
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), text.compact_plain(n).alias("short"), scores.next_of(["O", "P", "F"], F.col("o_orderstatus")).alias("next_status"), F.round(scores.bar_width(F.col("o_totalprice"), F.lit(500000)), 6).alias("bar"), F.round(scores.share(F.col("o_totalprice"), F.lit(0)), 4).alias("slider"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_nationkey = 1 THEN '?' WHEN c_nationkey = 2 THEN 'MA' ELSE upper(c_mktsegment[1] || n_name[1]) END AS initials, replace(replace('a & ' || c_name || ' <b>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS xml, 'a%20b%26' || replace(c_name, '#', '%23') AS uri, trim(regexp_replace(lower(c_name || ' -- x!'), '[^a-z0-9]+', '-', 'g'), '-') AS file_name
    FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def text_labels(t: Tables) -> DataFrame:
    rows = t.raw("customer").join(t.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    name = F.when(F.col("c_nationkey") == 1, "  ").when(F.col("c_nationkey") == 2, " mature ").otherwise(F.concat_ws(" ", "c_mktsegment", F.lit("middle"), "n_name"))
    return rows.select(F.col("c_custkey").alias("id"), text.initials(name).alias("initials"), text.xml_escaped(F.concat(F.lit("a & "), "c_name", F.lit(" <b>"))).alias("xml"), text.uri_encoded(F.concat(F.lit("a b&"), "c_name")).alias("uri"), text.slug(F.concat("c_name", F.lit(" -- x!")), "-").alias("file_name"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN a = b THEN strftime(a, '%b %-d, %Y') WHEN year(a) <> year(b) THEN strftime(a, '%b %-d, %Y') || ' – ' || strftime(b, '%b %-d, %Y') WHEN month(a) <> month(b) THEN strftime(a, '%b %-d') || ' – ' || strftime(b, '%b %-d, %Y') ELSE strftime(a, '%b %-d') || ' – ' || strftime(b, '%-d, %Y') END AS span, date_diff('day', a, b) + 1 AS days, strftime(a + INTERVAL 63000 SECOND, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown, day(a) AS day_of_month
    FROM (SELECT o_orderkey, o_orderdate AS a, o_orderdate + CAST(o_orderkey % 40 AS INTEGER) * INTERVAL 1 DAY AS b FROM orders) o"""
)
def date_spans(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("a"), F.expr("date_add(o_orderdate, CAST(o_orderkey % 40 AS INT))").alias("b"), F.expr("o_orderdate + INTERVAL '63000' SECOND").alias("at"))
    return rows.select("id", dates.date_range(F.col("a"), F.col("b")).alias("span"), dates.days_inclusive(F.col("a"), F.col("b")).cast("long").alias("days"), messages.shown_time(F.col("at")).alias("shown"), F.dayofmonth("a").cast("long").alias("day_of_month"))


@query("SELECT event_id, label, strftime(ts + hours * INTERVAL 1 HOUR, '%a, %b %-d %I:%M %p') AS shown FROM events CROSS JOIN (VALUES ('Los Angeles', -8), ('Tokyo', 9)) z(label, hours)")
def meeting_times(t: Tables) -> DataFrame:
    zones = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.lit(h).alias("hours")) for label, h in (("Los Angeles", -8), ("Tokyo", 9)))))
    rows = t.raw("events").select("event_id", "ts", zones.alias("z"))
    return rows.select("event_id", "z.label", F.date_format(dates.in_zone(F.col("ts"), F.col("z.hours")), "EEE, MMM d hh:mm a").alias("shown"))


# Writes


@query("SELECT id, CASE WHEN submitter_id = 'u7' THEN 1 ELSE 0 END AS revisions_count, CASE WHEN submitter_id = 'u7' THEN 'Revised Abstract Submitted' ELSE status END AS status FROM submissions")
def revisions_counted(t: Tables) -> DataFrame:
    return tables.updated(t.submissions, F.col("submitter_id") == "u7", revisions_count=F.col("revisions_count") + 1, status=F.lit(activity.REVISED)).select("id", "revisions_count", "status")


@query("SELECT id FROM interactions WHERE type = 'saved' UNION ALL SELECT 'new1'")
def interactions_replaced(t: Tables) -> DataFrame:
    gone = tables.deleted(t.interactions, t.interactions.filter("type = 'followed'"), ["id"])
    return tables.inserted(gone, t.spark.createDataFrame([("new1", "u1")], "id string, user_id string")).select("id")


@query("SELECT id, name, role, CASE WHEN google_id IS NULL THEN 'none' ELSE google_id END AS department, false AS flag FROM users")
def users_rebuilt(t: Tables) -> DataFrame:
    old = t.users.drop("reviewer_available")
    return schemas.rebuilt(old, "users", department=F.coalesce("google_id", F.lit("none"))).select("id", "name", "role", "department", F.col("reviewer_available").alias("flag"))


@query(
    """SELECT 'sponsorship_applications' AS "table", 'sponsor_id in users' AS rule, (SELECT count(*) FROM applications WHERE sponsor_id NOT IN (SELECT id FROM users)) AS n UNION ALL SELECT 'sponsorship_applications', 'unique package_id sponsor_id', (SELECT CAST(count(*) - count(DISTINCT package_id || '/' || sponsor_id) AS BIGINT) FROM applications) UNION ALL SELECT 'users', 'unique email', 0 UNION ALL SELECT 'users', 'role is allowed', 0"""
)
def constraints_broken(t: Tables) -> DataFrame:
    a = schemas.broken(t.applications, "sponsorship_applications", {"users": t.users}).withColumn("table", F.lit("sponsorship_applications"))
    u = schemas.broken(t.users.withColumn("password_hash", F.lit("x")), "users").withColumn("table", F.lit("users"))
    return a.unionByName(u).filter(F.col("rule").isin("sponsor_id in users", "unique package_id sponsor_id", "unique email", "role is allowed")).select("table", "rule", "n")


@query("SELECT table_name AS \"table\", ordinal_position - 1 AS place, column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ('region', 'orders', 'events')")
def table_columns(t: Tables) -> DataFrame:
    return schemas.columns({n: t.raw(n) for n in ("region", "orders", "events")}).drop("type")


@query("SELECT c_custkey AS id, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS value FROM customer")
def users_as_json(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("value"))


@query("SELECT id, email FROM users WHERE id = 'u42'")
def user_by_id(t: Tables) -> DataFrame:
    """Point read with a bound argument."""
    return t.spark.sql("SELECT id, email FROM {users} WHERE id = :id", args={"id": "u42"}, users=t.users)


@query("SELECT c_custkey AS id, contains(c_mktsegment, 'MACH') AS part, regexp_matches(c_name, '(?i)CUSTOMER.*7$') AS pattern, starts_with(c_mktsegment, 'AUTO') AS start, c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') AS listed, c_nationkey <> 4 AS other FROM customer")
def text_predicates(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    return t.raw("customer").select(F.col("c_custkey").alias("id"), F.contains(segment, F.lit("MACH")).alias("part"), F.rlike("c_name", F.lit("(?i)CUSTOMER.*7$")).alias("pattern"), F.startswith(segment, F.lit("AUTO")).alias("start"), segment.isin("HOUSEHOLD", "FURNITURE").alias("listed"), (F.col("c_nationkey") != 4).alias("other"))


@query("SELECT o_orderkey AS id, CASE WHEN n >= 1000000 THEN CASE WHEN n % 1000000 = 0 THEN CAST(n // 1000000 AS VARCHAR) ELSE printf('%.1f', n / 1000000.0) END || 'M' WHEN n >= 1000 THEN CASE WHEN n % 1000 = 0 THEN CAST(n // 1000 AS VARCHAR) ELSE printf('%.1f', n / 1000.0) END || 'K' ELSE CAST(n AS VARCHAR) END AS short FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 4000000 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 900 ELSE 1000 * (o_orderkey % 700 + 1) + 200 END AS n FROM orders) x")
def compact_labels(t: Tables) -> DataFrame:
    n = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 4000000 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 900 ELSE 1000 * (o_orderkey % 700 + 1) + 200 END")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), text.compact(n).alias("short"))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey < 9 THEN 'changed' ELSE s_name END AS name FROM supplier UNION ALL SELECT -1, 'added'")
def upserted(t: Tables) -> DataFrame:
    held = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    changes = held.filter("s_nationkey < 9").select("id", F.lit("changed").alias("name"))
    return tables.upsert(held.drop("s_nationkey"), tables.union_all(changes, t.spark.createDataFrame([(-1, "added")], "id long, name string")), ["id"])


@query("SELECT reviewer_id, count(DISTINCT conference_title) FILTER (WHERE recommendation = 'Accept') AS accepted_for FROM reviews r JOIN submissions s ON s.id = submission_id GROUP BY reviewer_id")
def conferences_accepted_for(t: Tables) -> DataFrame:
    titles = t.submissions.select(F.col("id").alias("submission_id"), "conference_title")
    per = t.reviews.join(titles, "submission_id").groupBy("reviewer_id")
    return per.agg(F.count_distinct(F.when(F.col("recommendation") == "Accept", F.col("conference_title"))).alias("accepted_for"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 7 UNION ALL SELECT -5, 'appended'")
def written_and_read(t: Tables) -> DataFrame:
    """Rows written as JSON to the shared folder, some appended, and read back by their schema."""
    from plenum.sources.tables import append_json, read_json

    path = work_folder(t.spark)
    append_json(t.raw("customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path)
    append_json(t.spark.createDataFrame([(-5, "appended")], "id long, name string"), path)
    return read_json(t.spark, path, "id long, name string")


# Hashes of UTF-16 units, and substring search with postings

_UNITS = "list_reduce(list_prepend(CAST(0 AS BIGINT), flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [CAST(unicode(c) AS BIGINT)] ELSE [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] END))), lambda a, x: (a * 31 + x) & 4294967295)"


@query(f"SELECT c_custkey AS id, '0x' || lpad(lower(hex({_UNITS.format('c_name || chr(128512) || c_mktsegment')})), 16, '0') AS hash FROM customer")
def cert_hash(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("id"), text.certificate_code(F.concat("c_name", F.lit("\U0001f600"), "c_mktsegment")).alias("hash"))


@query(f"SELECT id, CASE WHEN u >= 2147483648 THEN 4294967296 - u ELSE u END % 8 AS palette FROM (SELECT c_custkey AS id, {_UNITS.format('c_name || chr(119070) || c_custkey')} AS u FROM customer) h")
def palette_index(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("id"), text.palette_index(F.concat("c_name", F.lit("\U0001d11e"), F.col("c_custkey").cast("string"))).alias("palette"))


SEARCHED = ("MIT license", "the ", "ung", "é", "password")


@query("SELECT q AS query, doc_id FROM documents, (SELECT unnest(" + str(list(SEARCHED)) + ") AS q) x WHERE contains(lower(text), lower(q))")
def documents_with_text(t: Tables) -> DataFrame:
    """Documents that hold each of some texts, by a posting table over all documents."""
    docs = t.raw("documents").select("doc_id", "text")
    postings = trigrams.Postings(t.spark, work_folder(t.spark)).build(docs, "doc_id", "text")
    found = [postings.search(docs, "doc_id", "text", q).select(F.lit(q).alias("query"), "doc_id") for q in SEARCHED]
    return tables.union_all(*found)


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) AS different, count(*) AS with_prefix FROM orders GROUP BY o_orderstatus")
def ids_assigned(t: Tables) -> DataFrame:
    """Random ids for the rows of a table, written before they are used: as many different ones as rows."""
    path = work_folder(t.spark)
    t.raw("orders").select(F.col("o_orderstatus").alias("status"), text.new_id("msg_").alias("id")).write.parquet(path)
    return t.spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("different"), F.count_if(F.col("id").startswith("msg_")).alias("with_prefix"))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name][0](Tables(spark, sf_dir))


def queries() -> dict:
    return {name: (lambda spark, sf_dir, name=name: run(name, spark, sf_dir)) for name in QUERIES}


def oracles() -> dict[str, str]:
    return {name: _merged(sql) for name, (_, sql) in QUERIES.items() if sql}


def _merged(sql: str) -> str:
    """SQL that has common table expressions of its own, with the stand-ins' before them."""
    own = sql.lstrip()
    if not own.startswith("WITH "):
        return with_ctes(own)
    head = with_ctes(own)
    return head if head == own else head[: len(head) - len(own)].rstrip() + ", " + own.removeprefix("WITH ")
