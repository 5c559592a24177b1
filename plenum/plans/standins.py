"""The application's tables made from the stand-in tables, in their declared columns, and the same as common table expressions for DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.sources.tables import read

DECISION = "CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Rejected' ELSE 'Pending' END"
LINE = "concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_extendedprice AS STRING))"


class Tables:
    """Lazy frames; only those that a query uses are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    # Sponsors 0 to 2 have applications but no account.
    @cached_property
    def users(self) -> DataFrame:
        people = self.raw("customer").selectExpr("concat('u', CAST(c_custkey AS STRING)) AS id", "concat(lower(c_name), '@mail.test') AS email", "'x' AS password_hash", "CASE WHEN c_nationkey = 3 THEN 'g' END AS google_id", "CASE WHEN c_nationkey < 5 THEN 'organizer' ELSE 'professional' END AS role", "c_name AS name", "nullif(c_mktsegment, 'BUILDING') AS organization", "CASE WHEN c_nationkey < 8 THEN 'Dr.' END AS title", "CAST(NULL AS STRING) AS avatar", "timestamp_seconds(1577836800 + c_custkey * 3600) AS created_at", "CASE WHEN c_nationkey > 2 THEN concat('n', CAST(c_nationkey AS STRING)) END AS country", "c_acctbal > 5000 AS reviewer_available")
        sponsors = self.raw("supplier").selectExpr("concat('s', CAST(s_suppkey + 3 AS STRING)) AS id", "concat(lower(s_name), '@mail.test') AS email", "'x' AS password_hash", "CAST(NULL AS STRING) AS google_id", "'sponsor' AS role", "CASE WHEN s_nationkey = 4 THEN '' ELSE s_name END AS name", "CASE WHEN s_nationkey < 12 THEN '' ELSE concat(s_name, ' Inc') END AS organization", "CAST(NULL AS STRING) AS title", "CAST(NULL AS STRING) AS avatar", "timestamp_seconds(1577836800 + s_suppkey * 60) AS created_at", "concat('n', CAST(s_nationkey AS STRING)) AS country", "false AS reviewer_available")
        return people.unionByName(sponsors)

    @cached_property
    def conferences(self) -> DataFrame:
        return self.raw("part").selectExpr("concat('c', CAST(p_partkey AS STRING)) AS id", "p_brand AS organizer_id", "p_name AS title", "p_type AS industry")

    @cached_property
    def submissions(self) -> DataFrame:
        status = "CASE o_orderstatus WHEN 'F' THEN 'Accepted for Oral Presentation' WHEN 'P' THEN 'Revisions Requested' ELSE 'Submitted' END"
        return self.raw("orders").selectExpr("concat('x', CAST(o_orderkey AS STRING)) AS id", "concat('u', CAST(o_custkey AS STRING)) AS submitter_id", "concat('c', CAST(o_orderkey % 190 AS STRING)) AS conference_id", "concat('Conf ', CAST(o_orderkey % 190 AS STRING)) AS conference_title", "concat('Paper ', CAST(o_orderkey AS STRING)) AS title", "CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '1-URGENT' THEN NULL ELSE o_orderpriority END AS track", "CASE WHEN o_orderstatus = 'P' THEN 'broken' ELSE concat('[\"', o_orderpriority, '\",\"', o_orderstatus, '\"]') END AS keywords", "concat('a', CAST(o_custkey AS STRING)) AS primary_author_name", "'a@b.c' AS primary_author_email", "nullif(o_orderstatus, 'F') AS primary_author_affiliation", "concat('[{\"name\":\"', o_orderpriority, '\",\"email\":\"e\"}]') AS co_authors", f"{status} AS status", "o_orderdate AS submission_date", "CAST(0 AS BIGINT) AS revisions_count")

    @cached_property
    def reviews(self) -> DataFrame:
        to = "CASE l_returnflag WHEN 'A' THEN 'Accept' WHEN 'R' THEN 'Reject' ELSE 'Minor Revision' END"
        return self.raw("lineitem").selectExpr(f"{LINE} AS id", "concat('x', CAST(l_orderkey AS STRING)) AS submission_id", "concat('s', CAST(l_suppkey AS STRING)) AS reviewer_id", "concat('S', CAST(l_suppkey AS STRING)) AS reviewer_name", "concat('{\"clarity\":', CAST(CAST(l_quantity AS INT) % 5 AS STRING), ',\"novelty\":', CAST(l_linenumber AS STRING), '}') AS scores", "l_quantity AS overall_score", f"{to} AS recommendation", "l_shipdate AS created_at")

    @cached_property
    def packages(self) -> DataFrame:
        return self.raw("part").selectExpr("concat('p', CAST(p_partkey AS STRING)) AS id", "concat('c', CAST(p_partkey % 97 AS STRING)) AS conference_id", "p_name AS conference_title", "p_brand AS organizer_id", "p_type AS tier", "p_retailprice AS price", "CASE WHEN p_size < 3 THEN 'none' ELSE '[\"Booth\",\"Pass\"]' END AS benefits", "CAST(p_size AS BIGINT) AS total_slots", "CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN NULL ELSE concat('opp', CAST(p_size % 7 AS STRING), '__', p_type) END AS source_opportunity_id", "timestamp_seconds(1577836800 + (p_partkey % 50) * 3600) AS created_at")

    @cached_property
    def applications(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(f"{LINE} AS id", "concat('p', CAST(l_partkey AS STRING)) AS package_id", "concat('s', CAST(l_suppkey AS STRING)) AS sponsor_id", f"{DECISION} AS status", "l_shipdate AS created_at", "CASE WHEN l_returnflag <> 'N' AND l_linenumber < 7 THEN l_shipdate + INTERVAL '7' DAY END AS decided_at")

    @cached_property
    def sponsor_reviews(self) -> DataFrame:
        return self.raw("lineitem").filter("l_returnflag = 'A'").selectExpr(f"{LINE} AS id", "concat('s', CAST(l_suppkey AS STRING)) AS sponsor_id", "concat('u', CAST(l_partkey % 160 AS STRING)) AS organizer_id", "CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS BIGINT) AS rating", "l_shipdate AS created_at")

    @cached_property
    def registrations(self) -> DataFrame:
        rows = self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.selectExpr(f"{LINE} AS id", "concat('u', CAST(o_custkey AS STRING)) AS user_id", "concat('c', CAST(l_partkey + 20 AS STRING)) AS conference_id", "CASE WHEN l_linenumber > 4 THEN '' ELSE concat('Own ', CAST(l_partkey AS STRING)) END AS conference_title", "nullif(l_linestatus, 'O') AS package_name", "l_shipdate AS registered_at")

    @cached_property
    def messages(self) -> DataFrame:
        rows = self.raw("events").selectExpr("concat('m', CAST(event_id AS STRING)) AS id", "concat('u', CAST(user_id AS STRING)) AS sender_id", "concat('u', CAST(event_id % 23 AS STRING)) AS other", "concat(event_type, ' ', props) AS text", "CASE WHEN event_type IN ('view', 'error') THEN ts END AS read_at", "ts AS created_at").filter("sender_id <> other")
        return rows.withColumn("conversation_id", F.concat_ws("_", F.least("sender_id", "other"), F.greatest("sender_id", "other")))

    @cached_property
    def conversations(self) -> DataFrame:
        pairs = self.messages.groupBy("conversation_id", F.least("sender_id", "other").alias("user_a"), F.greatest("sender_id", "other").alias("user_b"))
        return pairs.agg(F.min("created_at").alias("created_at")).withColumnRenamed("conversation_id", "id")

    @cached_property
    def quiet_conversations(self) -> DataFrame:
        """Conversations that nobody has written in; some with a partner that doesn't exist."""
        return self.raw("customer").filter("c_nationkey = 5").selectExpr("concat('quiet', c_custkey) AS id", "concat('u', c_custkey) AS user_a", "concat('u', c_custkey + 700) AS user_b", "timestamp_seconds(1704067200 + c_custkey * 977) AS created_at")

    @cached_property
    def created_conferences(self) -> DataFrame:
        """Documents of different shapes; some aren't JSON."""
        full = "to_json(named_struct('id', concat('c', p_partkey), 'title', p_name, 'location', named_struct('city', p_type), 'topics', array(p_brand, p_type), 'price', p_retailprice))"
        data = f"CASE WHEN p_size < 4 THEN concat('{{\"id\": ', p_name) WHEN p_size < 10 THEN concat('{{\"title\":\"', p_type, '\",\"price\":\"free\",\"topics\":[]}}') WHEN p_size < 14 THEN concat('{{\"id\":', p_partkey, ',\"title\":\" \"}}') ELSE {full} END"
        return self.raw("part").selectExpr("concat('c', p_partkey) AS id", "p_brand AS organizer_id", f"{data} AS data", "timestamp_seconds(1704067200 + p_size * 3600) AS created_at")

    @cached_property
    def actions(self) -> DataFrame:
        return self.raw("events").filter("event_type IN ('click', 'purchase')").selectExpr("concat('i', CAST(event_id AS STRING)) AS id", "concat('u', CAST(user_id AS STRING)) AS user_id", "concat('c', CAST(event_id % 211 AS STRING)) AS conference_id", "concat('Conf ', CAST(event_id % 211 AS STRING)) AS conference_title", "CASE event_type WHEN 'click' THEN 'committee_interest' ELSE 'sponsorship_inquiry' END AS kind", "ts AS created_at")

    @cached_property
    def interactions(self) -> DataFrame:
        return self.raw("events").filter("event_type IN ('click', 'view')").groupBy("user_id", "event_type", F.expr("event_id % 31")).agg(F.min("ts").alias("created_at"), F.min("event_id").alias("e")).selectExpr("concat('t', CAST(e AS STRING)) AS id", "concat('u', CAST(user_id AS STRING)) AS user_id", "concat('c', CAST(e % 31 AS STRING)) AS conference_id", "CASE event_type WHEN 'click' THEN 'saved' ELSE 'followed' END AS type", "created_at")

    @cached_property
    def opportunities(self) -> DataFrame:
        rows = [(f"opp{i}", f"Opportunity {i}", sectors, ["PROMO", "SMALL"]) for i, sectors in enumerate((["Machine", "Auto"], ["build"], [], ["House", "Household", "x"], ["ACHINER"]))]
        return self.spark.createDataFrame(rows, "id string, name string, ideal_sectors array<string>, tiers array<string>")

    @cached_property
    def listed_conferences(self) -> DataFrame:
        """Conferences with the columns that the search form looks at."""
        return self.raw("part").selectExpr("p_partkey AS id", "p_name AS title", "concat(p_type, ' things') AS description", "array(p_brand, concat(p_type, ' topic')) AS topics", "p_brand AS industry", "CASE WHEN p_size < 20 THEN 'Open' WHEN p_size < 40 THEN 'Closed' ELSE 'Extended' END AS cfp_status", "concat('City', CAST(p_size % 9 AS STRING)) AS city", "nullif(p_type, 'PROMO') AS country", "'Hall' AS venue", "CASE WHEN p_size % 2 = 0 THEN 'Online' ELSE 'Hybrid' END AS format", "CASE WHEN p_size = 7 THEN NULL ELSE date_add(DATE'2026-01-01', CAST(p_partkey % 300 AS INT)) END AS start_day", "CASE WHEN p_size = 8 THEN NULL ELSE date_add(DATE'2026-01-03', CAST(p_partkey % 300 AS INT)) END AS end_day", "CASE p_size % 4 WHEN 0 THEN 'free' WHEN 1 THEN concat('$', CAST(p_size * 10 AS STRING)) WHEN 2 THEN concat('$', CAST(p_size AS STRING), ' - $1,', CAST(100 + p_size AS STRING)) ELSE concat('5 to ', CAST(p_size AS STRING), ' or 9,000 EUR') END AS price_range", "CASE WHEN p_size > 30 THEN '  ' WHEN p_size > 25 THEN NULL ELSE 'hotel' END AS accommodation", "CASE WHEN p_size = 9 THEN NULL ELSE p_size % 5 > 1 END AS has_brochure", "p_size % 7 > 0 AS has_city_map")


_LINE = "concat(l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', l_extendedprice)"
#: The tables above, for DuckDB.
CTES = {
    "users": "SELECT 'u' || c_custkey AS id, lower(c_name) || '@mail.test' AS email, CASE WHEN c_nationkey = 3 THEN 'g' END AS google_id, CASE WHEN c_nationkey < 5 THEN 'organizer' ELSE 'professional' END AS role, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS organization, CASE WHEN c_nationkey < 8 THEN 'Dr.' END AS title, CASE WHEN c_nationkey > 2 THEN 'n' || c_nationkey END AS country, c_acctbal > 5000 AS reviewer_available FROM customer UNION ALL SELECT 's' || (s_suppkey + 3), lower(s_name) || '@mail.test', NULL, 'sponsor', CASE WHEN s_nationkey = 4 THEN '' ELSE s_name END, CASE WHEN s_nationkey < 12 THEN '' ELSE s_name || ' Inc' END, NULL, 'n' || s_nationkey, false FROM supplier",
    "conferences": "SELECT 'c' || p_partkey AS id, p_brand AS organizer_id, p_name AS title FROM part",
    "submissions": "SELECT 'x' || o_orderkey AS id, 'u' || o_custkey AS submitter_id, 'c' || (o_orderkey % 190) AS conference_id, 'Conf ' || (o_orderkey % 190) AS conference_title, 'Paper ' || o_orderkey AS title, o_orderpriority, o_orderstatus, o_orderdate AS submission_date, CASE o_orderstatus WHEN 'F' THEN 'Accepted for Oral Presentation' WHEN 'P' THEN 'Revisions Requested' ELSE 'Submitted' END AS status FROM orders",
    "reviews": f"SELECT {_LINE} AS id, 'x' || l_orderkey AS submission_id, 's' || l_suppkey AS reviewer_id, l_quantity, l_linenumber, l_shipdate AS created_at, CASE l_returnflag WHEN 'A' THEN 'Accept' WHEN 'R' THEN 'Reject' ELSE 'Minor Revision' END AS recommendation FROM lineitem",
    "packages": "SELECT 'p' || p_partkey AS id, 'c' || (p_partkey % 97) AS conference_id, p_name AS conference_title, p_brand AS organizer_id, p_type AS tier, p_retailprice AS price, p_size AS total_slots, CASE WHEN p_size < 3 THEN '' ELSE 'Booth,Pass' END AS benefits, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN NULL ELSE 'opp' || (p_size % 7) || '__' || p_type END AS source_opportunity_id, TIMESTAMP '2020-01-01' + (p_partkey % 50) * INTERVAL 1 HOUR AS created_at FROM part",
    "applications": f"SELECT {_LINE} AS id, 'p' || l_partkey AS package_id, 's' || l_suppkey AS sponsor_id, CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Rejected' ELSE 'Pending' END AS status, l_shipdate AS created_at, CASE WHEN l_returnflag <> 'N' AND l_linenumber < 7 THEN l_shipdate + INTERVAL 7 DAY END AS decided_at FROM lineitem",
    "sponsor_reviews": f"SELECT {_LINE} AS id, 's' || l_suppkey AS sponsor_id, 'u' || (l_partkey % 160) AS organizer_id, 1 + CAST(l_quantity AS BIGINT) % 5 AS rating, l_shipdate AS created_at FROM lineitem WHERE l_returnflag = 'A'",
    "registrations": f"SELECT {_LINE} AS id, 'u' || o_custkey AS user_id, 'c' || (l_partkey + 20) AS conference_id, CASE WHEN l_linenumber > 4 THEN '' ELSE 'Own ' || l_partkey END AS conference_title, nullif(l_linestatus, 'O') AS package_name, l_shipdate AS registered_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "messages": "SELECT *, least(sender_id, other) || '_' || greatest(sender_id, other) AS conversation_id FROM (SELECT 'm' || event_id AS id, 'u' || user_id AS sender_id, 'u' || (event_id % 23) AS other, event_type || ' ' || props AS text, CASE WHEN event_type IN ('view', 'error') THEN ts END AS read_at, ts AS created_at FROM events) e WHERE sender_id <> other",
    "quiet": "SELECT 'quiet' || c_custkey AS id, 'u' || c_custkey AS user_a, 'u' || (c_custkey + 700) AS user_b, make_timestamp(CAST(1704067200 + c_custkey * 977 AS BIGINT) * 1000000) AS created_at FROM customer WHERE c_nationkey = 5",
    "created": "SELECT 'c' || p_partkey AS id, p_brand AS organizer_id, CASE WHEN p_size < 4 THEN '{\"id\": ' || p_name WHEN p_size < 10 THEN '{\"title\":\"' || p_type || '\",\"price\":\"free\",\"topics\":[]}' WHEN p_size < 14 THEN '{\"id\":' || p_partkey || ',\"title\":\" \"}' ELSE CAST(json_object('id', 'c' || p_partkey, 'title', p_name, 'location', json_object('city', p_type), 'topics', json_array(p_brand, p_type), 'price', p_retailprice) AS VARCHAR) END AS data, make_timestamp(CAST(1704067200 + p_size * 3600 AS BIGINT) * 1000000) AS created_at FROM part",
    "actions": "SELECT 'i' || event_id AS id, 'u' || user_id AS user_id, 'c' || (event_id % 211) AS conference_id, 'Conf ' || (event_id % 211) AS conference_title, CASE event_type WHEN 'click' THEN 'committee_interest' ELSE 'sponsorship_inquiry' END AS kind, ts AS created_at FROM events WHERE event_type IN ('click', 'purchase')",
    "interactions": "SELECT 't' || min(event_id) AS id, 'u' || user_id AS user_id, 'c' || (event_id % 31) AS conference_id, CASE event_type WHEN 'click' THEN 'saved' ELSE 'followed' END AS type FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type, event_id % 31",
    "listed": "SELECT p_partkey AS id, p_name, p_type, p_brand, p_size, CASE WHEN p_size <> 7 THEN DATE '2026-01-01' + CAST(p_partkey % 300 AS INTEGER) END AS s, CASE WHEN p_size <> 8 THEN DATE '2026-01-03' + CAST(p_partkey % 300 AS INTEGER) END AS e, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size * 10 WHEN 2 THEN p_size ELSE 5 END AS low, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size * 10 WHEN 2 THEN 1100 + p_size ELSE 9000 END AS high FROM part",
}


def with_ctes(sql: str) -> str:
    """sql with the stand-ins that it names in front."""
    import re

    needed = [name for name in CTES if re.search(rf"\b{name}\b", sql)]
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in needed)} {sql}" if needed else sql
