"""Named queries of an event community over the stand-in tables.

Each is one declarative statement, so the optimizer sees the whole query.
``{table}`` names an input frame. Most statements mean the same in ANSI SQL
elsewhere; where the dialects differ, a second text stands beside the first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The nine clock zones and their offsets from UTC in hours.
ZONES = "(VALUES ('Los Angeles', -8), ('New York', -5), ('London', 0), ('Paris', 1), ('Dubai', 4), ('Mumbai', 5), ('Singapore', 8), ('Tokyo', 9), ('Sydney', 10)) AS z(label, hours)"
# Sponsors of the owner's packages first, then their statistics in one aggregation per (sponsor, year) and one per sponsor.
STATS = """asked AS (SELECT l.*, p_partkey, p_brand FROM {lineitem} l JOIN {part} ON p_partkey = l_partkey WHERE p_brand = 'Brand#11'),
yearly AS (SELECT l_suppkey AS sponsor, year(l_shipdate) AS year, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS total, count(*) FILTER (WHERE l_returnflag <> 'N') AS reviews, count(*) FILTER (WHERE l_returnflag = 'A') AS approved FROM {lineitem} WHERE l_suppkey IN (SELECT l_suppkey FROM asked) GROUP BY l_suppkey, year(l_shipdate)),
stats AS (SELECT sponsor, CASE WHEN sum(reviews) > 0 THEN sum(total) / sum(reviews) END AS rating, CAST(sum(reviews) AS BIGINT) AS reviews, CAST(sum(approved) AS BIGINT) AS approved, count(*) FILTER (WHERE approved > 0) AS years FROM yearly GROUP BY sponsor)"""

SQL: dict[str, str | tuple[str, str]] = {
    "registrations_per_conference": "SELECT l_partkey AS conference_id, count(*) AS n FROM {lineitem} GROUP BY l_partkey",
    "approved_slots_by_package": "SELECT p_partkey AS package_id, greatest(0, p_size - coalesce(n, 0)) AS available FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_partkey) a ON l_partkey = p_partkey",
    "feedback_summary_for_owner": "SELECT round(coalesce(avg(l_quantity), 0.0), 6) AS average, count(*) AS n FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_brand = 'Brand#11'",
    "feedback_summary_for_new_owner": "SELECT coalesce(avg(l_quantity), 0.0) AS average, count(*) AS n FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_brand = 'none'",
    "sponsor_rating_stats": "SELECT s_suppkey AS sponsor_id, round(coalesce(avg(l_quantity), 0.0), 6) AS rating, count(l_suppkey) AS reviews, count(*) FILTER (WHERE l_returnflag = 'A') AS approved FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY s_suppkey",
    "leads_or_count": "SELECT count(*) AS leads FROM {orders} WHERE o_custkey = 7 OR o_orderstatus = 'P'",
    "unread_per_conversation": "SELECT user_id, count(*) FILTER (WHERE event_type <> 'view' AND nullif(event_type, 'click') IS NULL) AS unread FROM {events} GROUP BY user_id",
    "unread_total": "SELECT count(*) AS unread FROM {events} JOIN {customer} ON c_custkey = user_id WHERE event_type <> 'view' AND nullif(event_type, 'click') IS NULL",
    "latest_message_per_thread": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {conversations}) t WHERE r = 1",
    "conversation_list": "WITH m AS (SELECT least(user_id * 12, 600) AS a, greatest(user_id * 12, 600) AS b, event_id, ts, event_type FROM {events} WHERE user_id <> 50), c AS (SELECT CASE WHEN a = 600 THEN b ELSE a END AS partner_id, max(ts) AS last_time, max_by(event_type, event_id) AS last_text, count(*) FILTER (WHERE event_type = 'click') AS unread FROM m GROUP BY a, b) SELECT partner_id, c_name AS partner, last_time, last_text, unread FROM c JOIN {customer} ON c_custkey = partner_id",
    "distinct_reviewable_sponsors": "SELECT DISTINCT l_suppkey AS sponsor_id, s_name AS company FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey WHERE p_brand = 'Brand#11' AND l_returnflag = 'A'",
    "eligible_exists": "SELECT s_suppkey FROM {supplier} LEFT SEMI JOIN (SELECT l_suppkey FROM {lineitem} WHERE l_returnflag = 'A' AND l_quantity > 49) e ON l_suppkey = s_suppkey",
    "activity_feed": "SELECT concat('cia_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS id, 'interest' AS kind, s_name AS actor, l_shipdate AS at FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size = 7) UNION ALL SELECT concat('sub_', CAST(o_orderkey AS STRING)), 'abstract_submission', c_name, o_orderdate FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%'",
    "user_search": "SELECT c_custkey AS id, c_name AS name FROM {customer} WHERE c_name ILIKE '%R#0000_01%' AND c_custkey <> 1 ORDER BY c_name, c_custkey LIMIT 10",
    "discover_keyword": "SELECT p_partkey AS id FROM {part} WHERE contains(lower(p_name), lower('Re')) OR contains(lower(p_type), lower('Re'))",
    "discover_facets": "SELECT p_partkey AS id FROM {part} WHERE p_brand = 'Brand#12' AND p_type IN ('STANDARD', 'PROMO', 'SMALL')",
    "discover_date_overlap": "SELECT o_orderkey AS id FROM {orders} WHERE NOT coalesce(o_orderdate + INTERVAL '5' DAY < TIMESTAMP '1996-03-01 00:00:00', false) AND NOT coalesce(o_orderdate > TIMESTAMP '1996-04-01 00:00:00', false)",
    "discover_price_overlap": "SELECT p_partkey AS id FROM {part} WHERE p_retailprice + 20 >= 950 AND p_retailprice <= 960",
    "discover_all": "SELECT p_partkey AS id FROM {part} WHERE contains(lower(concat_ws(' ', p_brand, p_type)), 'brand') AND p_size BETWEEN 5 AND 20 AND p_retailprice >= 910 AND p_brand <> '' ",
    "facet_options": "SELECT DISTINCT p_brand AS industry FROM {part} WHERE p_brand <> ''",
    "price_bounds": "SELECT coalesce(min(least(lo, hi)), 0) AS low, coalesce(max(greatest(lo, hi)), 1000) AS high FROM (SELECT CAST(floor(p_retailprice) AS BIGINT) AS lo, CAST(floor(p_retailprice) AS BIGINT) + p_size AS hi FROM {part}) p",
    "override_union": "SELECT p_partkey AS id, p_name AS title, 'sample' AS origin FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = p_partkey) UNION ALL SELECT s_suppkey, s_name, 'created' FROM {supplier}",
    "pending_reviews": "SELECT o_orderkey AS id FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_suppkey = 3)",
    "completed_reviews": "SELECT o_orderkey AS id FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_suppkey = 3)",
    "managed_submissions": "SELECT o_orderkey AS id, o_orderstatus AS status FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')",
    "contribution_stats": "SELECT o_custkey AS user_id, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS accepted, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS oral, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '1%') AS poster, count(*) AS submitted, count(DISTINCT o_orderpriority) AS tracks, count(*) * 20 AS kudos FROM {orders} GROUP BY o_custkey",
    "dashboard_overview": "SELECT count(*) AS submissions, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS accepted, CAST(sum(coalesce(n, 0)) AS BIGINT) AS reviews FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) r ON l_orderkey = o_orderkey",
    "sessions_by_track": "SELECT coalesce(nullif(nullif(o_orderpriority, '5-LOW'), ''), 'General') AS track, count(*) FILTER (WHERE o_orderstatus <> 'P') AS oral, count(*) FILTER (WHERE o_orderstatus = 'P') AS poster FROM {orders} WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
    "status_breakdown_pct": "SELECT label, n, CAST(floor(n * 100.0 / sum(n) OVER () + 0.5) AS BIGINT) AS pct FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'Accepted' WHEN 'P' THEN 'Revisions' ELSE 'Submitted' END AS label, count(*) AS n FROM {orders} GROUP BY 1) s WHERE n > 0",
    "sponsor_revenue": "SELECT p_brand AS tier, round(sum(p_retailprice * least(p_size, coalesce(n, 0))), 2) AS revenue FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_partkey) a ON l_partkey = p_partkey GROUP BY p_brand",
    "committee_roster": (
        "SELECT name, sum(n) AS n, min_by(title, k) AS title, array_join(transform(array_sort(collect_list(struct(k, role))), x -> x.role), ',') AS roles FROM (SELECT p_name AS name, p_type AS role, count(*) AS n, min(p_partkey) AS k, min_by(p_brand, p_partkey) AS title FROM {part} GROUP BY p_name, p_type) r GROUP BY name",
        "SELECT p_name AS name, count(*) AS n, min_by(p_brand, p_partkey) AS title, (SELECT string_agg(t, ',' ORDER BY k) FROM (SELECT p_type AS t, min(p_partkey) AS k FROM {part} q WHERE q.p_name = p.p_name GROUP BY p_type) x) AS roles FROM {part} p GROUP BY p_name",
    ),
    "candidate_pool": "SELECT s_name AS name, count(*) AS reviews, count(DISTINCT l_returnflag) AS topics FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY s_name",
    "arc_segments": "SELECT label, round(sum(n) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) * 360e0 / greatest(1, sum(n) OVER ()) - n * 360e0 / greatest(1, sum(n) OVER ()), 6) AS from_deg, round(sum(n) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) * 360e0 / greatest(1, sum(n) OVER ()), 6) AS to_deg FROM (SELECT event_type AS label, count(*) AS n FROM {events} GROUP BY event_type) e",
    "upcoming_deadlines": "SELECT o_orderkey AS id, o_orderdate AS deadline FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 4",
    "recommended_top4": "SELECT p_partkey AS id, p_size AS score FROM {part} ORDER BY p_size DESC, p_partkey LIMIT 4",
    "top_posts": "SELECT doc_id, n_chars AS impressions FROM {documents} ORDER BY coalesce(n_chars, 0) DESC, doc_id LIMIT 3",
    "promoted": "SELECT p_partkey AS id, p_name AS title FROM {part} ORDER BY p_size DESC, p_partkey LIMIT 1",
    "reaction_breakdown": "SELECT event_type AS reaction, count(*) AS n FROM {events} WHERE event_type <> 'error' GROUP BY event_type HAVING count(*) > 0",
    "engagement_summary": "SELECT round(sum(coalesce(value, 0)), 2) AS impressions, count(*) FILTER (WHERE event_type = 'click') + count(*) FILTER (WHERE event_type = 'purchase') AS reactions, count(DISTINCT user_id) AS people FROM {events}",
    "reaction_toggle": "SELECT event_id, value, value + CASE WHEN event_type = 'click' THEN (CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) - (CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) ELSE 0 END AS shown FROM {events}",
    "review_overall_score": "SELECT l_orderkey AS submission_id, round(avg(l_quantity), 3) AS overall FROM {lineitem} GROUP BY l_orderkey",
    "feedback_label": "SELECT o_orderkey AS id, CASE least(6, CAST(floor(a / 10 + 0.5) AS BIGINT)) WHEN 0 THEN 'Poor' WHEN 1 THEN 'Poor' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Good' WHEN 4 THEN 'Very good' ELSE 'Excellent' END AS label FROM (SELECT l_orderkey AS o_orderkey, avg(l_quantity) AS a FROM {lineitem} GROUP BY l_orderkey) s",
    "reviews_by_conference": "SELECT l_partkey AS conference_id, count(*) AS n, max(l_shipdate) AS last_review FROM {lineitem} GROUP BY l_partkey",
    "certificates_union": "SELECT concat('att_', CAST(o_orderkey AS STRING)) AS id, 'attendance' AS kind, o_orderdate AS at FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT concat('pre_', CAST(o_orderkey AS STRING)), 'presentation', o_orderdate FROM {orders} WHERE o_orderstatus = 'P' UNION ALL SELECT concat('rev_', CAST(l_suppkey AS STRING)), concat(CAST(count(*) AS STRING), ' review', CASE WHEN count(*) = 1 THEN '' ELSE 's' END), max(l_shipdate) FROM {lineitem} GROUP BY l_suppkey",
    "committee_entries_dedup": "SELECT title, year, src FROM (SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY src, id) AS r FROM (SELECT p_name AS title, p_size AS year, 1 AS src, p_partkey AS id FROM {part} WHERE p_brand IN ('Brand#11', 'Brand#12') UNION ALL SELECT p_name, p_size, 2, p_partkey FROM {part} WHERE lower(p_type) LIKE '%promo%') u) v WHERE r = 1",
    "attended_conferences": "SELECT l_orderkey AS registration, l_linenumber AS line, coalesce(nullif(p_name, ''), 'Unknown') AS title, CAST(l_shipdate AS DATE) AS day FROM {lineitem} LEFT JOIN {part} ON p_partkey = l_partkey + 100",
    "suggested_packages": "SELECT p_partkey AS id, greatest(35, least(99, CAST(floor(80.0 * (CASE WHEN contains(lower(p_name), 'a') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_type), 'a') THEN 1 ELSE 0 END) / 2 + 20.0 * p_size / 50 + 0.5) AS BIGINT))) AS score FROM {part}",
    "sponsor_verification": "SELECT s_suppkey AS id, CASE WHEN n = 0 THEN 'new' WHEN rating >= 25.0 THEN 'verified' ELSE 'unverified' END AS status FROM (SELECT s_suppkey, count(l_suppkey) AS n, avg(l_quantity) AS rating FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY s_suppkey) s",
    "sponsor_history_span": "SELECT l_suppkey AS sponsor_id, CAST(coalesce(max(year(l_shipdate)) - min(year(l_shipdate)) + 1, 0) AS BIGINT) AS years FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_suppkey",
    "applicant_queue": f"WITH {STATS} SELECT l_orderkey AS application_id, l_linenumber AS line, p_partkey AS package_id, p_brand AS tier, l_returnflag AS status, l_shipdate AS created_at, l_suppkey AS sponsor_id, coalesce(nullif(s_name, ''), 'Unknown Sponsor') AS company, round(coalesce(rating, 0.0), 6) AS rating, coalesce(reviews, 0) AS reviews, coalesce(approved, 0) AS approved, coalesce(years, 0) AS history_years FROM asked LEFT JOIN stats ON sponsor = l_suppkey LEFT JOIN {{supplier}} ON s_suppkey = l_suppkey",
    "world_clock": (
        f"SELECT event_id, label, date_format(ts + make_interval(0, 0, 0, 0, hours, 0, 0), 'yyyy-MM-dd HH:mm') AS at FROM {{events}} CROSS JOIN {ZONES}",
        f"SELECT event_id, label, strftime(ts + hours * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS at FROM {{events}} CROSS JOIN {ZONES}",
    ),
    "agenda_by_day": "SELECT CAST(o_orderdate AS DATE) AS day, CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) AS BIGINT) - 1 AS idx, o_orderkey AS session FROM {orders}",
    "date_labels": ("SELECT o_orderkey AS id, date_format(o_orderdate, 'MMM d, yyyy') AS label, upper(date_format(o_orderdate, 'MMM')) AS month, date_format(o_orderdate, 'EEEE') AS weekday FROM {orders}", "SELECT o_orderkey AS id, strftime(o_orderdate, '%b %-d, %Y') AS label, upper(strftime(o_orderdate, '%b')) AS month, strftime(o_orderdate, '%A') AS weekday FROM {orders}"),
    "compact_counts": "SELECT o_orderkey AS id, CASE WHEN n >= 1000000 THEN concat(CAST(CAST(floor(n / 100000.0) / 10.0 AS DECIMAL(12,1)) AS STRING), 'M') WHEN n >= 1000 THEN concat(CAST(CAST(floor(n / 100.0) / 10.0 AS DECIMAL(12,1)) AS STRING), 'K') ELSE CAST(n AS STRING) END AS label FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM {orders}) o",
    "excerpt": "SELECT doc_id, CASE WHEN length(text) > 220 THEN concat(substring(text, 1, 220), '…') ELSE text END AS excerpt FROM {documents}",
    "initials": "SELECT c_custkey AS id, upper(concat(substring(c_name, 1, 1), substring(c_mktsegment, 1, 1))) AS initials, upper(right(c_name, 8)) AS badge FROM {customer}",
    "slug": ("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '.'), '^[.]|[.]$', '') AS slug FROM {part}", "SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '.', 'g'), '^[.]|[.]$', '', 'g') AS slug FROM {part}"),
    "concat_nonempty": "SELECT c_custkey AS id, concat_ws(', ', nullif(c_name, ''), nullif(c_mktsegment, 'BUILDING')) AS line FROM {customer}",
    "location_parse": "SELECT c_custkey AS id, regexp_extract(place, '^(.*?) *[(]([^)]+)[)] *$', 1) AS country, regexp_extract(place, '^(.*?) *[(]([^)]+)[)] *$', 2) AS venue FROM (SELECT c_custkey, concat(n_name, ' (', c_name, ')') AS place FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey) c",
    "split_keywords": ("SELECT doc_id, CAST(size(filter(transform(split(text, ','), x -> trim(x)), x -> x <> '')) AS BIGINT) AS keywords FROM {documents}", "SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS keywords FROM {documents}"),
    "currency_labels": ("SELECT o_orderkey AS id, concat('$', format_number(CAST(floor(o_totalprice) AS BIGINT), 0)) AS label FROM {orders}", "SELECT o_orderkey AS id, concat('$', format('{:,}', CAST(floor(o_totalprice) AS BIGINT))) AS label FROM {orders}"),
    "visual_timeline": ("SELECT o_orderkey AS id, i AS step, CASE WHEN i < k OR (i = k AND k = 4) THEN 'completed' WHEN i = k THEN 'current' ELSE 'upcoming' END AS state FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 3 ELSE 1 END AS k, explode(sequence(0, 4)) AS i FROM {orders}) o", "SELECT o_orderkey AS id, i AS step, CASE WHEN i < k OR (i = k AND k = 4) THEN 'completed' WHEN i = k THEN 'current' ELSE 'upcoming' END AS state FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 3 ELSE 1 END AS k FROM orders) o CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS s(i)"),
    "review_status_transition": "SELECT o_orderkey AS id, CASE r WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Rejected' WHEN 'N' THEN 'Revisions Requested' ELSE o_orderstatus END AS status FROM {orders} LEFT JOIN (SELECT l_orderkey, max_by(l_returnflag, concat(CAST(l_shipdate AS STRING), '/', l_returnflag)) AS r FROM {lineitem} GROUP BY l_orderkey) v ON l_orderkey = o_orderkey",
    "reputation_index": "SELECT o_custkey AS user_id, least(1000, count(*) * 20 + 15 * count(*) FILTER (WHERE o_orderstatus = 'F') + 25 * count(*) FILTER (WHERE o_orderstatus = 'P')) AS score, (count(*) + 1) % 10 = 0 AS milestone FROM {orders} GROUP BY o_custkey",
    "json_props_stats": ("SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM {events} GROUP BY event_type", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM {events} GROUP BY event_type"),
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM {events}) e WHERE r = 1",
    "toggle_state": "SELECT user_id, event_type FROM {events} GROUP BY user_id, event_type HAVING count(*) % 2 = 1",
    "insert_if_absent": "SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type",
    "mark_read": "SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS read_at FROM {events}",
}


def _text(name: str, oracle: bool) -> str:
    text = SQL[name]
    return text if isinstance(text, str) else text[oracle]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named query over the Parquet tables of a folder, as a lazy frame."""
    text = _text(name, False)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **frames)


def oracle(name: str) -> str:
    """The same query for DuckDB."""
    text = re.sub(r"\{(\w+)\}", r"\1", _text(name, True))
    return re.sub(r"\bAS STRING\b", "AS VARCHAR", text).replace("LEFT SEMI JOIN", "SEMI JOIN")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, name=name: run(name, spark, sf_dir)) for name in SQL}


def oracles() -> dict[str, str]:
    return {name: oracle(name) for name in SQL}
