"""Queries on nested columns, global ranks and a stream, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import nested
from plenum.plans.streams import by_slices
from plenum.sources.tables import read, work_folder
from plenum.streaming import conversations


def submissions_with_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with their reviews as a child array, written as text, and whether there are any."""
    reviews = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = nested.with_children(read(spark, sf_dir, "orders").select("o_orderkey"), reviews, "o_orderkey", "reviews", "l_linenumber", "l_returnflag")
    text = F.array_join(F.transform("reviews", lambda r: F.concat(r.l_linenumber.cast("string"), F.lit(":"), r.l_returnflag)), ",")
    return found.select(F.col("o_orderkey").alias("id"), text.alias("reviews"), (F.size("reviews") > 0).alias("reviewed"))


def agenda_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with their sessions in order, as text."""
    days = nested.agenda(read(spark, sf_dir, "orders"), F.col("o_orderdate"), "o_orderdate", "o_orderkey")
    text = F.array_join(F.transform("sessions", lambda s: s.o_orderkey.cast("string")), ",")
    return days.select("date", "day_name", text.alias("sessions"))


def reaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of counter columns as rows, without zeros."""
    return nested.breakdown(read(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_linenumber") * 0).alias("none"), F.col("l_quantity").cast("long").alias("l_quantity")), "l_linenumber", "none", "l_quantity")


def starting_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least price of each brand's packages."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_retailprice").alias("price"))


def package_starting_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least price in each conference's array of packages."""
    packages = F.array(*(F.struct((F.col("p_retailprice") * k).alias("price")) for k in (2, 1, 3)))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), nested.starting_price(packages).alias("price"))


def reviewer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback scores by place in the pool: 94 and 5 less for each place."""
    pool = nested.ranked(read(spark, sf_dir, "supplier").filter("s_name <> 'Supplier#000000002'"), "s_suppkey")
    return pool.select(F.col("s_suppkey").alias("id"), F.least(F.lit(97), 94 - 5 * (F.col("rank") - 1)).alias("score"))


def committee_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback scores by balance: 95 and 6 less for each place."""
    pool = nested.ranked(read(spark, sf_dir, "supplier"), "s_acctbal", F.col("s_suppkey"), descending=True)
    return pool.select(F.col("s_suppkey").alias("id"), F.least(F.lit(98), 95 - 6 * (F.col("rank") - 1)).alias("score"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of messages and reads, a slice of time a batch."""
    kind = F.when(F.col("event_type") == "view", "read").otherwise(conversations.MESSAGE)
    return by_slices(read(spark, sf_dir, "events").select(kind.alias("type"), F.col("user_id").cast("string").alias("partner_id"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type") == "view").alias("thread_open")), "created_at")


def _kept(stream: DataFrame, mode: str, dealt=lambda rows: rows) -> DataFrame:
    """The rows of all batches with batch, their number, written to the shared folder as dealt; runs at once."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    conversations.run_to_end(stream, folder, mode, lambda rows, n: dealt(rows).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
    return spark.read.parquet(f"{folder}/rows")


def _newest(updates: DataFrame) -> DataFrame:
    """The newest row of each key, with the time as the tables have it."""
    return conversations.latest_of_updates(updates).withColumn("last_time", F.col("last_time").cast("timestamp_ntz"))


def message_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation state from a stream over the events: each batch writes the keys that it changed, and the newest row of each key counts."""
    return _newest(_kept(conversations.state(_events(spark, sf_dir)), "update"))


def message_stream_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation state where reading a thread sets its unread count back."""
    return _newest(_kept(conversations.state_with_resets(_events(spark, sf_dir)), "update"))


def message_stream_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of open threads, appended as they come, dealt by receiver."""
    sent = _events(spark, sf_dir).filter("type = 'message'").withColumn("to", F.col("partner_id"))
    return _kept(sent, "append", conversations.routed).select("to", "text", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def fresh_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers of the last hour before the end of January 2024, by normalised query."""
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" ")).alias("query"), F.col("event_id").alias("answer"), F.col("ts").alias("fetched_at"))
    return conversations.fresh(rows.filter("fetched_at <= TIMESTAMP '2024-01-15 12:00:00'"), F.expr("TIMESTAMP '2024-01-15 12:00:00'"), 36000)


QUERIES = {
    "submissions_with_reviews": (submissions_with_reviews, "SELECT o_orderkey AS id, coalesce(t, '') AS reviews, t IS NOT NULL AS reviewed FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS t FROM lineitem GROUP BY l_orderkey) r ON l_orderkey = o_orderkey"),
    "agenda_days": (agenda_days, "SELECT CAST(o_orderdate AS DATE) AS date, dayname(CAST(o_orderdate AS DATE)) AS day_name, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS sessions FROM orders GROUP BY CAST(o_orderdate AS DATE)"),
    "reaction_totals": (reaction_totals, "SELECT 'l_linenumber' AS reaction, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem UNION ALL SELECT 'l_quantity', CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem"),
    "starting_prices": (starting_prices, "SELECT p_brand AS brand, min(p_retailprice) AS price FROM part GROUP BY p_brand"),
    "package_starting_prices": (package_starting_prices, "SELECT p_partkey AS id, p_retailprice AS price FROM part"),
    "message_stream_with_resets": (message_stream_with_resets, "SELECT CAST(e.user_id AS VARCHAR) AS partner_id, arg_max(event_type, ts) FILTER (WHERE event_type <> 'view') AS last_message, max(ts) FILTER (WHERE event_type <> 'view') AS last_time, count(*) FILTER (WHERE event_type <> 'view' AND (seen IS NULL OR ts > seen)) AS unread FROM events e LEFT JOIN (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY 1) r ON r.user_id = e.user_id GROUP BY e.user_id"),
    "message_stream_threads": (message_stream_threads, "SELECT CAST(user_id AS VARCHAR) AS \"to\", event_type AS text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type <> 'view'"),
    "fresh_answers": (fresh_answers, "SELECT event_type AS query, arg_max(event_id, ts) AS answer FROM events WHERE ts > TIMESTAMP '2024-01-15 02:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY event_type"),
    "reviewer_ranks": (reviewer_ranks, "SELECT s_suppkey AS id, least(97, 94 - 5 * (row_number() OVER (ORDER BY s_suppkey) - 1)) AS score FROM supplier WHERE s_name <> 'Supplier#000000002'"),
    "committee_ranks": (committee_ranks, "SELECT s_suppkey AS id, least(98, 95 - 6 * (row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1)) AS score FROM supplier"),
    "message_stream_state": (message_stream_state, "SELECT CAST(user_id AS VARCHAR) AS partner_id, split_part(max(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '|' || event_type), '|', 2) AS last_message, max(ts) AS last_time, count(*) FILTER (WHERE event_type <> 'view') AS unread FROM events GROUP BY user_id"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items()}
