"""Conversations, threads, unread counts and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scores import other_party, pair
from plenum.functions.text import plural
from plenum.operators.ordering import newest_first, placed


def summaries(users: DataFrame) -> DataFrame:
    """What others see of a user."""
    return users.select("id", "name", "avatar", "title", "organization")


def _seen_by(conversations: DataFrame) -> DataFrame:
    """Each conversation once for either party: me, partner_id."""
    me = F.explode(F.array("user_a", "user_b"))
    rows = conversations.withColumn("me", me)
    return rows.select(F.col("id").alias("conversation_id"), F.col("created_at").alias("begun_at"), "me", other_party(F.col("me"), F.col("user_a"), F.col("user_b")).alias("partner_id"))


def conversations_of(conversations: DataFrame, messages: DataFrame, users: DataFrame, me: str | None = None) -> DataFrame:
    """The conversations of a user, or of each, with partner, last message and unread count, the latest first; without a message the time of the conversation itself counts.

    Messages are reduced to one row per conversation, and to unread counts per
    sender, before they meet the conversations; partners that don't exist drop out.
    """
    seen = _seen_by(conversations)
    if me is not None:
        seen = seen.filter(F.col("me") == me)
    last = messages.groupBy("conversation_id").agg(F.max(F.struct("created_at", "id", "text")).alias("last"))
    unread = messages.filter("read_at IS NULL").groupBy("conversation_id", F.col("sender_id").alias("partner_id")).agg(F.count(F.lit(1)).alias("unread"))
    partner = summaries(users).select(F.col("id").alias("partner_id"), F.col("name").alias("partner"), F.col("organization").alias("partner_org"))
    rows = seen.join(partner, "partner_id").join(last, "conversation_id", "left").join(unread, ["conversation_id", "partner_id"], "left")
    rows = rows.select("me", "conversation_id", "partner_id", "partner", "partner_org", F.col("last.text").alias("last_message"), F.coalesce("last.created_at", "begun_at").alias("last_time"), F.coalesce("unread", F.lit(0)).alias("unread"))
    return newest_first(rows, "me", "last_time", "conversation_id")


def thread(messages: DataFrame, conversation: str | None = None) -> DataFrame:
    """Messages of a conversation, or of each, the oldest first, with place."""
    rows = messages if conversation is None else messages.filter(F.col("conversation_id") == conversation)
    rows = placed(rows, ["conversation_id"], F.col("created_at"), F.col("id"))
    return rows.select("conversation_id", "place", "id", "sender_id", "text", "created_at", F.col("read_at").isNotNull().alias("read"))


def unread_totals(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """me, unread: what others sent to a user and the user hasn't read, in all conversations; 0 for users without any."""
    m = messages.filter("read_at IS NULL").select("conversation_id", "sender_id")
    met = conversations.join(m, F.col("id") == F.col("conversation_id")).filter((F.col("sender_id") == F.col("user_a")) | (F.col("sender_id") == F.col("user_b")))
    to = met.select(other_party(F.col("sender_id"), F.col("user_a"), F.col("user_b")).alias("me")).groupBy("me").agg(F.count(F.lit(1)).alias("unread"))
    everyone = _seen_by(conversations).select("me").distinct()
    return everyone.join(to, "me", "left").withColumn("unread", F.coalesce("unread", F.lit(0)))


def opened(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """conversations, and one for each new pair asked for (id, a, b, created_at); pairs have one order, and of several ids for a pair the first by time stays."""
    p = pair(F.col("a"), F.col("b"))
    new = asked.filter("a <> b").select("id", p.alias("p"), "created_at").select("id", "p.user_a", "p.user_b", "created_at")
    first = new.groupBy("user_a", "user_b").agg(F.min(F.struct("created_at", "id")).alias("f")).select("f.id", "user_a", "user_b", "f.created_at")
    return conversations.unionByName(first.join(conversations, ["user_a", "user_b"], "left_anti").select(conversations.columns))


def acceptable(texts: DataFrame, most: int = 4000) -> DataFrame:
    """texts with reason: why a message is refused, null for the others; text is stripped."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    reason = F.when(text == "", "empty").when(F.length(text) > most, "too long")
    return texts.withColumn("text", text).withColumn("reason", reason)


def pushed(sent: DataFrame, conversations: DataFrame, users: DataFrame) -> DataFrame:
    """Events for the receivers of new messages: to, type, partner_id, partner (struct), message (struct)."""
    c = conversations.select(F.col("id").alias("conversation_id"), "user_a", "user_b")
    rows = sent.join(c, "conversation_id").withColumn("to", other_party(F.col("sender_id"), F.col("user_a"), F.col("user_b")))
    who = users.select(F.col("id").alias("sender_id"), F.struct("id", "name", "avatar", "title", "organization").alias("partner"))
    message = F.struct("id", "sender_id", "text", "created_at").alias("message")
    return rows.join(who, "sender_id").select("to", F.lit("message").alias("type"), F.col("sender_id").alias("partner_id"), "partner", message)


def people_search(users: DataFrame, query: str, me: str, most: int = 10) -> DataFrame:
    """Other users whose name holds the stripped query (a pattern as LIKE has it, in any case), the first by name; nobody for an empty query."""
    query = query.strip()
    found = F.col("name").ilike(f"%{query}%") & (F.col("id") != me) if query else F.lit(False)
    return summaries(users).filter(found).orderBy("name", "id").limit(most)


def notifications(listed: DataFrame, actions: DataFrame) -> DataFrame:
    """One list per user of unread conversations and of actions on their conferences (me, id, kind, actor, conference_title, at), newest first.

    listed: conversations_of(). The sort key, a time, isn't in the result.
    """
    n = F.col("unread")
    told = F.concat(F.lit("You have "), n.cast("string"), F.lit(" unread message"), plural(n), F.lit(" from "), F.col("partner"))
    messages = listed.filter("unread > 0").select("me", F.concat(F.lit("msg_"), "conversation_id").alias("id"), F.lit("message").alias("type"), told.alias("message"), F.col("last_time").alias("at"))
    what = (
        F.when(F.col("kind") == "committee_interest", F.concat("actor", F.lit(" would like to join the committee of "), "conference_title"))
        .when(F.col("kind") == "sponsorship_inquiry", F.concat("actor", F.lit(" asked about sponsoring "), "conference_title"))
        .otherwise(F.concat("actor", F.lit(" submitted an abstract to "), "conference_title"))
    )
    activity = actions.select("me", F.concat(F.lit("act_"), "id").alias("id"), F.lit("activity").alias("type"), what.alias("message"), "at")
    return newest_first(messages.unionByName(activity), "me", "at", "id").drop("at")


def bell(listed: DataFrame) -> DataFrame:
    """me, unread_messages, waiting: sum of unread counts, and how many notifications there are of either type."""
    return listed.groupBy("me").agg(F.count_if(F.col("type") == "message").alias("waiting_messages"), F.count_if(F.col("type") == "activity").alias("waiting_activity"))


def shown_time(at: Column) -> Column:
    """1/5/2026, 3:04:05 PM"""
    return F.date_format(at, "M/d/yyyy, h:mm:ss a")
