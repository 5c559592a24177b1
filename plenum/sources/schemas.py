"""Declared schemas of the tables: columns, defaults, keys, checks and references, and what a frame breaks of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """ddl: columns with types; unique: groups of columns; checks: allowed values of a column; references: column -> table."""

    ddl: str
    unique: tuple[tuple[str, ...], ...] = (("id",),)
    checks: dict[str, tuple] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


# The tables of the application with their columns, keys, allowed values and defaults.
TABLES = {
    "users": Table("id STRING NOT NULL, email STRING NOT NULL, password_hash STRING, google_id STRING, role STRING NOT NULL, name STRING NOT NULL, organization STRING, title STRING, avatar STRING, created_at TIMESTAMP NOT NULL, department STRING, city STRING, country STRING, bio STRING, reviewer_available BOOLEAN NOT NULL", (("id",), ("email",)), {"role": ("professional", "organizer", "sponsor")}, {}, {"reviewer_available": False}),
    "submissions": Table("id STRING NOT NULL, submitter_id STRING NOT NULL, conference_id STRING NOT NULL, conference_title STRING NOT NULL, title STRING NOT NULL, track STRING, topic STRING, keywords STRING NOT NULL, abstract_text STRING NOT NULL, preferred_type STRING NOT NULL, primary_author_name STRING NOT NULL, primary_author_email STRING NOT NULL, primary_author_affiliation STRING, primary_author_bio STRING, co_authors STRING NOT NULL, conflict_of_interest STRING, status STRING NOT NULL, submission_date TIMESTAMP NOT NULL, revisions_count BIGINT NOT NULL", references={"submitter_id": "users"}, defaults={"keywords": "[]", "co_authors": "[]", "preferred_type": "Oral", "status": "Submitted", "revisions_count": 0}),
    "submission_revisions": Table("id STRING NOT NULL, submission_id STRING NOT NULL, author_id STRING NOT NULL, note STRING NOT NULL, created_at TIMESTAMP NOT NULL", references={"submission_id": "submissions", "author_id": "users"}),
    "submission_reviews": Table("id STRING NOT NULL, submission_id STRING NOT NULL, reviewer_id STRING NOT NULL, reviewer_name STRING NOT NULL, reviewer_org STRING, scores STRING NOT NULL, overall_score DOUBLE NOT NULL, comments_to_author STRING NOT NULL, confidential_comments STRING, recommendation STRING NOT NULL, created_at TIMESTAMP NOT NULL", references={"submission_id": "submissions", "reviewer_id": "users"}),
    "review_volunteers": Table("id STRING NOT NULL, reviewer_id STRING NOT NULL, opportunity_id STRING NOT NULL, conference_title STRING NOT NULL, topic STRING, created_at TIMESTAMP NOT NULL", (("id",), ("reviewer_id", "opportunity_id")), {}, {"reviewer_id": "users"}),
    "conference_registrations": Table("id STRING NOT NULL, user_id STRING NOT NULL, conference_id STRING NOT NULL, conference_title STRING NOT NULL, package_id STRING, package_name STRING, registered_at TIMESTAMP NOT NULL", (("id",), ("user_id", "conference_id")), {}, {"user_id": "users"}),
    "conversations": Table("id STRING NOT NULL, user_a STRING NOT NULL, user_b STRING NOT NULL, created_at TIMESTAMP NOT NULL", (("id",), ("user_a", "user_b")), {}, {"user_a": "users", "user_b": "users"}),
    "messages": Table("id STRING NOT NULL, conversation_id STRING NOT NULL, sender_id STRING NOT NULL, text STRING NOT NULL, read_at TIMESTAMP, created_at TIMESTAMP NOT NULL", references={"conversation_id": "conversations", "sender_id": "users"}),
    "conference_interactions": Table("id STRING NOT NULL, user_id STRING NOT NULL, conference_id STRING NOT NULL, type STRING NOT NULL, created_at TIMESTAMP NOT NULL", (("id",), ("user_id", "conference_id", "type")), {"type": ("saved", "followed")}, {"user_id": "users"}),
    "organizer_broadcasts": Table("id STRING NOT NULL, organizer_id STRING NOT NULL, recipient_group STRING NOT NULL, subject STRING NOT NULL, body STRING NOT NULL, created_at TIMESTAMP NOT NULL", references={"organizer_id": "users"}),
    "created_conferences": Table("id STRING NOT NULL, organizer_id STRING NOT NULL, data STRING NOT NULL, created_at TIMESTAMP NOT NULL", references={"organizer_id": "users"}),
    "conference_interest_actions": Table("id STRING NOT NULL, user_id STRING NOT NULL, conference_id STRING NOT NULL, conference_title STRING NOT NULL, kind STRING NOT NULL, created_at TIMESTAMP NOT NULL", (("id",), ("user_id", "conference_id", "kind")), {"kind": ("committee_interest", "sponsorship_inquiry")}, {"user_id": "users"}),
    "conference_feedback": Table("id STRING NOT NULL, user_id STRING NOT NULL, conference_id STRING, conference_title STRING NOT NULL, role STRING NOT NULL, ratings STRING NOT NULL, overall_score DOUBLE NOT NULL, comment STRING, recipient_email STRING, created_at TIMESTAMP NOT NULL", references={"user_id": "users"}),
    "sponsorship_packages": Table("id STRING NOT NULL, conference_id STRING NOT NULL, conference_title STRING NOT NULL, organizer_id STRING NOT NULL, tier STRING NOT NULL, price DOUBLE NOT NULL, benefits STRING NOT NULL, booth_space STRING, speaking_ops STRING, total_slots BIGINT NOT NULL, source_opportunity_id STRING, created_at TIMESTAMP NOT NULL", references={"organizer_id": "users"}, defaults={"price": 0.0, "benefits": "[]", "total_slots": 1}),
    "sponsorship_applications": Table("id STRING NOT NULL, package_id STRING NOT NULL, sponsor_id STRING NOT NULL, status STRING NOT NULL, created_at TIMESTAMP NOT NULL, decided_at TIMESTAMP", (("id",), ("package_id", "sponsor_id")), {"status": ("Pending", "Approved", "Rejected")}, {"package_id": "sponsorship_packages", "sponsor_id": "users"}, {"status": "Pending"}),
    "sponsor_reviews": Table("id STRING NOT NULL, sponsor_id STRING NOT NULL, organizer_id STRING NOT NULL, conference_title STRING NOT NULL, rating BIGINT NOT NULL, comment STRING, created_at TIMESTAMP NOT NULL", (("id",),), {"rating": (1, 2, 3, 4, 5)}, {"sponsor_id": "users", "organizer_id": "users"}),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], TABLES[name].schema)


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """rows with the declared columns, in order and cast: missing ones are added as null, then defaults fill nulls; other columns go."""
    table, have = TABLES[name], set(rows.columns)
    cast = lambda f: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
    filled = lambda f, c: F.coalesce(c, F.lit(table.defaults[f.name])) if f.name in table.defaults else c
    return rows.select([filled(f, cast(f)).alias(f.name) for f in table.schema])


def rebuilt(old: DataFrame, name: str, **added: Column) -> DataFrame:
    """A table copied into its present declaration (an older one may lack columns), with values for some of the new columns."""
    return conformed(old.withColumns({c: v for c, v in added.items() if c not in old.columns}), name)


def broken(rows: DataFrame, name: str, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """rule, n: how many rows break each rule of the declaration (nulls, values, keys, references to the given tables); all rules are listed.

    Nulls and values are counted in one pass; each key is one aggregation, each reference one anti join.
    """
    table = TABLES[name]
    rules = {f"{f.name} is null": F.col(f.name).isNull() for f in table.schema if not f.nullable}
    rules |= {f"{c} is allowed": F.col(c).isNotNull() & ~F.col(c).isin(list(values)) for c, values in table.checks.items()}
    counts = rows.agg(*(F.count_if(c).alias(rule) for rule, c in rules.items())).unpivot([], list(rules), "rule", "n")
    for key in table.unique:
        again = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
        counts = counts.unionByName(again.select(F.lit(f"unique {' '.join(key)}").alias("rule"), "n"))
    for column, other in table.references.items():
        if others and other in others:
            lost = rows.filter(F.col(column).isNotNull()).join(others[other].select(F.col("id").alias(column)), column, "left_anti")
            counts = counts.unionByName(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{column} in {other}").alias("rule"), "n"))
    return counts


def columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table, place, column, type of the given frames, from their schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, t in sorted(tables.items()) for i, f in enumerate(t.schema)]
    return spark.createDataFrame(rows, "table string, place int, column string, type string")
