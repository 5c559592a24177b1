"""Accounts: what is shown of them, sign-up checks and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import strip
from plenum.operators.tables import updated

# The shape of an address, the roles, the least length of a password, and the fields that a user may change.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ROLES = ("professional", "organizer", "sponsor")
PASSWORD_LEAST = 8
EDITABLE = ("name", "title", "organization", "department", "city", "country", "bio")
# ... and the most characters of a bio and of an avatar.
BIO_MOST, AVATAR_MOST = 600, 2_000_000


def public(users: DataFrame, *more: Column) -> DataFrame:
    """Users without secrets; missing texts stay null, a missing flag is false. more: further columns of users, which the endpoint doesn't show."""
    flag = F.coalesce(F.col("reviewer_available").cast("boolean"), F.lit(False)).alias("reviewer_available")
    return users.select("id", "email", "role", "name", "organization", "title", "department", "city", "country", "bio", "avatar", flag, *more)


def checked(asked: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """asked (email, password, name, role) with stripped fields and reason, null where nothing speaks against the sign-up; the first fault counts."""
    rows = asked.withColumns({"email": F.lower(strip(F.coalesce("email", F.lit("")))), "name": strip(F.coalesce("name", F.lit("")))})
    fault = (
        F.when(~F.regexp_like("email", F.lit(EMAIL)), "email")
        .when(F.length(F.coalesce("password", F.lit(""))) < PASSWORD_LEAST, "password")
        .when(F.col("name") == "", "name")
        .when(~F.coalesce(F.col("role").isin(list(ROLES)), F.lit(False)), "role")
    )
    if users is not None:
        known = users.select(F.lower("email").alias("email")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "email", "left")
        fault = F.coalesce(fault, F.when(F.col("_known"), "taken"))
    return rows.withColumn("reason", fault).drop("_known")


def number_between(text: Column, low: float, high: float, whole: bool = False) -> Column:
    """A number from text, null unless it is finite, inside of the bounds and, if asked for, whole."""
    x = text.try_cast("double")
    fits = x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high)
    return F.when(fits & (x == F.floor(x)) if whole else fits, x)


def profile_faults(changes: DataFrame) -> DataFrame:
    """changes (id, fields: a map from column to text or null) with fields reduced to the editable ones, stripped, empty ones null, and reason: the first fault, null for none."""
    known = F.map_filter("fields", lambda k, _: k.isin(list(EDITABLE)))
    clean = F.transform_values(known, lambda _, v: F.nullif(strip(v), F.lit("")))
    rows = changes.withColumn("fields", clean)
    given = lambda c: F.map_contains_key("fields", c)
    reason = F.when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, "nothing to change").when(given("name") & F.col("fields")["name"].isNull(), "name").when(F.length(F.col("fields")["bio"]) > BIO_MOST, "bio")
    return rows.withColumn("reason", reason)


def profile_updates(users: DataFrame, changes: DataFrame) -> DataFrame:
    """users after changes (id once each, fields: a map from column to new text): a field that is there replaces the old value, null or empty clears it, one that isn't there stays.

    A request with a fault (profile_faults) changes nothing.
    """
    good = profile_faults(changes).filter("reason IS NULL").select("id", F.col("fields").alias("_new"))
    rows = users.join(good, "id", "left")
    new = {c: F.when(F.map_contains_key("_new", c), F.col("_new")[c]).otherwise(F.col(c)) for c in EDITABLE if c in users.columns}
    return rows.withColumns(new).select(users.columns)


def availability(users: DataFrame, who: str, flag: bool) -> DataFrame:
    return updated(users, F.col("id") == who, reviewer_available=F.lit(flag))


def allowed_avatar(url: Column) -> Column:
    """Whether an avatar is an image given in place and not too long; null takes the avatar away and is allowed."""
    return url.isNull() | (F.startswith(url, F.lit("data:image/")) & (F.length(url) <= AVATAR_MOST))
