"""Contact groups: members, suppression, records, imports and erasure, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versotext.functions.text import erasure_hash, normal_email


def members(memberships: DataFrame, contacts: DataFrame) -> DataFrame:
    """Memberships with their contact's address."""
    return memberships.join(contacts.select(F.col("id").alias("contact_id"), "email"), "contact_id")


def _held(suppressions: DataFrame, scopes: list[str]) -> DataFrame:
    return suppressions.where(F.col("scope").isin(*scopes)).select("email").distinct()


def with_suppressed(rows: DataFrame, suppressions: DataFrame, scopes: list[str]) -> DataFrame:
    """Adds ``suppressed``: whether the address is suppressed in one of the scopes. Rows neither go nor multiply."""
    held = _held(suppressions, scopes).withColumn("__s", F.lit(True))
    return rows.join(held, "email", "left").withColumn("suppressed", F.col("__s").isNotNull()).drop("__s")


def sendable(rows: DataFrame, suppressions: DataFrame, scopes: list[str]) -> DataFrame:
    return rows.join(_held(suppressions, scopes), "email", "left_anti")


def group_counts(groups: DataFrame, memberships: DataFrame) -> DataFrame:
    """Every group with its number of members, 0 kept."""
    n = memberships.groupBy("project", F.col("group_key").alias("key")).agg(F.count("*").alias("n"))
    return groups.join(n, ["project", "key"], "left").withColumn("members", F.coalesce("n", F.lit(0))).drop("n")


def suppression_counts(suppressions: DataFrame) -> DataFrame:
    return suppressions.groupBy("scope", "source").agg(F.count("*").alias("n")).orderBy("scope", "source")


def contact_records(contacts: DataFrame, memberships: DataFrame, suppressions: DataFrame) -> DataFrame:
    """One nested record for each address: its memberships and its suppressions, each in order.

    An address that is only suppressed has a record too.
    """
    joined = memberships.join(contacts.select(F.col("id").alias("contact_id"), "email"), "contact_id")
    m = joined.groupBy("email").agg(F.array_sort(F.collect_list(F.struct("id", "group_key", "joined_at", "properties_json"))).alias("memberships")) if "properties_json" in joined.columns else joined.groupBy("email").agg(F.array_sort(F.collect_list(F.struct("id", "group_key", "joined_at"))).alias("memberships"))
    s = suppressions.groupBy("email").agg(F.array_sort(F.collect_list(F.struct("scope", "source"))).alias("suppressions"))
    return contacts.select("email", F.col("id").alias("contact_id")).join(m, "email", "left").join(s, "email", "full_outer").withColumn("memberships", F.coalesce("memberships", F.array())).withColumn("suppressions", F.coalesce("suppressions", F.array()))


def import_outcomes(rows: DataFrame, present: DataFrame, suppressions: DataFrame, erased: DataFrame, salt: str, scopes: list[str]) -> DataFrame:
    """``outcome`` of each row (email): erased before suppressed before present before joined."""
    own = rows.withColumn("email", normal_email(F.col("email"))).withColumn("__h", erasure_hash(salt, F.col("email")))
    e = erased.select(F.col("email_hash").alias("__h")).distinct().withColumn("__e", F.lit(True))
    p = present.select("email").distinct().withColumn("__p", F.lit(True))
    s = _held(suppressions, scopes).withColumn("__s", F.lit(True))
    out = F.when(F.col("__e"), "erased").when(F.col("__s"), "suppressed").when(F.col("__p"), "present").otherwise("joined")
    return own.join(e, "__h", "left").join(s, "email", "left").join(p, "email", "left").withColumn("outcome", out).drop("__h", "__e", "__s", "__p")


def tally(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def joined(joins: DataFrame, groups: DataFrame, contacts: DataFrame, memberships: DataFrame, suppressions: DataFrame) -> DataFrame:
    """State after joins (project, group_key, email, at, form, page, properties): one membership for each group and address.

    Only open groups take part. The first join keeps its time, form and page; the latest
    gives the properties. ``is_new`` tells whether the address wasn't a member before.
    """
    open_groups = groups.where("state = 'open'").select("project", F.col("key").alias("group_key"))
    new = joins.withColumn("email", normal_email(F.col("email"))).join(open_groups, ["project", "group_key"], "left_semi").select("project", "group_key", "email", F.col("at").alias("joined_at"), F.col("at").alias("updated_at"), "form", "page", "properties", F.lit(True).alias("fresh"))
    old = memberships.join(contacts.select(F.col("id").alias("contact_id"), "email"), "contact_id").select("project", "group_key", "email", "joined_at", "updated_at", "form", "page", "properties", F.lit(False).alias("fresh"))
    both = new.unionByName(old).groupBy("project", "group_key", "email").agg(
        F.min_by(F.struct("joined_at", "form", "page"), F.struct("fresh", "joined_at")).alias("first"), F.max_by(F.struct("properties", "updated_at"), F.struct("fresh", "updated_at")).alias("last"), F.bool_and("fresh").alias("is_new"),
    )
    rows = both.select("project", "group_key", "email", F.col("first.joined_at").alias("joined_at"), F.col("first.form").alias("form"), F.col("first.page").alias("page"), F.col("last.properties").alias("properties"), F.col("last.updated_at").alias("updated_at"), "is_new")
    return with_suppressed_in(rows, suppressions)


def with_suppressed_in(rows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Adds ``suppressed``: in every scope or in the row's own group."""
    held = suppressions.select("email", "scope").distinct()
    everywhere = held.where("scope = 'all'").select("email", F.lit(True).alias("__a"))
    own = held.select("email", F.col("scope").alias("group_key"), F.lit(True).alias("__g"))
    return rows.join(everywhere, "email", "left").join(own, ["email", "group_key"], "left").withColumn("suppressed", F.coalesce("__a", "__g", F.lit(False))).drop("__a", "__g")


def suppress(suppressions: DataFrame, new: DataFrame) -> DataFrame:
    """Insert where absent, by (email, scope); of several new rows the earliest counts."""
    first = new.withColumn("email", normal_email(F.col("email"))).groupBy("email", "scope").agg(F.min_by(F.struct("source", "created_at"), "created_at").alias("r")).select("email", "scope", "r.source", "r.created_at")
    return suppressions.unionByName(first.join(suppressions.select("email", "scope"), ["email", "scope"], "left_anti"))


def erase(contacts: DataFrame, memberships: DataFrame, erasures: DataFrame, targets: DataFrame, salt: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contacts, memberships and erasures without the targets (project, email): suppressions stay, a salted hash is left."""
    own = targets.withColumn("email", normal_email(F.col("email"))).select("project", "email").distinct()
    gone = contacts.join(own, ["project", "email"], "left_semi").select(F.col("id").alias("contact_id"))
    new = own.select("project", erasure_hash(salt, F.col("email")).alias("email_hash"), at.alias("erased_at")).join(erasures.select("project", "email_hash"), ["project", "email_hash"], "left_anti")
    return contacts.join(own, ["project", "email"], "left_anti"), memberships.join(gone, "contact_id", "left_anti"), erasures.unionByName(new)


def add_groups(groups: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with the new ones, and an answer for each: ok or group_exists."""
    known = groups.select("project", "key").withColumn("__k", F.lit(True))
    answers = new.join(known, ["project", "key"], "left").select("project", "key", F.when(F.col("__k"), "group_exists").otherwise("ok").alias("answer"))
    return groups.unionByName(new.join(groups.select("project", "key"), ["project", "key"], "left_anti")), answers


def set_group_states(groups: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with states from (project, key, new_state), and answers: ok or unknown_group."""
    known = groups.select("project", "key").withColumn("__k", F.lit(True))
    answers = changes.join(known, ["project", "key"], "left").select("project", "key", F.when(F.col("__k"), "ok").otherwise("unknown_group").alias("answer"))
    out = groups.join(changes.select("project", "key", "new_state"), ["project", "key"], "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    return out.select(groups.columns), answers
