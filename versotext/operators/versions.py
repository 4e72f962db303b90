"""Reads over version tables: scans, pages, before-images and change runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versotext.functions import js


def page_limit(limit: float | None) -> int:
    """A page size from 1 to 200; 50 where none or nothing finite is given."""
    if limit is None or not math.isfinite(limit):
        return 50
    return max(1, min(200, math.floor(limit)))


def read(versions: DataFrame, project: str, keys: list[str] | None = None, locale: str | None = None, preview: bool = False) -> DataFrame:
    """One project's live rows, with ``preview`` also its drafts; no keys given: all, an empty list: none."""
    rows = versions.where((F.col("project") == project) & (F.col("is_active") | (F.lit(preview) & (F.col("state") == "draft"))))
    if keys is not None:
        rows = rows.where(F.col("key").isin(*keys)) if keys else rows.limit(0)
    return rows if locale is None else rows.where(F.col("locale").isin(locale, "default"))


def read_keys(versions: DataFrame, project: str, keys: DataFrame, preview: bool = False) -> DataFrame:
    """The same with the keys as a table."""
    return read(versions, project, preview=preview).join(keys.select("key").distinct(), "key", "left_semi")


def api_rows(rows: DataFrame) -> DataFrame:
    """Rows as a client sees them: the stamp and the change only of drafts."""
    draft = F.col("state") == "draft"
    return rows.select("key", "locale", F.col("state").alias("status"), "is_active", "value_json", F.col("id").alias("version"), F.when(draft, js.iso_utc(F.col("publish_at"))).alias("publish_at"), "target", F.when(draft, F.col("changeset_id")).alias("changeset_id"), "editor", js.iso_utc(F.col("created_at")).alias("created_at"))


def newest_page(rows: DataFrame, limit: float | None = None, before: int | None = None, order: str = "id") -> DataFrame:
    """The newest rows below a cursor, by id: a filter and a top-k, no offset."""
    rows = rows if before is None else rows.where(F.col(order) < before)
    return rows.orderBy(F.desc(order)).limit(page_limit(limit))


def oldest_page(rows: DataFrame, limit: float | None = None, after: int | None = None, order: str = "id") -> DataFrame:
    rows = rows if after is None else rows.where(F.col(order) > after)
    return rows.orderBy(order).limit(page_limit(limit))


def next_cursor(page: DataFrame, limit: float | None, order: str = "id", newest: bool = True) -> int | None:
    """The last id of a full page; None for a shorter one."""
    last = page.agg(F.count("*").alias("n"), (F.min if newest else F.max)(order).alias("last")).collect()[0]
    return last["last"] if last["n"] >= page_limit(limit) else None


def with_previous(rows: DataFrame, identity: list[str], order: str, value: str, counts: Column) -> DataFrame:
    """Adds ``previous_id`` and ``previous_value``: the last row strictly before, among those where ``counts`` holds.

    A window over the identity: one shuffle, no self-join.
    """
    before = Window.partitionBy(*identity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(counts, F.struct(F.col(order).alias("i"), F.col(value).alias("v"))), ignorenulls=True).over(before)
    return rows.withColumn("__p", last).select(*[c for c in rows.columns], F.col("__p.i").alias("previous_id"), F.col("__p.v").alias("previous_value"))


def change_runs(rows: DataFrame, identity: list[str], order: str, value: str) -> DataFrame:
    """Only the rows whose value differs from the one before; an absent value counts as the empty text."""
    own = F.coalesce(F.col(value), F.lit(""))
    before = F.lag(own).over(Window.partitionBy(*identity).orderBy(order))
    return rows.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != own)).drop("__b")


def key_history(commits: DataFrame, key: str, locale: str = "default", limit: int = 1000) -> DataFrame:
    """A key's values over commits (seq, commit, snapshot_json), newest first, where they change.

    ``seq`` grows with time; the newest ``limit`` commits are read.
    """
    newest = commits.orderBy(F.desc("seq")).limit(limit)
    values = F.from_json("snapshot_json", "map<string,map<string,string>>")
    own = newest.select("seq", "commit", F.coalesce(F.element_at(F.element_at(values, F.lit(locale)), F.lit(key)), F.lit("")).alias("value"))
    order = Window.orderBy("seq")  # one key of at most ``limit`` commits
    return own.withColumn("__b", F.lag("value", 1, "").over(order)).where("__b <> value").drop("__b").orderBy(F.desc("seq"))


def sibling_position(elements: DataFrame, parent: list[str], order: str) -> DataFrame:
    """``position`` (from 1) and ``siblings`` of each row among rows with the same parent."""
    own = Window.partitionBy(*parent)
    return elements.withColumn("position", F.row_number().over(own.orderBy(order))).withColumn("siblings", F.count("*").over(own))


def unique_violations(versions: DataFrame) -> DataFrame:
    """Identities with more than one live row or more than one draft: what a unique index would refuse."""
    counts = versions.groupBy("project", "key", "locale").agg(F.count_if(F.col("is_active")).alias("active"), F.count_if(F.col("state") == "draft").alias("drafts"))
    return counts.where("active > 1 or drafts > 1")


def due_drafts(versions: DataFrame, now: Column) -> DataFrame:
    return versions.where((F.col("state") == "draft") & (F.col("publish_at") <= now))


def change_members(versions: DataFrame, changeset: Column | int, published: bool) -> DataFrame:
    """A change's members: published rows with their before-image, or its drafts."""
    own = versions.where(F.col("state") == "published") if published else versions.where(F.col("state") == "draft")
    seen = with_previous(own, ["project", "key", "locale"], "id", "value_json", F.lit(True)) if published else own.select("*", F.lit(None).cast("long").alias("previous_id"), F.lit(None).cast("string").alias("previous_value"))
    return seen.where(F.col("changeset_id") == changeset)


def renamed_to(renames: DataFrame, project: str, key: str) -> DataFrame:
    """Whether a key was ever renamed: at most one row."""
    return renames.where((F.col("project") == project) & (F.col("old_key") == key)).orderBy(F.desc("id")).limit(1)
