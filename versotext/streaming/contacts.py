"""Streaming forms of the contact operators. The batch operators are the reference; these are additions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from versotext.functions.text import normal_email


def joins(stream: DataFrame) -> DataFrame:
    """First-seen and latest state of each membership of a stream of joins (project, group_key, email, at, properties_json).

    The first join keeps its time, the latest gives the properties; run with output mode update.
    """
    own = stream.withColumn("email", normal_email(F.col("email")))
    return own.groupBy("project", "group_key", "email").agg(F.min("at").alias("joined_at"), F.max_by("properties_json", "at").alias("properties_json"), F.count("*").alias("joins"))


def new_suppressions(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first suppression of each (email, scope) within the watermark."""
    return stream.withColumn("email", normal_email(F.col("email"))).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["email", "scope"])


def scheduler(ticks: DataFrame, turn: Callable[[Column], None], at_col: str = "timestamp") -> DataStreamWriter:
    """Calls ``turn`` with the latest time of each batch of ticks: the clock of a publishing schedule."""

    def each(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max(at_col).alias("now")).collect()[0]["now"]
        if now is not None:
            turn(F.lit(now))

    return ticks.writeStream.foreachBatch(each)
