"""Streaming forms of usage: distinct sessions in weekly windows, with late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restora.constants import BY_PP


def weekly_usage(sessions: DataFrame, time: str = "ts", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """BY_PP, WEEK_START, WEEK_END and USAGE of a streaming (or static) table; a repeated session of a pair counts once.

    In a static table it counts at its earliest time; in a stream, at the time that came first.
    """
    sessions, session = sessions.where("SESSION_ID is not null"), [*BY_PP, "SESSION_ID"]
    once = sessions.withWatermark(time, late).dropDuplicatesWithinWatermark(session) if sessions.isStreaming else sessions.groupBy(*session).agg(F.min(time).alias(time))
    span = F.window(time, "7 days", slide) if slide else F.window(time, "7 days")
    counts = once.groupBy(*BY_PP, span).agg(F.count("*").alias("USAGE"))
    return counts.select(*BY_PP, F.col("window.start").alias("WEEK_START"), F.col("window.end").alias("WEEK_END"), "USAGE")
