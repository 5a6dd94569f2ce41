"""Event-time operators that work on batch and streaming DataFrames alike, and a stateful running total."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """With a watermark on ``ts``, which a stream only keeps on instants: local times become instants of the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and total by type in windows of event time; ``slide`` makes them overlap, ``late`` sets the watermark of a stream."""
    own = watermarked(events, late) if late else events
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return own.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Each user's sessions: events that follow each other within the gap."""
    own = watermarked(events, late) if late else events
    return own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, late: str, key: str = "event_id") -> DataFrame:
    """First arrivals; a key is remembered for as long as the watermark allows."""
    return watermarked(events, late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """A stream's running count, mean and population variance by user, kept as state (count, mean, squared deviations)."""
    out = "user_id long, n long, mean double, var_pop double"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            values = b["value"].dropna()
            k = len(values)
            if k:
                d = float(values.mean()) - mean
                m2 += float(((values - values.mean()) ** 2).sum()) + d * d * n * k / (n + k)
                mean += d * k / (n + k)
                n += k
        state.update((n, mean, m2))
        yield pd.DataFrame([(key[0], n, mean, m2 / n if n else 0.0)], columns=["user_id", "n", "mean", "var_pop"])

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, out, "n long, mean double, m2 double", "update", "NoTimeout")
