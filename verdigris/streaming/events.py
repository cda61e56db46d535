"""Events as a stream: repeats dropped and windows closed behind a watermark. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(events: DataFrame, id_col: str = "event_id", ts_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id; on a stream, ids are remembered until the watermark has passed them."""
    if not events.isStreaming:
        return events.dropDuplicates([id_col])
    return events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late).dropDuplicatesWithinWatermark([id_col])


def windowed_totals(events: DataFrame, width: str, slide: str | None = None, key: str = "event_type", ts_col: str = "ts", value_col: str = "value", late: str = "1 hour") -> DataFrame:
    """(started, key, n_events, total) for tumbling windows, or sliding ones where slide is given; later events than late are left out."""
    timed = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    timed = timed.withWatermark(ts_col, late) if events.isStreaming else timed
    span = F.window(ts_col, width, slide) if slide else F.window(ts_col, width)
    return timed.groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"), F.sum(value_col).alias("total")).select(F.col("w.start").alias("started"), key, "n_events", "total")
