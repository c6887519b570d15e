"""Continuous scanning. The batch steps are stateless, so a stream uses them unchanged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from urlrisk.operators.detect import scan_urls

REUSE_MINUTES = 10  # fixed value: how long a verdict may be reused
REUSE_WINDOW = f"{REUSE_MINUTES} minutes"


def scan_stream(urls: DataFrame, **options) -> DataFrame:
    """Scan a streaming table of URLs; lists are static tables (see :func:`scan_urls`)."""
    return scan_urls(urls, **options)


def first_verdicts(scans: DataFrame, ts: str = "ts", window: str = REUSE_WINDOW) -> DataFrame:
    """Keep the first scan of each (model_version, url_sha256) within the reuse window."""
    return scans.withWatermark(ts, window).dropDuplicatesWithinWatermark(["model_version", "url_sha256"])


def reuse_verdicts(scans: DataFrame, id_col: str, ts: str = "ts", minutes: int = REUSE_MINUTES) -> DataFrame:
    """Answer every scan: (id_col, ts, model_version, url_sha256, verdict, risk_score, answered_by, reused).

    The first scan of a URL by a model version is kept as state; scans of it less than ``minutes`` away in event time get its verdict and its id. A later one starts
    anew. A timer on the time of arrival drops what was not asked for again for that long, so no row is ever late; of the rows of one batch the earliest comes first.
    """
    key = ["model_version", "url_sha256"]
    span = pd.Timedelta(minutes=minutes)
    schema = f"{id_col} string, {ts} timestamp, model_version string, url_sha256 string, verdict string, risk_score int, answered_by string, reused boolean"

    seen = "_seen"

    def answer(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else None
        arrived = 0
        for frame in frames:
            arrived = max(arrived, int(frame[seen].max().timestamp() * 1000))
            rows = []
            for r in frame.sort_values([ts, id_col]).to_dict("records"):
                own = [r[ts], r["verdict"], r["risk_score"], r[id_col]]
                near = held is not None and abs(r[ts] - held[0]) < span
                used = held if near else own
                rows.append([r[id_col], r[ts], *names, used[1], used[2], used[3], near])
                if held is None or r[ts] - held[0] >= span:
                    held = own
            yield pd.DataFrame(rows, columns=[id_col, ts, *key, "verdict", "risk_score", "answered_by", "reused"])
        if held is not None:
            state.update((pd.Timestamp(held[0]).to_pydatetime(), held[1], int(held[2]), held[3]))
            state.setTimeoutTimestamp(max(arrived, state.getCurrentWatermarkMs()) + minutes * 60_000)

    rows = scans.withColumn(seen, F.current_timestamp()).withWatermark(seen, f"{minutes} minutes").select(seen, F.col(id_col).cast("string").alias(id_col), F.col(ts).cast("timestamp").alias(ts), *key, "verdict", F.col("risk_score").cast("int").alias("risk_score"))
    return rows.groupBy(*key).applyInPandasWithState(
        answer, schema, "started timestamp, verdict string, risk_score int, id string", "append", GroupStateTimeout.EventTimeTimeout
    )


def verdict_counts(scans: DataFrame, ts: str = "ts", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Verdicts per tumbling window; rows later than ``lateness`` are dropped when streaming."""
    if scans.isStreaming:
        scans = scans.withWatermark(ts, lateness)
    counts = scans.groupBy(F.window(ts, width).alias("_w"), "verdict").agg(F.count("*").alias("n"))
    return counts.select(F.col("_w.start").alias("window_start"), "verdict", "n")
