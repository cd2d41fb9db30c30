"""Edit streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(edits: DataFrame, key: str = "user_id", gap_ms: int = 800, late: str = "10 seconds") -> DataFrame:
    """The last value of each session of a key's edits; works on streams and on tables.

    Edits gap_ms apart or more are of different sessions.  A stream forgets a session once the watermark has passed its end."""
    timed = edits.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if edits.isStreaming else timed
    out = timed.groupBy(key, F.session_window("ts", f"{gap_ms * 1000 - 1} microseconds").alias("w")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "value", "n")


def changes(edits: DataFrame, key: str = "user_id", value: str = "event_type") -> DataFrame:
    """(key, event_id, value) of a stream's edits that differ from the one before of their key.

    An edit older than the newest one seen of its key is dropped.  A key's state is its
    newest edit; ids and keys are long, values strings."""

    def step(found: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, event, held = state.get if state.exists else (pd.Timestamp.min.value // 1000, -1, None)
        rows, fresh = [], not state.exists
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for r in pdf.itertuples(index=False):
            if not fresh and (r.at, r.event_id) <= (at, event):
                continue
            if fresh or r.value != held:
                rows.append((found[0], r.event_id, r.value))
            at, event, held, fresh = int(r.at), int(r.event_id), r.value, False
        state.update((at, event, held))
        yield pd.DataFrame(rows, columns=[key, "event_id", value])

    timed = edits.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col(value).alias("value"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, {value} string", "at long, event_id long, held string", "append", "NoTimeout")


def commits(log: DataFrame, key: str = "user_id") -> DataFrame:
    """Optimistic commits: (key, event_id, read, version, applied) of attempts (key, event_id, read), in
    the order of event_id.  An attempt is applied only if `read` is the number of attempts applied before it.

    Each key's count is one fold over its attempts in order, so keys are grouped, not windowed."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, out = pdf.sort_values("event_id"), 0, []
        for r in pdf["read"]:
            out.append(r == now)
            now += out[-1]
        return pdf.assign(applied=out, version=pd.Series(out, index=pdf.index).cumsum())[[key, "event_id", "read", "version", "applied"]]

    return log.select(key, "event_id", F.col("read").cast("long").alias("read")).groupBy(key).applyInPandas(fold, f"{key} long, event_id long, read long, version long, applied boolean")
