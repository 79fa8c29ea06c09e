"""Request rates: exact sliding windows over tables, and the same over streams with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Answers that leave a task at once.
PART = 1 << 16


def sliding(events: DataFrame, key: str, ts: str, size: str, seconds: int) -> DataFrame:
    """events with requests and tokens: number and sum of size of the key's rows in the last seconds; a row exactly so old doesn't count."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), Window.currentRow)
    return events.withColumn("requests", F.count("*").over(w)).withColumn("tokens", F.sum(size).over(w))


def windowed(events: DataFrame, key: str, ts: str, size: str, length: str, slide: str | None, late: str) -> DataFrame:
    """(key, start, requests, tokens) by event-time window; works on streams, where rows later than the watermark are dropped."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, length, slide), key) if slide else e.groupBy(F.window(ts, length), key)
    return g.agg(F.count("*").alias("requests"), F.sum(size).alias("tokens")).select(key, F.col("window.start").alias("start"), "requests", "tokens")


def limited(events: DataFrame, key: str, ts: str, size: str, rpm: int, tpm: float, seconds: int = 60) -> DataFrame:
    """(key, event_id, ts, admitted) of a stream: a row is admitted if the key's admitted rows of the last seconds leave room for it.

    The state is the list of the admitted rows of one window. Rows of one micro-batch are taken in the order of their time: of each a task
    holds three numbers, and the answers leave it by parts.
    """
    schema = f"`{key}` string, event_id long, ts timestamp, admitted boolean"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [(np.array(p["event_id"]), np.array(p["ts"], "datetime64[us]"), np.array(p["size"], float)) for p in parts]  # copies: no batch is kept
        event, when, amount = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((event, when.view(np.int64), np.isnat(when)))
        at, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        for a in range(0, len(order), PART):
            some = order[a : a + PART]
            out = np.zeros(len(some), bool)
            for i, (now, x) in enumerate(zip(when[some].view(np.int64).tolist(), amount[some].tolist(), strict=True)):
                live = [j for j, y in enumerate(at) if y > now - seconds * 1_000_000]
                at, sizes = [at[j] for j in live], [sizes[j] for j in live]
                if len(at) < rpm and sum(sizes) + x <= tpm:
                    at.append(now)
                    sizes.append(x)
                    out[i] = True
            if a + PART >= len(order):
                state.update((at, sizes))
            yield pd.DataFrame({key: str(k[0]), "event_id": event[some], "ts": when[some].astype("datetime64[ns]"), "admitted": out})

    rows = events.select(F.col(key).cast("string").alias(key), "event_id", F.col(ts).cast("timestamp").alias("ts"), F.col(size).cast("double").alias("size"))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "at array<long>, sizes array<double>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, events): runs of rows with no gap so long."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
