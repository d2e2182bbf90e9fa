"""Keyed state over streams: interval maps and changes of payload per entity."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.functions.timefn import micros
from tidelog.operators.intervals import IntervalMap


def stream_periods(intervals: DataFrame, entity: str, start: str, end: str, keep_us: int | None = None) -> DataFrame:
    """After each batch, the period that each of its intervals now lies in: (entity, start_us, stop_us, next_start_us).

    State per entity is the ordered disjoint-interval map. An emitted period replaces those it covers;
    next_start_us is the start of the entity's next period (null if none), so the gap after it is known too.
    Intervals that end before they start, or lack entity or start, are left out; without end they cover the start.

    With ``keep_us``, periods that ended so long before an entity's latest one are final and leave the state, which
    bounds it; an interval that would reach back before them is left out as too late.
    """
    rows = intervals.select(F.col(entity).cast("string").alias("k"), micros(start).alias("s"), F.coalesce(micros(end), micros(start)).alias("e")).where("k is not null and s is not null and e >= s")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap(*map(list, state.get)) if state.exists else IntervalMap()
        seen = []
        for p in parts:
            for s, e in zip(p["s"].tolist(), p["e"].tolist()):
                if keep_us is None or not held.ends or s >= held.ends[-1] - keep_us:
                    held.insert(s, e)
                    seen.append(s)
        at = sorted({bisect.bisect_right(held.starts, s) - 1 for s in seen})
        following = [held.starts[i + 1] if i + 1 < len(held) else None for i in at]
        done = pd.DataFrame({entity: [key[0]] * len(at), "start_us": [held.starts[i] for i in at], "stop_us": [held.ends[i] for i in at], "next_start_us": pd.array(following, "Int64")})
        if keep_us is not None and held.ends:
            past = bisect.bisect_left(held.ends, held.ends[-1] - keep_us)
            del held.starts[:past], held.ends[:past]
        state.update((held.starts, held.ends))
        yield done

    return rows.groupBy("k").applyInPandasWithState(
        update, f"`{entity}` string, start_us bigint, stop_us bigint, next_start_us bigint", "starts array<bigint>, ends array<bigint>", "update", GroupStateTimeout.NoTimeout
    )


def stream_changes(log: DataFrame, entity: str, time: str, payload: str, delay: str = "1 hour") -> DataFrame:
    """Changes of payload per entity as they arrive: (entity, from_payload, to_payload, changed_at).

    State per entity is the last payload and its time. Rows are put in order of time inside a batch; a row
    older than the watermark, which trails the latest time by ``delay``, is dropped (Spark does so where the
    state's timeout is by event time), and one older than the entity's last row can't change it.
    """
    rows = log.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(F.col(entity).cast("string").alias("k"), F.col(time).cast("timestamp").alias("t"), F.col(payload).cast("string").alias("p")).withWatermark("t", delay)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_p = state.get if state.exists else (None, None)
        out = []
        for t, p in sorted((t, p) for part in parts for t, p in zip(part["t"], part["p"])):
            at = int(t.value // 1000)
            if last_t is not None and at < last_t:
                continue
            if last_t is not None and p != last_p:
                out.append((key[0], last_p, p, t))
            last_t, last_p = at, p
        if last_t is not None:
            state.update((last_t, last_p))
        yield pd.DataFrame(out, columns=[entity, "from_payload", "to_payload", "changed_at"])

    return rows.groupBy("k").applyInPandasWithState(update, f"`{entity}` string, from_payload string, to_payload string, changed_at timestamp", "t bigint, p string", "append", GroupStateTimeout.EventTimeTimeout)
