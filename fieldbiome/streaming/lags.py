"""Lags and differences of streamed series: each row goes out with its forerunners once none can come between them any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def lagged(rows: DataFrame, key: str, ts: str, values: list[str], steps: int = 2, late: str | None = None) -> DataFrame:
    """(key, ts, values, <value>_lag1 .., d_<value>): each row with the values of the `steps` rows before it in its series, and the
    difference from the last one; null where there are none.

    In a stream, rows wait in their series' state until the watermark passes them (late: its delay; None: rows carry one already),
    then go out in the order of ts, of equal ones in the order of values; a timer on the watermark wakes series without new rows.
    Rows that come later than the watermark are dropped, as by other streamed operators. State holds what waits and `steps` rows.
    Rows without key or ts go; values are numbers. Tables that don't stream give the same rows at once.
    """
    kept = rows.select(key, ts, *[F.col(v).cast("double").alias(v) for v in values]).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    names = [f"{v}_lag{k}" for v in values for k in range(1, steps + 1)]
    if not rows.isStreaming:
        from pyspark.sql import Window

        w = Window.partitionBy(key).orderBy(ts, *values)
        lags = [F.lag(v, k).over(w).alias(f"{v}_lag{k}") for v in values for k in range(1, steps + 1)]
        return kept.select("*", *lags).select(key, ts, *values, *names, *[(F.col(v) - F.col(f"{v}_lag1")).alias(f"d_{v}") for v in values])
    if late:
        kept = kept.withWatermark(ts, late)

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = state.get if state.exists else ([], [])
        waiting = [tuple(r) for r in waiting]
        if not state.hasTimedOut:
            for batch in batches:
                ns = batch[ts].astype("datetime64[us]").astype("int64")
                waiting += zip(ns.tolist(), *[batch[v].tolist() for v in values], strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[0], *[(x == x, x) for x in r[1:]]))  # NaN stands for null, which goes first
        ready = [r for r in waiting if r[0] <= passed]  # a row at the watermark would be late
        waiting = waiting[len(ready) :]
        out = []
        last = [tuple(r) for r in last]
        for r in ready:
            before = [last[-k][i] if k <= len(last) else None for i in range(len(values)) for k in range(1, steps + 1)]
            d = [None if not last else x - last[-1][i] for i, x in enumerate(r[1:])]
            out.append((who[0], pd.Timestamp(r[0], unit="us"), *r[1:], *before, *d))
            last = [*last, r[1:]][-steps:]
        state.update(([list(map(float, r)) for r in waiting], [list(map(float, r)) for r in last]))
        if waiting:
            state.setTimeoutTimestamp(max(int(waiting[0][0] // 1000) + 1, int(passed // 1000) + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, ts, *values, *names, *[f"d_{v}" for v in values]])

    kinds = dict(kept.dtypes)
    schema = f"`{key}` {kinds[key]}, `{ts}` timestamp, " + ", ".join(f"`{c}` double" for c in [*values, *names, *[f"d_{v}" for v in values]])
    return kept.groupBy(key).applyInPandasWithState(step, schema, "waiting array<array<double>>, last array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)
