"""The folds of recorded events, run over streams with kept state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talea.operators.ordered import Step
from talea.operators.streams import BATCH_ROWS


def stream_fold(events: DataFrame, keys: list[str], order: list[str], step: Step, start: Callable[[], Any], schema: str, idle_ms: int | None = None) -> DataFrame:
    """The stream's rows with what ``step`` gives for each, in their order within a key and micro-batch.

    The step is that of the batch form; its state is kept as JSON between
    micro-batches, and dropped after ``idle_ms`` without a row, if given.
    """
    columns = events.columns
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema], schema])
    added = [x.split()[0] for x in schema.split(", ")]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        kept = json.loads(state.get[0]) if state.exists else start()
        values = []
        for r in rows.itertuples(index=False, name="Row"):
            kept, v = step(kept, r)
            values.append(v)
        state.update((json.dumps(kept),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        rows[added] = pd.DataFrame(values, index=rows.index, columns=added)
        yield rows[[*columns, *added]]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(*keys).applyInPandasWithState(fold, out, "state string", "append", timeout)


def stream_batches(events: DataFrame, key: str, id: str, rows: int = BATCH_ROWS, idle_ms: int = 250) -> DataFrame:
    """``key, batch, n, ids``: batches flushed when ``rows`` are buffered or nothing came for ``idle_ms`` of processing time."""
    name = f"`{key}` {events.schema[key].dataType.simpleString()}"

    def flush(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        out = []
        if state.hasTimedOut:
            out, held = ([held] if held else []), []
        else:
            held += [str(x) for f in frames for x in f[id]]
            while len(held) >= rows:
                out.append(held[:rows])
                held = held[rows:]
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "batch": range(done + 1, done + 1 + len(out)), "n": [len(x) for x in out], "ids": out})
        state.update((done + len(out), json.dumps(held)))
        if held:
            state.setTimeoutDuration(idle_ms)

    return events.groupBy(key).applyInPandasWithState(flush, f"{name}, batch bigint, n bigint, ids array<string>", "done bigint, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, at: str, labels: list[str], late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """``window_start, labels, n`` per event-time window, closed when the watermark passes."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    counts = events.withWatermark(at, late).groupBy(window.alias("w"), *labels).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *labels, "n")
