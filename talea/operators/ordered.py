"""Folds over the rows of a key in their order, for state machines that no aggregate expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[Any, Any], tuple[Any, tuple]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Step, start: Callable[[], Any], schema: str) -> DataFrame:
    """Runs ``state, values = step(state, row)`` over each key's rows in order; the values are appended to the row's columns.

    Rows are brought together by key and sorted in their partition, by a sort
    that spills; the fold streams over them and holds one state at a time, so a
    key may have any number of rows. ``schema`` names the appended columns.
    Null is a key of its own; rows of equal order are taken by all columns.
    """
    columns = df.columns
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], schema])
    names = [*columns, *[x.split()[0] for x in schema.split(", ")]]
    at = [columns.index(k) for k in keys]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for f in frames:
            rows = []
            for row in f.itertuples(index=False, name="Row"):
                now = tuple(None if row[i] != row[i] else row[i] for i in at)
                if now != key:
                    key, state = now, start()
                state, values = step(state, row)
                rows.append(values)
            added = pd.DataFrame(rows, columns=names[len(columns) :], index=f.index)
            yield pd.concat([f, added], axis=1)[names]

    rest = [c for c, t in df.dtypes if c not in keys and c not in order and not t.startswith(("map", "array", "struct", "variant"))]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order, *rest).mapInPandas(fold, out)
