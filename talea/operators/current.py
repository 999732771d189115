"""The latest version of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, *columns: str, key: str = "id", version: str = "updated_at", keep_version: bool = False) -> DataFrame:
    """One row per ``key``: that with the greatest ``version``, with ``columns`` (default: all others).

    Rows without a key are dropped; a null version counts as the oldest. Of
    rows with equal versions the greatest by the columns, in their order, is
    taken, so the result does not depend on the order of the input. Repeats
    are combined before the shuffle; a key with very many rows is no problem.
    That takes a sort on either side of the shuffle, as text is no fixed-width
    value; a window over the shuffled rows would save the first one, but bring
    all versions of a key into one task.
    """
    columns = columns or tuple(c for c in df.columns if c not in (key, version))
    kept = F.max(F.struct(F.col(version).alias("_v"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])).alias("_r")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(kept)
        .select(key, *[F.col(f"_r._{i}").alias(c) for i, c in enumerate(columns)], *([F.col("_r._v").alias(version)] if keep_version else []))
    )
