"""Trailing history of each session, padded to a fixed length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sentrace.functions.columns import pad_array, pad_mask
from sentrace.operators.intervals import DAY
from sentrace.operators.ordered import time_slices, trailing


def sequences(
    df: DataFrame,
    length: int = 100,
    pad: Sequence[float] | None = None,
    *,
    vector: str = "features",
    keys: Sequence[str] = ("user_id",),
    time: str = "start_time",
    tie: str = "session_id",
    keep: Sequence[str] = (),
    slice_seconds: int = DAY,
) -> DataFrame:
    """One row per session: ``seq`` (at most ``length`` vectors, padded in front) and ``mask``.

    ``pad`` is the padding vector; None means zeros. ``keys`` bounds the history: add the
    split column to keep history from crossing splits. Vectors are gathered per block of a
    user's history, never for a whole user.
    """
    rows = time_slices(df.select(*keys, tie, time, vector, *keep), keys, time, slice_seconds)
    history = trailing(rows, list(keys), [time, tie], "_slice", length, {"_history": f"collect_list({vector})"})
    padding = f"transform({vector}, x -> 0D)"
    if pad is not None:
        padding = f"array({', '.join(f'{p!r}D' for p in pad)})"
    return history.selectExpr(
        tie,
        *keys,
        time,
        *keep,
        f"{pad_array('_history', length, padding)} AS seq",
        f"{pad_mask('size(_history)', length)} AS mask",
    )
