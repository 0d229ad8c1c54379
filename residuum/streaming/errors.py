"""Error metrics of a stream of predictions by time window, and of late rows within the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators.evaluate import errors


def windowed_errors(stream: DataFrame, time: str, pred: Column, real: Column, groups: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The error table of each group and window; state is one row a group and open window, dropped ``late`` after its end."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = errors(marked, pred, real, [F.window(time, width), *groups])
    return out.select(F.col("window.start").alias("start"), *groups, "n", "rmse", "min_abs", "max_abs", "r")
