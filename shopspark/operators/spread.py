"""Partitions by number of rows, where a task holds several times what its shuffle's bytes tell."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition, on the average.
ROWS = 200_000


def parts(*frames: DataFrame, rows: int | None = None) -> int:
    """Partitions for the longest of the frames, at least the default parallelism; the frames are counted."""
    most = max(df.count() for df in frames)
    return max(-(-most // (rows or ROWS)), frames[0].sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df hashed by the keys into n partitions (or as many as its rows ask for), which AQE doesn't coalesce. Shuffled bytes are compressed and
    say little about what sorted windows over wide rows take, so a task's memory stays the same as tables grow."""
    return df.repartition(n or parts(df), *keys)
