"""Inputs of few partitions that several passes read."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def partitions(df: DataFrame) -> int:
    """Partitions in which ``df`` is planned; nothing is run (an adaptive plan would be)."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*").rdd.getNumPartitions()
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is planned in fewer partitions, as a small file of one
    row group is; a large input comes in many and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if partitions(df) < cores else df


def even(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over at least all cores, for costly work on each row: a file may be
    planned in many splits and yet lie in one row group, which one task then reads."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, partitions(df)))


ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows in partitions of about ``ROWS_PER_TASK`` at most, so that what one task
    reads and keeps does not grow with the table; what has that many partitions stays as it is."""
    least = -(-n // ROWS_PER_TASK)
    return df.repartition(least) if partitions(df) < least else df


@contextmanager
def shared(df: DataFrame, always: bool = False):
    """``df`` for several passes: dealt over all cores and kept (MEMORY_AND_DISK: a lost block is
    rebuilt from lineage) if it has few partitions, else as it is, or kept too with ``always``,
    then in partitions of bounded rows."""
    wide = dealt(spread(df), df.count()) if always else spread(df)
    if wide is df and not always:
        yield df
        return
    wide = wide.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield wide
    finally:
        wide.unpersist()
