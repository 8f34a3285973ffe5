"""Join helpers: broadcast only behind a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sides up to this many bytes are broadcast; larger sides take a shuffle join
# (with AQE skew splitting).
DEFAULT_BROADCAST_BYTES = 64 << 20


def frame_bytes(df: DataFrame) -> int:
    """Bytes of all rows: a partial aggregate over the (narrow) side, so no rows move."""
    width = F.lit(16)
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        else:
            width = width + F.lit(8)
    return int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if its rows have at most ``max_bytes`` bytes, else ``df`` unchanged.

    One extra job over the (narrow) side proves the bound instead of trusting
    an optimizer estimate.
    """
    return F.broadcast(df) if frame_bytes(df) <= max_bytes else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A corpus that lies in a single file, dealt evenly over the cores.

    A file of one row group would else be one task.  A corpus of several files
    arrives in splits of its own and stays as it is, so what is shuffled here is
    never more than one file; listing the files runs no job.
    """
    if len(df.inputFiles()) != 1:
        return df
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
