"""Order-dependent operators that stay balanced when one group is huge.

All work on range-partitioned data: rows are sorted across partitions by
the full ordering key, so a group holding a third of all rows is split over
many partitions.  Work inside a partition is bounded by the partition size,
and what crosses partition boundaries is a table with one row per partition.  The
numbered partitions are stored before they are used twice: range boundaries come
from a sample, and two samples need not agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.session import stored


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def successors(df: DataFrame, group: str, order: list[str], value: str, name: str = "next") -> DataFrame:
    """Adds ``name``: ``value`` of the next row of the same ``group`` in ``order`` (null for the last).

    Equivalent to ``lead(value) over (partition by group order by order)``
    without putting a whole group into one task.
    """
    keys = [group] + list(order)
    keyed = stored(df.repartitionByRange(_partitions(df), *keys).withColumn("_p", F.spark_partition_id()), "ordered")
    here = Window.partitionBy("_p", group).orderBy(*order)
    # Whether a row has a next one here is told apart from that row's value being null.
    local = keyed.withColumn("_next", F.lead(value).over(here)).withColumn("_has", F.lead(F.lit(True)).over(here))
    # First row (in key order) of every non-empty partition, and for each
    # partition the first row of the next non-empty one: one row per partition.
    firsts = keyed.groupBy("_p").agg(
        F.min(F.struct(*[F.col(k) for k in keys], F.col(value).alias("_v"))).alias("_f"))
    follow = firsts.select(
        "_p", F.lead("_f").over(Window.orderBy("_p")).alias("_nf"))
    fixed = local.join(F.broadcast(follow), "_p", "left")
    crosses = F.col("_has").isNull() & (F.col(f"_nf.{group}") == F.col(group))
    return fixed.withColumn(name, F.when(crosses, F.col("_nf._v")).otherwise(F.col("_next"))) \
        .drop("_p", "_next", "_has", "_nf")


def dense_order_rank(df: DataFrame, key: Column, name: str = "pos") -> DataFrame:
    """Global 0-based position of each row in ``key`` order, without a single-task window.

    Rows are range-partitioned by the key; each partition numbers its rows and
    adds the counts of all earlier partitions (a table with one row per
    partition, small enough to broadcast).
    """
    keyed = stored(df.withColumn("_k", key).repartitionByRange(_partitions(df), "_k")
                   .withColumn("_p", F.spark_partition_id()), "ordered")
    local = keyed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1)
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    return local.join(F.broadcast(offsets.select("_p", "_off")), "_p").withColumn(
        name, F.col("_i") + F.col("_off")).drop("_k", "_p", "_i", "_off")


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``: the row's 0-based place in ``order`` within its ``group`` (whose columns are not null).

    Like ``row_number()`` by group, but by segmented prefix sums: rows are
    range-partitioned and sorted, each takes its place in its partition, and a group's
    pieces are counted per partition.  A piece's first place and the lengths of the
    pieces before it (one row per partition that the group touches) give the rank,
    so a group that fills a third of the table is spread over as many partitions.
    """
    keys = [*group, *order]
    keyed = stored(df.repartitionByRange(_partitions(df), *keys).sortWithinPartitions(*keys)
                   .withColumn("_p", F.spark_partition_id())
                   .withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    pieces = keyed.groupBy("_p", *group).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(pieces.select("_p", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
                                   .alias("_off")), "offsets")
    return keyed.join(offsets, ["_p", *group]).withColumn(name, F.col("_i") + F.col("_off")).drop("_p", "_i", "_off")
