"""Small helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.session import checkpoint_dir

# A word is a run of characters other than space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_positions(items: Column, cut: Column) -> Column:
    """The array ``items`` less the sorted positions ``cut``: the stretches between them, so in linear time."""
    def stretch(k: Column) -> Column:
        begin = F.coalesce(F.get(cut, k - 1) + 1, F.lit(0))
        end = F.coalesce(F.get(cut, k), F.size(items))
        return F.slice(items, begin + 1, end - begin)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), stretch))


def scratch_path(df: DataFrame, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/wordmill-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage like a checkpoint, but stays columnar, compressed and
    prunable, and its size is known to the planner.
    """
    path = scratch_path(df, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Readies a session for Python stages over texts.

    Workers can import this package from where the driver has it, if no path is
    set for them; and Arrow batches, whose default of 10,000 rows is meant for
    numbers, hold 1,000 texts, unless the session has its own setting.  (A task's
    memory outside the heap follows the batch: of 10,000 texts it is tens of MB
    a column, in the JVM and in the worker.)
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in a prepared session."""
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns ``c0, c1, ...``: any names, also with dots, pass through Python that way."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's place in ``order`` over the whole table, from 0.

    Rows are range-partitioned with a tie-break, so even equal rows spread over
    the partitions.  The numbered partitions are written before they are
    counted, so both uses see the same boundaries.  What is summed over all
    partitions is one count each.
    """
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(shuffle_partitions(df), *order, "_tie").sortWithinPartitions(*order, "_tie") \
        .select(*[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_in"))
    kept = materialize(placed, "numbered")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_off"))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_off")) \
        .drop("_part", "_in", "_off")
