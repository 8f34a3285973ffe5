"""Fixed-iteration PageRank over ``edges(src, dst)`` and ``vertices(id)``.

Rule: every vertex starts at 1.0; each round
``r(v) = reset + (1 - reset) · Σ_{u→v} r(u) / outdeg(u)`` (mass of vertices with
no out-edges is dropped); after the last round ranks are multiplied by
``|V| / Σ r`` so they sum to the vertex count.

Layout per round:
* edges are hash-partitioned by ``src`` once and cached, ranks are partitioned
  by ``id`` with the same partition count, so the rank lookup needs no shuffle;
* contributions are summed per ``dst`` with a partial (map-side) aggregate, the
  only shuffle of the round;
* sources whose out-degree is above a fair share of one partition ("hot"
  sources, at most ``num_partitions`` of them) keep their edges spread evenly
  and read their ranks from a broadcast, so one vertex with a third of all
  edges does not land in one task;
* ranks are checkpointed to the shared checkpoint folder every few rounds to
  cut the lineage (and survive lost executors).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.operators.joins import DEFAULT_BROADCAST_BYTES
from wordmill.session import checkpoint_dir, stored


def pagerank(edges: DataFrame, vertices: DataFrame, reset: float = 0.15, iterations: int = 6,
             num_partitions: int | None = None, checkpoint_every: int = 3,
             hot_degree: int | None = None, hot_floor: int = 10_000) -> DataFrame:
    """``id, pagerank`` for every vertex.

    Sources with more than ``hot_degree`` edges are spread; without it, those
    above a partition's fair share, but no source below ``hot_floor`` edges.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = stored(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct(), "edges")
    outdeg = stored(edges.groupBy("src").agg(F.count(F.lit(1)).alias("outdeg")), "degrees")
    degree = outdeg.agg(F.sum("outdeg").alias("edges"), F.max("outdeg").alias("top")).first()
    n_edges, top = int(degree["edges"] or 0), int(degree["top"] or 0)
    # A source is hot when it alone holds more than a partition's fair share of
    # edges; there can be at most n such sources.  A caller's ``hot_degree`` bounds
    # nothing, so their number is counted before anything of them is broadcast.
    threshold = hot_degree or max(math.ceil(n_edges / n), hot_floor)
    has_hot = top > threshold
    weight = (F.lit(1.0) / F.col("outdeg")).alias("w")
    hot = hot_ids = None
    rest = edges
    if has_hot:
        # The hot sources are split off before any shuffle on the source.
        hot_degrees = outdeg.where(F.col("outdeg") > threshold)
        few = hot_degrees.count() * 24 <= DEFAULT_BROADCAST_BYTES  # an id, a degree or rank, and overhead
        hot_degrees = F.broadcast(hot_degrees) if few else hot_degrees
        hot = edges.join(hot_degrees, "src").select("src", "dst", weight) \
            .repartition(n).persist(StorageLevel.MEMORY_AND_DISK)
        hot_ids = outdeg.where(F.col("outdeg") > threshold).select(F.col("src").alias("id"))
        rest = edges.join(hot_degrees, "src", "left_anti")
    normal = rest.join(outdeg.where(F.col("outdeg") <= threshold), "src").select("src", "dst", weight) \
        .repartition(n, "src").persist(StorageLevel.MEMORY_AND_DISK)

    verts = vertices.select(F.col("id").cast("long")).distinct().repartition(n, "id") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    n_vertices = verts.count()
    ranks = verts.select("id", F.lit(1.0).alias("rank"))
    for i in range(1, iterations + 1):
        contrib = normal.join(ranks, normal.src == ranks.id).select("dst", (F.col("rank") * F.col("w")).alias("c"))
        if has_hot:
            hot_ranks = ranks.join(hot_ids, "id", "left_semi")
            hot_ranks = F.broadcast(hot_ranks) if few else hot_ranks
            contrib = contrib.unionByName(
                hot.join(hot_ranks, hot.src == hot_ranks.id).select("dst", (F.col("rank") * F.col("w")).alias("c")))
        sums = contrib.groupBy("dst").agg(F.sum("c").alias("s"))
        ranks = verts.join(sums, verts.id == sums.dst, "left").select(
            "id", (F.lit(reset) + F.lit(1.0 - reset) * F.coalesce(F.col("s"), F.lit(0.0))).alias("rank"))
        if i % checkpoint_every == 0 or i == iterations:
            ranks = ranks.checkpoint(eager=True)
    total = ranks.agg(F.sum("rank")).first()[0] or 0.0
    factor = (n_vertices / total) if total else 1.0
    # The last round is checkpointed, so the rescale is a narrow projection of it.
    result = ranks.select("id", (F.col("rank") * F.lit(factor)).alias("pagerank"))
    for df in (normal, hot, verts):
        if df is not None:
            df.unpersist()
    return result


def write_ranks(ranks: DataFrame, path: str) -> DataFrame:
    """Ranks (``id, pagerank``) written under ``path``, sorted by id for lookups, and read back."""
    ranks.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)
    return read_ranks(ranks.sparkSession, path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, pagerank double").parquet(path)
