"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, comp``: for every node of ``links`` (a, b) the smallest node it reaches.

    Every round takes the smallest label among a node and its neighbours, then
    the label of that label, so chains shorten by halves and stars end in two
    rounds.  Minima are partial aggregates: a node with a third of all links is
    split like any other.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct(), "links")
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("comp")), "comp")
    while True:
        label = state.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        near = both.join(label, F.col("b") == F.col("n")).groupBy("a").agg(F.min("c").alias("near"))
        least = state.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jumped = materialize(least.join(label, F.col("mid") == F.col("n")).select(
            "node", F.least("mid", "c").alias("comp"), (F.least("mid", "c") < F.col("old")).alias("moved")), "comp")
        state = jumped.select("node", "comp")
        if not jumped.where("moved").limit(1).count():
            return state
