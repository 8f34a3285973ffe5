from pyspark.sql import functions as F

from wordmill.functions.scoring import round3


def test_round3_is_pythons_round(spark):
    ratios = sorted({m / n for n in range(1, 101) for m in range(n + 1)} | {q / 2000 for q in range(2001)})
    df = spark.createDataFrame([(x,) for x in ratios], "x double")
    assert [(r.x, r.y) for r in df.select("x", round3(F.col("x")).alias("y")).collect() if r.y != round(r.x, 3)] == []
