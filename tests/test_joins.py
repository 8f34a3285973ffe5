from wordmill.operators.joins import bounded_broadcast, frame_bytes, spread


def _hinted(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_bounded_broadcast_checks_the_bytes(spark):
    small = spark.range(10)
    assert frame_bytes(small) == 240
    assert _hinted(bounded_broadcast(small, max_bytes=240))
    assert not _hinted(bounded_broadcast(small, max_bytes=239))


def test_spread_only_deals_out_a_single_file(spark, scratch):
    spark.range(100).coalesce(1).write.parquet(f"{scratch}/one")
    spark.range(100).repartition(3).write.parquet(f"{scratch}/three")
    one, three = spark.read.parquet(f"{scratch}/one"), spark.read.parquet(f"{scratch}/three")
    assert spread(one, 4).rdd.getNumPartitions() == 4
    assert spread(three, 4) is three
