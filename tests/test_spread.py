"""Splitting crowded keys changes where rows are joined, not which."""

from pyspark.sql import functions as F

from tessera.operators import spread


def rows(spark):
    many = spark.range(0, 30_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), (F.col("id") % 40).alias("v"))
    copies = spark.range(0, 12_000, numPartitions=8).select(F.lit("copies").alias("k"), F.lit(1).cast("long").alias("v"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("copies", 3), ("absent", 4), *((f"k{i}", i) for i in range(0, 500, 2))], "k string, n long")
    return many.union(copies).union(spark.createDataFrame([(None, 1)], "k string, v long")), few


def counted(df):
    return sorted(map(tuple, df.groupBy("k", "v", "n").count().collect()))


def test_same_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 64)
    many, few = rows(spark)
    want = counted(many.join(few, "k"))
    assert counted(spread.meet(many, few, ["k"], split=True)) == want == counted(spread.meet(many, few, ["k"]))
    spark.conf.set(spread.SPLIT, "true")
    try:
        assert counted(spread.meet(many, few, ["k"])) == want
    finally:
        spark.conf.unset(spread.SPLIT)
    assert spread.meet(many.limit(0), few, ["k"], split=True).isEmpty() and spread.meet(many, few.limit(0), ["k"], split=True).isEmpty()


def test_no_part_is_crowded(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 64)
    many, few = rows(spark)
    parts = {r["k"]: r["parts"] for r in spread.crowded(many, ["k"]).collect()}
    assert set(parts) >= {"hot", "copies"} and sum(parts.values()) < 2 * spread.PARTS
    left, right = spread.dealt(many, few, ["k"])
    assert left.count() == many.count()
    sizes = [r["count"] for r in left.where("k = 'hot'").groupBy("part").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 5 * 10_000 / parts["hot"]
    assert left.where("k = 'copies'").groupBy("part").count().count() == 8  # one part for each partition that copies come from
    assert right.where("k = 'hot'").count() == 2 * parts["hot"] and right.where("k = 'k0'").count() == 1
