from pyspark.sql import functions as F

from clickstack.llm.suspects import may_hold


def test_listed_hashes_are_always_found(spark):
    every = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    listed = every.where("id % 50 = 0")
    for most, others in ((1 << 28, 0.05), (1 << 16, 0.2)):
        found = every.where(may_hold(listed, "h", most)(F.col("h")))
        assert found.join(listed, "id", "left_semi").count() == 400
        assert found.count() <= 400 + others * 20_000
    assert every.where(may_hold(listed.limit(0), "h")(F.col("h"))).count() == 0
    odd = spark.createDataFrame([(None,), (-1,), (1 << 62,), (0,)], "h long")
    assert sorted(r.h for r in odd.where(may_hold(odd, "h")(F.col("h"))).collect()) == [-1, 0, 1 << 62]
