import random

from pyspark.sql import functions as F

from shelfmark.functions import quantiles as Q


def test_merged_sketches_keep_their_stated_error(spark):
    rng = random.Random(4)
    rows = [("hot", i % 7, rng.expovariate(0.1)) for i in range(20000)] + [("one", 0, 5.0)] * 50 + [("tiny", 1, 2.0), ("tiny", 2, None)]
    df = spark.createDataFrame(rows, "g string, run int, v double").repartition(6)
    wanted = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    runs = Q.sketch_runs(df, ["g", "run"], "v", k=200)
    merged = Q.quantiles(Q.merge_runs(runs, ["g"]), wanted, k=200)
    got = {r["g"]: r for r in merged.collect()}
    assert (got["hot"]["n"], got["hot"]["runs"], got["one"]["p50"], got["tiny"]["n"]) == (20000, 7, 5.0, 1)
    assert all(r["p10"] and r["p50"] and r["p99"] for r in Q.within(df, ["g"], "v", merged, wanted, slack=3.0).collect())
    wrong = merged.withColumn("p50", F.col("p99"))
    assert not Q.within(df, ["g"], "v", wrong, {"p50": 0.5}, slack=3.0).where("g = 'hot'").first()["p50"]
    assert Q.merge_runs(Q.sketch_runs(df.limit(0), ["g", "run"], "v"), ["g"]).count() == 0
    assert Q.rank_error(200) < 0.02 < Q.rank_error(100)
