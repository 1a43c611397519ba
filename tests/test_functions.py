import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepweave.functions import quantiles, ranking, scalars, vectors
from stepweave.functions.skew import skew_join


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_bins_are_right_closed_and_missing_is_zero(spark):
    doses = [0.3, 0.5, 0.7, 1.0, 1.2, 1.5, 2.0, 0.0, -1.0, float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(doses)], "i int, v double")
    got = [r.b for r in df.select("i", scalars.bin_of(F.col("v"), (0.5, 1.0, 1.5)).alias("b")).orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 0, 0, 0, 0]


def test_exact_sum_in_any_order(spark):
    for values in ([0.1, 0.2, 0.3, 39.41], [39.41, 0.3, 0.2, 0.1], [0.3, None, 39.41, 0.1, 0.2]):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1)
        assert df.agg(scalars.exact_sum(F.col("v"))).first()[0] == 40.01
        upto = Window.partitionBy(F.lit(1)).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        assert df.select("i", scalars.exact_sum(F.col("v"), upto).alias("s")).orderBy("i").collect()[-1].s == 40.01


def test_exact_sum_of_values_no_decimal_holds(spark):
    for values in ([1e300, 1.0], [1e-30, 2e-30], [math.inf, 1.0], [9e19, 9e19], [None, None], []):
        df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
        assert df.agg(scalars.exact_sum(F.col("v"))).first()[0] == df.agg(F.sum("v")).first()[0]


def test_action_codes_round_trip_and_labels(spark):
    df = spark.range(25).select(F.col("id").cast("int").alias("a"))
    first, second = scalars.decode_action(F.col("a"))
    back = df.select("a", scalars.encode_action(first, second).alias("b"), scalars.action_label(F.col("a")).alias("l"))
    got = {r.a: (r.b, r.l) for r in back.collect()}
    assert all(got[a][0] == a for a in got)
    assert got[0][1] == "no_vaso×no_fluid" and got[8][1] == "vaso_Q1×fluid_Q3"


def test_decode_rejects_unknown_action(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(scalars.action_label(F.lit(25))).collect()


def test_clip_keeps_null_and_ratio_guards(spark):
    row = one(
        spark,
        scalars.clip(F.lit(None).cast("double"), 0, 1).alias("a"),
        scalars.clip(F.lit(7.0), 0, 5).alias("b"),
        scalars.ratio(F.lit(4.0), F.lit(0.0)).alias("c"),
        scalars.ratio(F.lit(4.0), F.lit(2.0)).alias("d"),
    )
    assert tuple(row) == (None, 5.0, None, 2.0)


def test_lenient_timestamp(spark):
    df = spark.createDataFrame([("2150-01-15 12:00:00",), ("nonsense",), (None,)], "t string")
    got = [r.t for r in df.select(scalars.lenient_timestamp(F.col("t")).alias("t")).collect()]
    assert got[0].hour == 12 and got[1:] == [None, None]


def test_vectors(spark):
    q = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    row = one(
        spark,
        vectors.argmax(q).alias("i"),
        vectors.pick(q, F.lit(0)).alias("p"),
        vectors.logsumexp(q).alias("l"),
        vectors.total(vectors.softmax(q)).alias("s"),
        vectors.entropy(vectors.softmax(F.array(F.lit(0.0), F.lit(0.0)))).alias("e"),
    )
    assert row.i == 1 and row.p == 1.0
    assert row.l == pytest.approx(math.log(math.e + 2 * math.e**3))
    assert row.s == pytest.approx(1.0) and row.e == pytest.approx(math.log(2))


@pytest.mark.parametrize("buckets", [1024, 20, 2])
def test_group_quantiles_exact_for_any_buckets(spark, buckets, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = random.Random(3)
    groups = {"hot": [rng.choice([round(rng.gauss(0, 9), 2), 1.0]) for _ in range(900)], "cold": [4.0, 1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("hot", None)], "g string, v double")
    for method, how in (("linear", "linear"), ("nearest", None)):
        got = quantiles.group_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9], method).collect()
        for r in got:
            vs = sorted(groups[r.g])
            assert r.n == len(vs)
            for i, p in enumerate([0.25, 0.5, 0.9]):
                want = np.quantile(vs, p) if how else vs[math.floor((len(vs) - 1) * p + 0.5)]
                assert r[f"q{i}"] == pytest.approx(float(want), abs=1e-12)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_column_quantiles(spark, method):
    vs = [float(i % 37) * 0.1 for i in range(200)]
    df = spark.createDataFrame([(v, None) for v in vs], "a double, b double")
    got = quantiles.column_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], method)
    ordered = sorted(vs)
    want = [
        float(np.quantile(vs, p)) if method == "linear" else ordered[math.floor(199 * p + 0.5)] for p in (0.25, 0.5, 0.75)
    ]
    assert got["a"][0] == 200 and got["a"][1] == pytest.approx(want)
    assert got["b"] == (0, [None] * 3)


def test_spread_rank_is_a_global_rank(spark):
    ids = spark.range(3000).withColumnRenamed("id", "k")
    ranked = ranking.spread_rank(ids, "k", 7)
    digest = F.md5(F.concat_ws(":", F.lit("7"), F.col("k").cast("string")))
    wrong = ranked.withColumn("want", F.row_number().over(Window.orderBy(digest))).where("want <> rank")
    assert ranked.count() == 3000 and wrong.count() == 0


def test_trailing_mean_across_chunks(spark):
    df = spark.range(0, 400, 1, 7).select((F.col("id") * 3).alias("k"), (F.col("id") % 11).cast("double").alias("v"))
    seq = ranking.ordered_index(df, "k", buckets=16)
    got = {r.seq: r.m for r in ranking.trailing_mean(seq, "seq", "v", 50, "m", chunk=60).collect()}
    vs = [i % 11 for i in range(400)]
    assert len(got) == 400
    for s in (1, 2, 49, 50, 51, 60, 61, 110, 400):
        assert got[s] == pytest.approx(sum(vs[max(0, s - 50) : s]) / min(50, s))


def test_hot_key_join_is_split(spark):
    """A third of the rows share one key; the final plan must split its partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        facts = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("v")
        )
        dim = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        out = skew_join(facts, dim, "k").groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
        got = {r.k: (r.s, r.n) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        want = {r.k: (r.s, r.n) for r in facts.groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
        assert got == want
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_skew_join_rejects_unsplittable_kinds(spark):
    with pytest.raises(ValueError):
        skew_join(spark.range(1), spark.range(1), "id", "outer")
