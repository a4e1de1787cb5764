from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.operators import skew


def rows_of(spark, sizes, nulls=0):
    data = [(k, i) for k, n in sizes.items() for i in range(n)] + [(None, i) for i in range(nulls)]
    return spark.createDataFrame(data, "k string, tx_id int").repartition(4, "tx_id")


SIZES = {"hot": 3000, "warm": 900, **{f"k{i}": i % 5 + 1 for i in range(1500)}}


def test_plan_is_even(spark):
    plan = skew.plan_loads(rows_of(spark, SIZES, 100), "k", tasks=8)
    total = sum(SIZES.values())
    assert plan.total_rows == total + 100 and plan.null_rows == 100
    assert set(plan.heavy) == {"hot", "warm"} and len(plan.heavy["hot"]) > len(plan.heavy["warm"]) >= 2
    assert sum(plan.loads) == pytest.approx(total, rel=0.01) and max(plan.loads) < 1.1 * total / 8


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join_and_is_even(spark, how):
    big = rows_of(spark, SIZES, 50)
    side = spark.createDataFrame([(k, f"v{k}", j) for k in [*list(SIZES)[:700], "nobody", None] for j in range(2)], "k string, v string, tx_id int")
    plan = skew.plan_loads(big, "k", tasks=8)
    out = skew.fragment_replicate_join(big, side, "k", how, plan)
    assert {"tx_id", "tx_id_side", "v"} <= set(out.columns)
    want = big.join(side.withColumnRenamed("tx_id", "tx_id_side"), "k", how)
    cols = ["k", "tx_id", "v", "tx_id_side"]
    assert Counter(map(tuple, out.select(*cols).collect())) == Counter(map(tuple, want.select(*cols).collect()))
    loads = [r[1] for r in skew.fragment(big, "k", plan).groupBy(F.spark_partition_id()).count().collect()]
    assert len(loads) == 8 and max(loads) < 1.15 * sum(loads) / 8
    copies = Counter(r[0] for r in skew.replicate(side, "k", plan).select("k").collect())
    assert copies["hot"] == 2 * len(plan.heavy["hot"]) and copies["k3"] == 2


def test_aggregate_needs_no_second_exchange_of_rows(spark):
    big = rows_of(spark, SIZES)
    plan = skew.plan_loads(big, "k", tasks=8)
    out = skew.balanced_aggregate(skew.fragment(big, "k", plan), "k", {"n": F.count("*"), "top": F.max("tx_id")}, {"n": F.sum("n"), "top": F.max("top")})
    assert {r.k: (r.n, r.top) for r in out.collect()} == {k: (n, n - 1) for k, n in SIZES.items()}
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in text and f"hashpartitioning({skew.TASK}" not in text


def test_small_cases(spark):
    empty = rows_of(spark, {"a": 1}).limit(0)
    plan = skew.plan_loads(empty, "k", tasks=3)
    assert plan.heavy == {} and skew.fragment_replicate_join(empty, empty, "k", "left", plan).count() == 0
    one = rows_of(spark, {"a": 40})
    plan = skew.plan_loads(one, "k", tasks=3)
    assert sorted(plan.heavy["a"]) == [0, 1, 2]
    only_null = rows_of(spark, {}, 5)
    assert skew.fragment_replicate_join(only_null, one, "k", "left").count() == 5 and skew.fragment_replicate_join(only_null, one, "k").count() == 0
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(one, one, "k", "outer")
    numbers = spark.range(100).select((F.col("id") % 3).alias("k"))
    assert skew.fragment_replicate_join(numbers, spark.range(2).withColumnRenamed("id", "k"), "k").count() == 67


def test_packing():
    where, spread, loads = skew.pack({0: 5, 1: 5, 2: 1}, {"x": 30}, 4, 10.0, 3)
    assert len(set(spread["x"])) == 3 and sorted(loads) == [10, 10, 10, 11] and all(0 <= t < 4 for t in where)
