from collections import Counter

import pytest

from sluice.operators import iceberg
from sluice.operators.iceberg import frequent_items


def exact(rows, share):
    n = len(rows)
    return {(f, v, c) for i, f in enumerate(("a", "b")) for v, c in Counter(r[i] for r in rows).items() if v is not None and c >= share * n}


@pytest.mark.parametrize("share", [0.01, 0.05, 0.5, 1.0])
@pytest.mark.parametrize("buckets", [None, 2, 16])
def test_equals_counting(spark, share, buckets, monkeypatch):
    monkeypatch.setattr(iceberg, "FEW_SLOTS", 0 if buckets == 16 else 2000)  # a table of slots in place of literals
    rows = [("hot", str(i % 7)) for i in range(400)] + [(f"v{i}", None) for i in range(500)] + [("", "x"), (" hot", "x"), (None, None)] * 20
    df = spark.createDataFrame([(*r, 1) for r in rows], "a string, b string, n int").repartition(3)
    got = [tuple(r) for r in frequent_items(df, ["a", "b"], share, buckets=buckets).collect()]
    assert set(got) == exact(rows, share) and len(got) == len(set(got))


def test_small_cases(spark):
    df = spark.createDataFrame([("x" * 300_000, None)] * 3, "a string, b string")
    assert [(r.field, len(r.key_text), r.n) for r in frequent_items(df, ["a", "b"], 0.5).collect()] == [("a", 300_000, 3)]
    assert frequent_items(df.limit(0), ["a"], 0.5).count() == 0
    with pytest.raises(ValueError):
        frequent_items(df, ["a"], 0)
