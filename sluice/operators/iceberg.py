"""Most frequent values of columns with too many distinct values to count.

Iceberg queries by multi-hash filtering: count a fixed number of buckets exactly under several hash
functions, keep the values all of whose buckets reach the threshold, count only those exactly.
Memory depends on the number of buckets, hashes and columns, not on the number of distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Full slots that are written into the plan as literals.
FEW_SLOTS = 2_000


def frequent_items(df: DataFrame, columns: list[str], share: float, hashes: int = 3, buckets: int | None = None) -> DataFrame:
    """Values in at least ``share`` of all rows of ``df``: (field, key_text, n), n exact.

    Rows with a null count as rows, a null is no value. Values are compared exactly as stored (cast to
    string). No value is missed: its buckets hold at least its own rows. An empty table gives no rows.
    ``buckets`` defaults to the power of two of 32 / share or more, so an average bucket stays far
    below the threshold; at most ``len(columns) * hashes / share`` bucket numbers reach the driver,
    and beyond FEW_SLOTS they are broadcast as a table.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    buckets = buckets or 1 << max(10, math.ceil(math.log2(32 / share)))
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(columns)])
    least = max(1, math.ceil(rows.count() * share - 1e-9))
    value = lambda i: F.col(f"v{i}")
    slot = lambda i, h: F.pmod(F.xxhash64(F.lit(h), value(i)), F.lit(buckets)).cast("int")
    # One slot number for every column, hash and bucket; a null has none.
    slots = F.array(*[F.when(value(i).isNotNull(), slot(i, h) + (i * hashes + h) * buckets) for i in range(len(columns)) for h in range(hashes)])
    full = [r[0] for r in rows.select(F.explode(slots).alias("slot")).where(F.col("slot").isNotNull()).groupBy("slot").count().where(F.col("count") >= least).select("slot").collect()]
    if len(full) <= FEW_SLOTS:
        kept = []
        for i, c in enumerate(columns):
            passes = value(i).isNotNull()
            for h in range(hashes):
                passes &= slot(i, h).isin([s % buckets for s in full if s // buckets == i * hashes + h])
            kept.append(F.when(passes, F.struct(F.lit(c).alias("field"), value(i).alias("key_text"))))
        found = rows.select(F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())).alias("v")).select("v.*")
    else:  # too many for the plan: one broadcast table of slot numbers for each hash
        own = lambda i: [(slot(i, h) + (i * hashes + h) * buckets).alias(f"s{h}") for h in range(hashes)]
        each = F.array(*[F.when(value(i).isNotNull(), F.struct(F.lit(c).alias("field"), value(i).alias("key_text"), *own(i))) for i, c in enumerate(columns)])
        found, table = rows.select(F.explode(each).alias("v")).where(F.col("v").isNotNull()).select("v.*"), df.sparkSession.createDataFrame([(s,) for s in full], "s int")
        for h in range(hashes):
            found = found.join(F.broadcast(table.where(F.floor(F.col("s") / buckets) % hashes == h).select(F.col("s").alias(f"s{h}"))), f"s{h}", "left_semi")
    return found.groupBy("field", "key_text").agg(F.count("*").alias("n")).where(F.col("n") >= least)
