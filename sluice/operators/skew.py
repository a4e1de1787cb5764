"""Joins and per-key results when a few keys hold most rows.

The method is fragment-replicate by estimated load. One counting pass yields the load of each of a
fixed number of hash buckets; a second, over the few buckets heavy enough to contain one, yields the
exact load of every large key. Buckets and pieces of large keys are then bin-packed on tasks, largest
first. A large key is cut into shards in proportion to its load, its rows are dealt to the shards in
turn, and the matching side's rows of that key go to exactly those tasks.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK, KEY, BUCKET, SHARDS = "__frj_task", "__frj_key", "__frj_bucket", "__frj_shards"


@dataclass(frozen=True)
class LoadPlan:
    """Where keys go. ``heavy`` has at most ``2 * tasks / split`` keys and ``bucket_task`` as many entries as buckets."""

    tasks: int
    total_rows: int
    null_rows: int
    bucket_task: tuple[int, ...]
    heavy: dict
    loads: tuple[int, ...]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pack(light: dict[int, int], heavy: dict, tasks: int, target: float, buckets: int) -> tuple[list[int], dict, list[int]]:
    """Largest-first bin packing of buckets and shards on tasks; shards of one key never share a task."""
    pieces = []
    for k, n in heavy.items():
        shards = min(tasks, max(1, math.ceil(n / target)))
        pieces.append((n / shards, 1, str(k), k, shards))
    pieces += [(n, 0, b, b, 1) for b, n in light.items()]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2] if p[1] else "", p[2] if not p[1] else 0))
    heap = [(0.0, t) for t in range(tasks)]
    where, spread = [b % tasks for b in range(buckets)], {}
    for size, is_key, _, k, shards in pieces:
        taken = [heapq.heappop(heap) for _ in range(shards)]
        for load, t in taken:
            heapq.heappush(heap, (load + size, t))
        if is_key:
            spread[k] = sorted(t for _, t in taken)
        else:
            where[k] = taken[0][1]
    loads = [0] * tasks
    for load, t in heap:
        loads[t] = round(load)
    return where, spread, loads


def plan_loads(df: DataFrame, key: str, tasks: int | None = None, split: float = 0.5) -> LoadPlan:
    """Counts ``key`` over all rows and packs it on ``tasks`` (default: spark.sql.shuffle.partitions).

    A key is large from ``split`` of a task's even share on. The driver receives one row per bucket
    (``max(4096, 16 * tasks)``) and one per large key, of which there can be ``tasks / split``.
    An empty table gives a plan without large keys; nulls are counted but are no key.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4096, 16 * tasks)
    keys = df.select(F.col(key).alias(KEY))
    by_bucket = {
        r[0]: r[1]
        for r in keys.groupBy(F.when(F.col(KEY).isNotNull(), _bucket(F.col(KEY), buckets)).alias(BUCKET)).count().collect()
    }
    nulls = by_bucket.pop(None, 0)
    total = sum(by_bucket.values())
    target = max(1.0, total / tasks * split)
    suspects = [b for b, n in by_bucket.items() if n >= target]
    heavy: dict = {}
    if suspects:
        heavy = {
            r[0]: r[1]
            for r in keys.where(F.col(KEY).isNotNull() & _bucket(F.col(KEY), buckets).isin(suspects)).groupBy(KEY).count().where(F.col("count") >= target).collect()
        }
        for b, n in (
            keys.sparkSession.createDataFrame([(k, n) for k, n in heavy.items()], T.StructType([keys.schema[0], T.StructField("n", T.LongType())]))
            .groupBy(_bucket(F.col(KEY), buckets)).agg(F.sum("n")).collect()
            if heavy else []
        ):
            by_bucket[b] -= n
    where, spread, loads = pack(by_bucket, heavy, tasks, target, buckets)
    return LoadPlan(tasks, total + nulls, nulls, tuple(where), spread, tuple(loads))


def _shards(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """Adds SHARDS, the tasks of a large key, null for others. The broadcast side has one row per large key, a number the plan bounds."""
    if not plan.heavy:
        return df.withColumn(SHARDS, F.lit(None).cast("array<int>"))
    kind = T.StructType([T.StructField(KEY, df.schema[key].dataType), T.StructField(SHARDS, T.ArrayType(T.IntegerType()))])
    large = df.sparkSession.createDataFrame(list(plan.heavy.items()), kind)
    return df.join(F.broadcast(large), df[key] == large[KEY], "left").drop(KEY)


def _light_task(key: Column, plan: LoadPlan) -> Column:
    where = F.from_json(F.lit(json.dumps(plan.bucket_task)), "array<int>")  # folded to one literal
    return F.get(where, _bucket(key, len(plan.bucket_task)))


def fragment(df: DataFrame, key: str, plan: LoadPlan, keep_null: bool = False) -> DataFrame:
    """``df`` with TASK, partitioned by it as planned. Rows of large keys and of the null key are dealt out in turn.

    Dealing uses the row's number in its input partition, so ``df`` should be a scan or a checkpointed
    table, whose partitions are the same when a task runs again.
    """
    turn = F.monotonically_increasing_id()
    out = _shards(df if keep_null else df.where(F.col(key).isNotNull()), key, plan)
    at = F.when(F.col(key).isNull(), F.pmod(turn, F.lit(plan.tasks)).cast("int"))
    at = at.when(F.col(SHARDS).isNotNull(), F.get(F.col(SHARDS), F.pmod(turn, F.size(SHARDS)).cast("int")))
    return out.withColumn(TASK, at.otherwise(_light_task(F.col(key), plan))).drop(SHARDS).repartitionById(plan.tasks, F.col(TASK))


def replicate(side: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """``side`` with TASK: a large key's rows once for each of its shards, other rows once; null keys match nothing and go."""
    out = _shards(side.where(F.col(key).isNotNull()), key, plan)
    tasks = F.coalesce(F.col(SHARDS), F.array(_light_task(F.col(key), plan)))
    return out.withColumn(TASK, F.explode(tasks)).drop(SHARDS).repartitionById(plan.tasks, F.col(TASK))


def fragment_replicate_join(big: DataFrame, side: DataFrame, key: str, how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Equi-join on ``key`` with evenly loaded tasks, how ``inner`` or ``left``.

    Columns of ``side`` whose names clash with those of ``big`` get the suffix ``_side``. Null keys
    match nothing: ``inner`` drops them, ``left`` keeps them with nulls. Repeated rows multiply as in
    any join. Column TASK stays, so a following group by TASK and key needs no exchange.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    plan = plan or plan_loads(big, key)
    taken = {c.lower() for c in big.columns}
    side = side.select(*[F.col(f"`{c}`").alias(f"{c}_side" if c != key and c.lower() in taken else c) for c in side.columns])
    return fragment(big, key, plan, keep_null=how == "left").join(replicate(side, key, plan), [TASK, key], how)


def balanced_aggregate(df: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Per-key results of a fragmented frame: ``partial`` within each task, then ``final`` over a key's few shards."""
    shards = df.groupBy(TASK, key).agg(*[c.alias(n) for n, c in partial.items()])
    return shards.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])
