"""Phase-wise evaluation on a stream: calls of single phases, with what a transaction has brought and set so far carried from one to the next.

A call is a row of (tx_id, phase) and the columns that phase brings; others are null. Of the open transactions,
those whose last phase has not come, every batch writes the state to a folder of its own and reads only the one
before, so a batch costs what it brings and what is open, and a repeated batch replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.requests import PAIRS
from ..plans.engine import STATE_TYPE, Evaluator
from ..seclang.ruleset import Ruleset

#: What the phases 1 to 4 bring.
BRINGS = {
    1: {"ts": "timestamp", "method": "string", "uri": "string", "protocol": "string", "request_headers": PAIRS}, 2: {"request_body": "binary"},
    3: {"response_headers": PAIRS}, 4: {"response_body": "binary"}, 5: {},
}
CARRIED = {c: t for own in BRINGS.values() for c, t in own.items()}
CALL = "tx_id bigint, phase int, " + ", ".join(f"{c} {t}" for c, t in CARRIED.items())
_OPEN = "tx_id bigint, ran array<int>, carried " + STATE_TYPE + ", idle int, " + ", ".join(f"{c} {t}" for c, t in CARRIED.items())
VERDICT = ["tx_id", "ran", "matched_rules", "intervention", "allowed", "anomaly_score", "tx"]


def calls(tx: DataFrame, phase: int) -> DataFrame:
    """The calls of one phase for whole transactions; of the second for those with a body phase."""
    rows = tx.where(F.coalesce("has_request_body_phase", F.lit(False))) if phase == 2 else tx
    column = lambda c, t: (F.col(c) if c in BRINGS[phase] else F.lit(None)).cast(t).alias(c)
    return rows.select("tx_id", F.lit(phase).alias("phase"), *[column(c, t) for c, t in CARRIED.items()])


def advance(batch: DataFrame, open_: DataFrame, rules: Ruleset) -> DataFrame:
    """Open transactions and those of ``batch`` after its calls: ``ran``, the carried columns and state, the verdict, and ``idle``, the batches without a call since.

    Calls of a transaction in one batch run in the order of their phases, each phase once, whatever is sent
    again. Calls without tx_id or with a phase other than 1 to 5 are left out.
    """
    got = batch.where(F.col("tx_id").isNotNull() & F.col("phase").between(1, 5)).groupBy("tx_id").agg(
        F.collect_set("phase").alias("phases"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("phase"))).alias(f"new_{c}") for c in CARRIED])
    none = F.expr("cast(array() as array<int>)")
    both = got.join(open_, "tx_id", "full").select(
        "tx_id", F.coalesce("ran", none).alias("ran"), "carried", F.when(F.col("phases").isNull(), F.col("idle") + 1).otherwise(0).alias("idle"),
        F.array_except(F.coalesce("phases", none), F.coalesce("ran", none)).alias("called"), *[F.coalesce(f"new_{c}", c).alias(c) for c in CARRIED])
    return Evaluator(rules).evaluate(both, carried="carried", called="called").withColumn("ran", F.array_sort(F.concat("ran", "called")))


def write_phases(stream: DataFrame, rules: Ruleset, path: str, checkpoint: str, patience: int = 100) -> StreamingQuery:
    """Verdicts of a stream of calls under ``path``, a folder for each batch; ends after what is there.

    A transaction is forgotten after its fifth phase, or after ``patience`` batches without a call.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(_OPEN).parquet(f"{path}/open/{n - 1}") if n else spark.createDataFrame([], _OPEN)
        at = f"{path}/after/{n}"
        advance(batch, before, rules).write.mode("overwrite").parquet(at)
        after = spark.read.parquet(at)
        stays = ~F.array_contains("ran", 5) & (F.col("idle") < patience)
        after.where(stays).select("tx_id", "ran", "carried", "idle", *CARRIED).write.mode("overwrite").parquet(f"{path}/open/{n}")
        after.where(F.size("called") > 0).select(*VERDICT).write.mode("overwrite").parquet(f"{path}/verdicts/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    """Of every transaction the verdict after its last call."""
    df = spark.read.parquet(f"{path}/verdicts")
    last: Column = F.max_by(F.struct(*[c for c in VERDICT if c != "tx_id"]), "batch")
    return df.groupBy("tx_id").agg(last.alias("last")).select("tx_id", "last.*")
