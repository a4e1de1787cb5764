"""Verdicts on a stream of transactions. Evaluation keeps no state, so batches and restarts change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Evaluator
from ..seclang.ruleset import Ruleset


def read_transactions(spark, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear under ``path``."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def score(stream: DataFrame, ruleset: Ruleset, **options) -> DataFrame:
    """``Evaluator.evaluate`` on a stream."""
    return Evaluator(ruleset, **options).evaluate(stream)


def write_verdicts(verdicts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends verdicts to Parquet, each once. ``available_now`` ends after what is there."""
    writer = verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def blocked_per_window(verdicts: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and blocked rows per event-time window; rows later than ``late`` behind the newest are left out of a stream. Null times have no window."""
    if verdicts.isStreaming:
        verdicts = verdicts.withWatermark(ts, late)
    counts = verdicts.groupBy(F.window(ts, window)).agg(F.count("*").alias("n_rows"), F.count_if(F.col("intervention").isNotNull()).alias("n_blocked"))
    return counts.select(F.col("window.start").alias("window_start"), "n_rows", "n_blocked")
