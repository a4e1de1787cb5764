"""Transactions from the parts they arrive in.

A part is (tx_id, seq, kind, name, value, data, ts): kind ``uri`` (value: URI, name: method, data: protocol),
``request_header``, ``request_body``, ``response_header``, ``response_body`` or ``end``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.requests import PAIRS

PART = "tx_id bigint, seq int, kind string, name string, value string, data binary, ts timestamp"


ONE = "array<struct<seq:int,kind:string,name:string,value:string,data:binary>>"
#: The only store with timers; all stores of an executor share their memory. Changelogs would be written besides the first snapshot.
STORE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.changelogCheckpointing.enabled": "false",
    "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "128", "rocksdb.writeBufferSizeMB": "8",
}
#: State is kept by so many hash buckets of tx_id: what Python does for each key of a state is done once for many transactions.
BUCKETS = 2048
FIELDS = ("seq", "kind", "name", "value", "data")
#: Transactions in a row that ``Gathered`` gives.
GIVEN = 1000
#: In place of null times and seq, and where microseconds leave pandas' range.
NO_TIME, FAR = -(2**63), 9 * 10**15


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tx_id, us, ended, parts) of what a batch has of one tx_id and time, each part once; parts are pickled tuples of ``FIELDS``."""
    for batch in batches:
        sorted_ = batch.take(pa.array(np.lexsort([_numbers(batch[c]) for c in ("seq", "us", "tx_id")])))
        seq, us, tx = (_numbers(sorted_[c]) for c in ("seq", "us", "tx_id"))
        new = (tx[1:] != tx[:-1]) | (us[1:] != us[:-1])
        starts = np.flatnonzero(np.append(len(tx) > 0, new))
        kinds: dict = {}  # one object of each kind, which pickle writes once in a fragment
        kind, *others = (sorted_[c].to_numpy(zero_copy_only=False).tolist() for c in FIELDS[1:])
        numbers = sorted_["seq"].to_pylist() if sorted_["seq"].null_count else seq.tolist()
        every = list(zip(numbers, [kinds.setdefault(k, k) for k in kind], *others, strict=True))
        own = [every[i:j] for i, j in pairwise([*starts.tolist(), len(every)])]
        if not np.all(new | (seq[1:] != seq[:-1])):
            own = [list(dict.fromkeys(parts)) for parts in own]
        ended = np.logical_or.reduceat(pc.equal(sorted_["kind"], b"end").fill_null(False).to_numpy(zero_copy_only=False), starts) if len(tx) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tx[starts]), pa.array(us[starts]), pa.array(ended), pa.array([pickle.dumps(parts, 5) for parts in own], pa.binary())], names=["tx_id", "us", "ended", "parts"])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_TIME).to_numpy()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tx_id, us, parts) of the rows that ``Gathered`` gives."""
    for batch in batches:
        for given in batch["given"]:
            tx, us, fragments = zip(*pickle.loads(given.as_py()), strict=True)
            own = [pickle.loads(f) for f in fragments]
            fields = zip(*chain.from_iterable(own), strict=True)
            struct = pa.StructArray.from_arrays([pa.array(list(v), pa.int32() if c == "seq" else pa.binary()) for c, v in zip(FIELDS, fields, strict=True)], names=FIELDS)
            offsets = pa.array([0, *accumulate(map(len, own))], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(tx, pa.int64()), pa.array(us, pa.int64()), pa.ListArray.from_arrays(offsets, struct)], names=["tx_id", "us", "parts"])


class Gathered(StatefulProcessor):
    """By tx_id of a bucket the parts so far, in microseconds their first and newest time, the watermark when a part last came, and whether ``end`` has come.

    A transaction is due at its newest time. Without any time it is due ``late`` after the newest time of
    all parts when its last part came (the watermark then and twice ``late``), and this is set anew if no time was known then.
    The bucket's timer stands at the first of these.
    """

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gathered", "open binary, size bigint, timer bigint")

    def _open(self) -> tuple[dict, int | None]:
        old = self.state.get()
        return ({}, None) if old is None else (pickle.loads(pa.Codec("zstd").decompress(old[0], old[1])), old[2])

    def _due(self, newest: int | None, seen: int) -> int:
        return seen + self.late_ms if newest is None else -(-newest // 1000)

    def _keep(self, open_: dict, timer: int | None) -> None:
        """``timer`` is one that still stands."""
        due = min(self._due(newest, seen) for _, newest, seen, _, _ in open_.values())
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        whole = pickle.dumps(open_, 5)
        self.state.update((pa.Codec("zstd", 5).compress(whole, asbytes=True), len(whole), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_, timer = self._open()
        now, changed = timerValues.getCurrentWatermarkInMs(), {}
        for tx, us, end, parts in chain.from_iterable(zip(*[df[c].tolist() for c in ("tx_id", "us", "ended", "parts")], strict=True) for df in rows):
            us = None if us == NO_TIME else us
            if tx not in open_:
                open_[tx], changed[tx] = (us, us, max(0, now), end, parts), True
                continue
            first, newest, seen, ended, known = open_[tx]
            if us is not None:
                first, newest = (us, us) if newest is None else (min(first, us), max(newest, us))
            before = pickle.loads(known)
            both = list(dict.fromkeys(chain(before, pickle.loads(parts))))
            if len(both) > len(before):
                known, changed[tx] = pickle.dumps(both, 5), True
            open_[tx] = first, newest, max(seen, now), ended or end, known
        if open_:
            self._keep(open_, timer)
        out = [(tx, open_[tx][0], open_[tx][4]) for tx in changed if open_[tx][3]]
        if out:
            yield pd.DataFrame({"given": [pickle.dumps(out[i : i + GIVEN], 5) for i in range(0, len(out), GIVEN)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, stays = timerValues.getCurrentWatermarkInMs(), {}
        for tx, (first, newest, seen, ended, parts) in self._open()[0].items():
            if self._due(newest, seen) >= now:
                stays[tx] = first, newest, seen, ended, parts
            elif newest is None and seen == 0:
                stays[tx] = first, newest, now, ended, parts
        if stays:
            self._keep(stays, None)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _gathered(parts: DataFrame, late: str) -> DataFrame:
    """(tx_id, parts, ts, ended) of a stream, again whenever an ended transaction gets new parts."""
    spark = parts.sparkSession
    for k, v in STORE.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
    late_ms = spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {late}"))).first()[0]
    plain = parts.select("tx_id", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("us"), "seq", *[F.col(c).cast("binary").alias(c) for c in FIELDS[1:]])
    fragments = plain.mapInArrow(_fragments, "tx_id bigint, us bigint, ended boolean, parts binary")
    time = F.when(F.col("us") != NO_TIME, F.timestamp_micros(F.least(F.greatest("us", F.lit(-FAR)), F.lit(FAR))))
    timed = fragments.withColumn("ts", time).withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("tx_id"), F.lit(BUCKETS)).cast("int"))
    got = timed.groupBy("bucket").transformWithStateInPandas(Gathered(late_ms), "given binary", "Update", "EventTime")
    rows = got.select("given").mapInArrow(_rows, "tx_id bigint, us bigint, parts " + ONE.replace("string", "binary"))
    return rows.select("tx_id", F.sort_array(F.col("parts").cast(ONE)).alias("parts"), F.timestamp_micros("us").alias("ts"), F.lit(True).alias("ended"))


def assemble(parts: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each transaction whose ``end`` part has come: its parts joined in the order of seq.

    The parts of a transaction meet by tx_id alone, whatever their times. Parts sent twice count once
    (equal tx_id, seq and kind); bodies without parts are null. In a stream, use output mode
    ``update``: a transaction comes again when parts come after its ``end``. It is forgotten once the newest time of
    all parts is ``late`` after its own newest; parts without time are kept, never late, and a transaction of
    them alone is forgotten when that time has gone on by ``late`` since its last part. Parts whose time is more than ``late``
    behind the newest of earlier batches are left out; for this, times after 2255 count as of then. The state store of the session becomes RocksDB, which timers need.
    """
    parts = parts.where(F.col("tx_id").isNotNull())
    if parts.isStreaming:
        got = _gathered(parts, late)
    else:
        one = F.struct("seq", "kind", "name", "value", "data")
        got = parts.groupBy("tx_id").agg(F.sort_array(F.collect_set(one)).alias("parts"), F.min("ts").alias("ts"), F.bool_or(F.col("kind") == "end").alias("ended"))

    def of(kind: str) -> Column:
        return F.filter("parts", lambda p: p["kind"] == kind)

    def body(kind: str) -> Column:
        whole = F.aggregate(F.transform(of(kind), lambda p: F.hex(p["data"])), F.lit(""), lambda a, x: F.concat(a, F.coalesce(x, F.lit(""))))
        return F.when(F.size(of(kind)) > 0, F.unhex(whole))

    pairs = lambda kind: F.transform(of(kind), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"))).cast(PAIRS)
    uri = F.get(of("uri"), F.lit(0))
    return got.where("ended").select(
        "tx_id", "ts", uri["name"].alias("method"), uri["value"].alias("uri"), uri["data"].cast("string").alias("protocol"),
        pairs("request_header").alias("request_headers"), body("request_body").alias("request_body"), (F.size(of("request_body")) > 0).alias("has_request_body_phase"),
        pairs("response_header").alias("response_headers"), body("response_body").alias("response_body"))


def write_assembled(assembled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of ``assemble`` to Parquet, a folder for each batch, and ends after what is there. A repeated batch replaces its folder."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")

    return assembled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def read_assembled(spark: SparkSession, path: str, *columns: Column | str) -> DataFrame:
    """What ``write_assembled`` wrote: of each transaction the row of its last batch, or only ``columns`` of it."""
    df = spark.read.parquet(path)
    taken = df.select("tx_id", "batch", *(columns or [c for c in df.columns if c not in ("tx_id", "batch")]))
    if len(taken.select("batch").distinct().take(2)) < 2:  # a batch has one row of each transaction
        return taken.drop("batch")
    return taken.groupBy("tx_id").agg(F.max_by(F.struct(*taken.columns[2:]), "batch").alias("last")).select("tx_id", "last.*")


def to_parts(tx: DataFrame, chunk: int = 16) -> DataFrame:
    """The parts of whole transactions, bodies in pieces of ``chunk`` bytes. Inverse of ``assemble``."""
    text = lambda v: F.lit(None).cast("string") if v is None else v

    def part(kind, name=None, value=None, data=None):
        return F.struct(F.lit(kind).alias("kind"), text(name).alias("name"), text(value).alias("value"), (F.lit(None) if data is None else data).cast("binary").alias("data"))

    def pieces(kind, body):
        n = F.ceil(F.octet_length(body) / chunk).cast("int")
        return F.when(F.octet_length(body) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: part(kind, data=F.substring(body, i * chunk + 1, F.lit(chunk)))))

    heads = lambda kind, c: F.transform(F.col(c), lambda h: part(kind, h["name"], h["value"]))
    none = F.array_except(F.array(part("end")), F.array(part("end")))
    groups = [
        F.array(part("uri", F.col("method"), F.col("uri"), F.col("protocol"))), heads("request_header", "request_headers"), pieces("request_body", F.col("request_body")),
        heads("response_header", "response_headers"), pieces("response_body", F.col("response_body")), F.array(part("end"))]
    all_ = F.concat(*[F.coalesce(g, none) for g in groups])
    return tx.select("tx_id", "ts", F.posexplode(all_).alias("seq", "p")).select("tx_id", "seq", "p.*", "ts")
