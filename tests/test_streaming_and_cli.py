from collections import Counter

from sluice import cli
from sluice.functions.requests import TRANSACTION
from sluice.plans.engine import Evaluator
from sluice.seclang.ruleset import Ruleset
from sluice.streaming import assemble, verdicts

RULES = 'SecRule REQUEST_URI "@contains /admin" "id:1,phase:1,deny,msg:\'no\'"\nSecRule ARGS_POST:q "@streq 1" "id:2,phase:2,deny"\nSecRule REQUEST_HEADERS:x "@streq 1" "id:3,phase:1,setvar:tx.anomaly_score=+3"\n'


def rows(n):
    return [(i, None, "POST", f"/{'admin' if i % 3 == 0 else 'x'}/{i}", "HTTP/1.1", [("X", "1")], bytearray(b"a=" + b"b" * (i * 7)) if i % 2 else None, bool(i % 2), None, [("A", "b")], bytearray(b"r" * i) or None,
             None, None, None, None) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(20), TRANSACTION)
    src = str(tmp_path / "in")
    df.limit(10).write.parquet(src)
    rules = Ruleset.from_string(RULES)

    def run():
        stream = verdicts.score(verdicts.read_transactions(spark, src, df.schema, 1), rules).select("tx_id", "intervention.status")
        verdicts.write_verdicts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    run()
    df.exceptAll(df.limit(10)).drop("none").write.mode("append").parquet(src)
    run()  # goes on where it stopped
    want = Evaluator(rules).evaluate(df).select("tx_id", "intervention.status")
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == Counter(map(tuple, want.collect()))


def test_windows(spark):
    import datetime as dt

    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 3), "GET", "/admin" if i % 2 else "/") for i in range(9)] + [(9, None, "GET", "/")], "tx_id long, ts timestamp, method string, uri string")
    got = verdicts.blocked_per_window(Evaluator(Ruleset.from_string(RULES)).evaluate(df))
    assert sorted((r.window_start.hour, r.n_rows, r.n_blocked) for r in got.collect()) == [(0, 3, 1), (1, 3, 2), (2, 3, 1)]


def test_parts_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(12), TRANSACTION)
    parts = assemble.to_parts(df, 5).repartition(4)
    twice = parts.unionByName(parts.limit(7))
    cols = ["tx_id", "method", "uri", "protocol", "request_headers", "request_body", "response_headers", "response_body"]
    want = sorted(map(str, df.select(*cols).collect()))
    assert sorted(map(str, assemble.assemble(twice).select(*cols).collect())) == want
    assert assemble.assemble(parts.where("kind <> 'end' or tx_id > 3")).count() == 8
    assert assemble.assemble(parts.limit(0)).count() == 0
    src = str(tmp_path / "parts")
    import pyspark.sql.functions as F
    parts.withColumn("ts", F.timestamp_seconds(F.lit(1700000000))).write.parquet(src)
    stream = assemble.assemble(spark.readStream.schema(parts.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("assembled").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("assembled").select(*cols).collect())) == want


def parts_stream(spark, tmp_path, name, batches):
    """What the stream gives, by batch, of lists of parts; each list is a batch."""
    src, got = str(tmp_path / name), []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, assemble.PART).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(assemble.PART).parquet(src)
        q = assemble.assemble(stream).writeStream.foreachBatch(lambda df, _: got.append(df.collect())).option("checkpointLocation", src + "-cp").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return got


def at(*clock):
    import datetime as dt

    return None if clock == (None,) else dt.datetime(2024, 1, 1, *clock)


def whole(tx, *times):
    """A transaction of five parts with a time each."""
    parts = [("uri", "POST", "/x", b"HTTP/1.1"), ("request_header", "A", "1", None), ("request_body", None, None, b"ab"), ("request_body", None, None, b"cd"), ("end", None, None, None)]
    return [(tx, i, *p, t) for i, (p, t) in enumerate(zip(parts, times, strict=True))]


def test_stream_across_hours_and_without_time(spark, tmp_path):
    across = whole(1, at(9, 58), at(9, 59), at(10, 0), at(10, 1), at(10, 2))
    none, mixed = whole(2, *[at(None)] * 5), whole(3, at(None), at(9, 59), at(None), at(10, 1), at(None))
    every = across + none + mixed
    want = sorted(map(str, assemble.assemble(spark.createDataFrame(every, assemble.PART)).collect()))
    assert len(want) == 3
    flat = lambda got: sorted(str(r) for b in got for r in b)
    assert flat(parts_stream(spark, tmp_path, "one", [every + every[:4]])) == want
    halves = [[p for p in every if p[1] < 2], [p for p in every if p[1] >= 2 or p[0] == 2], every[-3:]]  # the last: sent again
    assert flat(parts_stream(spark, tmp_path, "two", halves)) == want


def test_stream_forgets(spark, tmp_path):
    timed, none, other = whole(1, *[at(9, 0)] * 4, at(12, 0)), whole(2, *[at(None)] * 5), lambda tx, t: whole(tx, *[t] * 5)
    soon = parts_stream(spark, tmp_path, "soon", [none[:4] + timed[:4] + other(3, at(9, 0)), other(4, at(9, 59)), none[4:] + whole(1, *[at(9, 59)] * 5)[4:]])
    assert [sorted((r.tx_id, bytes(r.request_body)) for r in b) for b in soon if b] == [[(3, b"abcd")], [(4, b"abcd")], [(1, b"abcd"), (2, b"abcd")]]
    late = parts_stream(spark, tmp_path, "late", [none[:4] + timed[:4] + other(3, at(9, 0)), other(4, at(12, 0)), none[4:] + timed[4:]])
    assert sorted((r.tx_id, r.uri) for b in late for r in b) == [(1, None), (2, None), (3, "/x"), (4, "/x")]


def test_stream_state_is_kept_by_bucket(spark, tmp_path):
    import pyspark.sql.functions as F

    src, n = str(tmp_path / "many"), 10_000
    odd = {1: at(None), 2: at(9, 0).replace(year=9999), 3: at(9, 0).replace(year=1980)}
    some = [(tx, i, k, None, "\x00;é" if i else None, bytes([0, 255, i or 7]), odd[tx]) for tx in odd for i, k in ((None, "uri"), (1, "request_body"), (1, "request_body"), (2, "response_body"), (3, "end"))]
    many = spark.range(10, n).select(F.col("id").alias("tx_id"), F.timestamp_seconds(F.lit(1704099600) + F.col("id") % 60).alias("ts"), F.posexplode(F.array(*map(F.lit, ("uri", "request_body", "end")))).alias("seq", "kind"))
    parts = many.select("tx_id", "seq", "kind", F.lit("GET").alias("name"), F.concat(F.lit("/"), "tx_id").alias("value"), F.col("kind").cast("binary").alias("data"), "ts").unionByName(spark.createDataFrame(some, assemble.PART))
    first = F.col("tx_id").isin(1, 3) | (F.col("tx_id") >= 10) & (F.col("seq") < 2)
    again = (F.col("tx_id") >= 10) & (F.col("tx_id") % 3 == 0)
    for batch, part in enumerate((parts.where(first | again), parts.where(~first))):  # of every third the end comes twice
        part.repartition(2).write.parquet(f"{src}/{batch}")
    stream = spark.readStream.schema(assemble.PART).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(src)
    q = assemble.write_assembled(assemble.assemble(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    assert 0 < max(got) < n / 2, got
    want = assemble.assemble(parts)
    assert want.count() == n - 7
    rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert rows(assemble.read_assembled(spark, str(tmp_path / "out"))) == rows(want)


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "r.conf")
    open(path, "w").write(RULES)

    def run(*argv):
        code = cli.main(list(argv))
        return code, capsys.readouterr().out.strip().splitlines()

    assert run("check", "-r", path) == (0, ["Successfully parsed 3 rules"])
    assert run("dump", "-r", path)[1][:5] == ["Total rules: 3", "", "Rules by phase:", "", "  Phase 1 (REQUEST_HEADERS):"]
    assert run("test", "-r", path, "-u", "/admin")[1] == ["BLOCKED (Phase 1)", "  Status: 403", "  Rules: ['1', '1']", "  Message: no"]
    assert run("test", "-r", path, "-u", "/", "-b", "q=1")[1] == ["BLOCKED (Phase 2)", "  Status: 403", "  Rules: ['2', '2']"]
    assert run("test", "-r", path, "-u", "/", "-H", "X: 1", "-H", "none")[1] == ["ALLOWED", "  Matched rules: ['3']", "  Anomaly score: 3"]
    assert run("check", "-r", path + "x")[0] == 1
