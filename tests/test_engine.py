import random

import pytest
from pyspark.sql import functions as F

from interpreter import Row
from sluice.functions import scoring
from sluice.functions.requests import PAIRS, TRANSACTION, count, count_key, resolved
from sluice.plans import engine
from sluice.plans.engine import Evaluator, expand_macros, format_log, intervention
from sluice.plans.transaction import Transaction
from sluice.seclang.parser import EMPTY, parse_variables
from sluice.seclang.ruleset import Ruleset, is_allow, is_terminal, outcome_status

ROW = "tx_id bigint, method string, uri string"


def verdicts(spark, rules, rows, **options):
    df = spark.createDataFrame([(i, m, u) for i, (m, u) in enumerate(rows)], ROW)
    return {r.tx_id: r for r in Evaluator(Ruleset.from_string(rules), **options).evaluate(df).collect()}


def one(spark, rules, uri="/", method="GET"):
    return verdicts(spark, rules, [(method, uri)])[0]


def test_basic(spark):
    deny = 'SecRule REQUEST_URI "@contains /admin" "id:1,phase:1,deny,msg:\'m\',tag:\'x\',status:500"'
    r = one(spark, deny, "/admin/dashboard")
    assert r.intervention.status == 403 and r.intervention.rule_ids == ["1", "1"] and r.intervention.log == "m" and r.intervention.phase == 1
    assert [m.id for m in r.intervention.metadata] == ["1"] and r.intervention.metadata[0].tags == ["x"] and not r.intervention.drop_connection
    assert one(spark, deny, "/public/index.html").intervention is None
    r = one(spark, 'SecRule REQUEST_URI "@contains /test" "id:1,phase:1,pass,setvar:TX.score=5"', "/test/page")
    assert r.intervention is None and r.tx["score"] == "5"
    r = one(spark, "SecRuleEngine DetectionOnly\n" + deny, "/admin/dashboard")
    assert r.intervention is None and r.matched_rules == ["1"]
    assert one(spark, "SecRuleEngine Off\n" + deny, "/admin").matched_rules == []


def test_default_status(spark):
    df = spark.createDataFrame([(1, "GET", "/")], ROW)
    rules = Ruleset.from_string('SecRule REQUEST_URI "@contains /" "id:1,phase:1,block"', default_status=429)
    assert Evaluator(rules).evaluate(df).first().intervention.status == 429


@pytest.mark.parametrize("rules, uri, hits", [
    # the head's deny does not wait for its chain
    ('SecRule REQUEST_URI "@contains a" "id:1,phase:1,deny,chain"\nSecRule REQUEST_URI "@contains z" "phase:1"', "/a", ["1"]),
    # links after a head that missed stand alone
    ('SecRule REQUEST_URI "@contains a" "id:1,phase:1,chain"\nSecRule REQUEST_URI "@contains b" "id:2,phase:1"', "/b", ["2"]),
    ('SecRule REQUEST_URI "@contains a" "id:1,phase:1,chain"\nSecRule REQUEST_URI "@contains b" "id:2,phase:1,chain"\nSecRule REQUEST_URI "@contains c" "id:3,phase:1"', "/ac", ["1"]),
    # a link without a phase is a phase-2 rule
    ('SecRule REQUEST_URI "@contains a" "id:1,phase:1,chain"\nSecRule REQUEST_URI "@contains b" "id:2"', "/b", ["2"]),
    ('SecAction "id:1,phase:1"', "/", []),
    ('SecRule FILES "!@contains x" "id:1,phase:1"', "/", ["1"]),
    ('SecRule FILES "@contains x" "id:1,phase:1"', "/", []),
    ('SecRule ARGS:a "!@streq 1" "id:1,phase:1"', "/?a=1&a=2", ["1"]),
    ('SecRule &ARGS:a "@eq 2" "id:1,phase:1"', "/?a=1&a=2", ["1"]),
    ('SecRule ARGS:A "@streq 1" "id:1,phase:1"', "/?a=1", []),
    ('SecRule TX:1|MATCHED_VAR "@contains a" "id:2,phase:1"', "/a", []),
    ('SecRule REQUEST_URI "@streq /%{TX.a}" "id:1,phase:1"', "/%{TX.a}", ["1"]),
    ('SecRule REQUEST_URI|!REQUEST "@contains a" "id:1,phase:1"', "/a", []),
    ('SecRule REQUEST_URI "@contains a" "id:1,phase:3,skipAfter:E"\nSecRule REQUEST_URI "@contains a" "id:2,phase:3"\nSecMarker E\nSecRule REQUEST_URI "@contains a" "id:3,phase:3"', "/a", ["1"]),
    ('SecRule REQUEST_URI "@contains a" "id:1,phase:1,skipAfter:E"\nSecMarker E\nSecRule REQUEST_URI "@contains a" "id:3,phase:1"', "/a", ["1"]),
    ('SecRule REQUEST_URI "@contains a" "id:1,phase:1,t:none,t:uppercase"\n', "/A", []),
])
def test_quirks(spark, rules, uri, hits):
    assert one(spark, rules, uri).matched_rules == hits


def test_scores_and_sync(spark):
    head = 'SecRule REQUEST_URI "@contains a" "id:1,phase:1,'
    assert one(spark, head + 'setvar:tx.anomaly_score=+5"', "/a").anomaly_score == 5
    r = one(spark, head + 'setvar:tx.sql_injection_score=+5"', "/a")
    assert r.tx["sql_injection_score"] == "0" and r.tx["anomaly_score"] == "0"
    r = one(spark, head + 'setvar:tx.sql_injection_score=7"\nSecRule REQUEST_URI "@contains a" "phase:1,setvar:tx.anomaly_score=+1"', "/a")
    assert (r.tx["sql_injection_score"], r.tx["anomaly_score"]) == ("7", "1")
    r = one(spark, head + 'deny,setvar:tx.anomaly_score=x"', "/a")
    assert r.tx == {"anomaly_score": "x"} and r.anomaly_score == 0  # a stop comes before the sync
    r = one(spark, head + 'setvar:tx.anomaly_score=9"\nSecRule REQUEST_URI "@contains a" "phase:1,setvar:!tx.anomaly_score"', "/a")
    assert r.tx["anomaly_score"] == "9"
    assert one(spark, head + 'setvar:tx.anomaly_score=3000000000"', "/a").anomaly_score == 0
    assert one(spark, 'SecRule REQUEST_URI "@contains a" "id:1,phase:2"', "/").tx["rce_score"] == "0"


def test_python_parts_on_tx(spark):
    rules = 'SecRule REQUEST_URI "@contains a" "id:1,phase:1,setvar:tx.x=%3cscript%3e"\nSecRule TX:x "@contains <script" "id:2,phase:1,t:urlDecodeUni"\nSecRule TX "@detectXSS" "id:3,phase:1"'
    assert one(spark, rules, "/a").matched_rules == ["1", "2", "3"]
    mixed = 'SecRule REQUEST_URI "@contains a" "id:1,phase:1,setvar:tx.x=%3CB"\nSecDefaultAction "phase:1,t:lowercase,t:urlDecodeUni,t:length"\nSecRule TX:x "@eq 2"\nSecRule TX:x "!@detectSQLi" "id:4,phase:1"'
    assert one(spark, mixed, "/a").matched_rules == ["1", "4"]


def test_phases_and_bodies(spark):
    rules = "".join(f'SecRule {v} "{op}" "id:{i},phase:{p},pass"\n' for i, (v, op, p) in enumerate([
        ("ARGS", "@streq x y", 1), ("ARGS_POST:k", "@streq x y", 2), ("REQUEST_BODY", "@rx �", 2), ("REQUEST_BODY_LENGTH", "@eq 11", 2), ("REQUEST_BODY_LENGTH", "@eq 0", 1),
        ("RESPONSE_HEADERS:content-type", "@streq b", 3), ("RESPONSE_CONTENT_TYPE", "@streq b", 3), ("RESPONSE_CONTENT_TYPE", "@streq b", 2), ("RESPONSE_BODY", "@contains hi", 4),
        ("RESPONSE_BODY", "@contains hi", 3), ("RESPONSE_STATUS", "@eq 0", 5), ("REQUEST_HEADERS:x-a", "@streq 1", 1), ("REQUEST_HEADERS:X-A", "@streq 1", 1), ("REMOTE_ADDR", "@streq ", 1)]))
    row = (1, None, "POST", "/p?a=b", "HTTP/1.1", [("X-A", "1")], bytearray(b"k=x%20y&z&\xff"), True, 200, [("Content-Type", "a"), ("content-type", "b")], bytearray(b"hi"), "1.2.3.4", 1, "s", 2)
    plan = Evaluator(Ruleset.from_string(rules))
    assert plan.evaluate(spark.createDataFrame([row], TRANSACTION)).first().matched_rules == ["4", "11", "13", "1", "2", "3", "5", "6", "8", "10"]
    without = [*row[:7], False, *row[8:]]
    assert plan.evaluate(spark.createDataFrame([tuple(without)], TRANSACTION)).first().matched_rules == ["4", "11", "13", "5", "6", "8", "10"]
    seen = Evaluator(Ruleset.from_string('SecRule REMOTE_ADDR "@ipMatch 1.2.3.0/24" "id:1,phase:1"\nSecRule RESPONSE_STATUS "@eq 200" "id:2,phase:3"'), observed=True)
    assert seen.evaluate(spark.createDataFrame([row], TRANSACTION)).first().matched_rules == ["1", "2"]


def test_nulls_empty_tables_and_clashing_names(spark):
    rules = Ruleset.from_string("".join(f'SecRule {v} "@rx x" "id:1,phase:{p}"\n' for v in ("ARGS", "REQUEST_BODY", "REQUEST_HEADERS", "RESPONSE_HEADERS", "RESPONSE_BODY", "REQUEST_URI") for p in range(1, 6)))
    none = spark.createDataFrame([tuple([None] * 15)] * 2, TRANSACTION)
    got = Evaluator(rules).evaluate(none.withColumn("tx", F.lit(1)).withColumn("allowed", F.lit("x")).withColumn("a b", F.lit(2))).collect()
    assert len(got) == 2 and all(r.matched_rules == [] and r.intervention is None and r.allowed is False and r["a b"] == 2 for r in got)
    assert Evaluator(rules).evaluate(none.limit(0)).count() == 0
    assert Evaluator(Ruleset()).evaluate(none).first().tx == {}
    assert all(none.select(resolved(none, parse_variables(n)[0])).first()[0] == [] for n in EMPTY)


def test_no_shuffle_and_pruned_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([tuple([None] * 15)], TRANSACTION).write.parquet(path)
    out = Evaluator(Ruleset.from_string('SecRule REQUEST_URI "@contains /a" "id:1,phase:1,deny"')).evaluate(spark.read.parquet(path)).select("tx_id", "matched_rules")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "request_body" not in plan


def random_rules(rng):
    def variables():
        return "|".join(rng.sample(["REQUEST_METHOD", "REQUEST_URI", "ARGS:a", "ARGS", "TX:s", "TX:anomaly_score", "TX", "FILES", "!ARGS:b"], rng.randint(1, 3)))

    def operator():
        return rng.choice(["!", "", "", ""]) + rng.choice(["@contains a", "@streq GET", "@eq 2", "@ge 3", "@lt 0", "@unconditionalMatch", "@noMatch", "@within 1 2 GET", "@contains b"])

    def actions(i):
        out = [f"id:{i}"] * rng.choice([0, 1, 1, 1]) + [f"phase:{rng.choice([1, 1, 1, 3, 9])}"]
        out += rng.choice([[], [], ["chain"], [f"skip:{rng.randint(0, 2)}"], ["skipAfter:" + rng.choice("MN")], ["multiMatch"]])
        out += rng.choice([[], [], [], ["pass"], ["deny"], ["allow"], ["drop"], ["block"]])
        out += rng.choice([[], [], ["setvar:tx.s=+2"], ["setvar:tx.s=-1"], ["setvar:tx.s=2"], ["setvar:!tx.s"], ["setvar:tx.anomaly_score=+3"], ["setvar:tx.xss_score=+1"], ["setvar:tx.s=GET"]])
        return ",".join(out + rng.choice([[], ["t:lowercase"]]))

    lines = []
    for i in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.1:
            lines.append("SecMarker " + rng.choice("MN"))
        elif kind < 0.15:
            lines.append(f'SecAction "{actions(i)}"')
        elif kind < 0.2:
            lines.append(f'SecDefaultAction "{rng.choice(["phase:1,pass", "phase:3,setvar:tx.s=+1,setvar:tx.t=1,deny", "chain"])}"')
        else:
            lines.append(f'SecRule {variables()} "{operator()}"' + (f' "{actions(i)}"' if rng.random() < 0.9 else ""))
    return "\n".join([*lines, rng.choice(["", "", "", "SecRuleEngine DetectionOnly"])])


@pytest.mark.parametrize("seed", range(24))
def test_plans_agree_with_a_row_reader(spark, seed, monkeypatch):
    if seed % 2:  # guards even where one rule reads a text
        monkeypatch.setattr(engine, "GUARDED", 1)
        monkeypatch.setattr(engine, "PART", 2)
    rng = random.Random(seed)
    text = random_rules(rng)
    ruleset = Ruleset.from_string(text)
    rows = [(m, u) for m in ("GET", "POST") for u in ("/", "/a?a=1&b=2", "/b?b=GET&a=3", "/?a=2")]
    got = verdicts(spark, text, rows)
    for i, (m, u) in enumerate(rows):
        want = Row(ruleset)
        for p in range(1, 6):
            want.phase(p, {"method": m, "uri": u})
        r = got[i]
        stop = want.stop and want.stop[0]
        assert (r.matched_rules, r.intervention and r.intervention.phase, r.allowed, r.anomaly_score, r.tx) == (want.hits, stop, want.allowed, want.scores[0], want.tx), (text, m, u)


def test_pushed_transaction(spark):
    tx = Transaction(spark, Ruleset.from_string('SecRule REQUEST_HEADERS:x "@streq 1" "id:1,phase:1,setvar:tx.anomaly_score=+2"\nSecRule ARGS_POST:q "@rx ." "id:2,phase:2,deny"'))
    assert not tx.has_intervention and tx.matched_rules == []
    tx.process_uri("/a")
    tx.add_request_header("X", "1")
    tx.process_request_headers()
    assert tx.matched_rules == ["1"] and tx.anomaly_score == 2 and not tx.has_intervention
    tx.append_request_body(b"q=")
    tx.append_request_body(b"1")
    tx.process_request_body()
    assert tx.has_intervention and tx.intervention.phase == 2 and tx.tx["anomaly_score"] == "2" and not tx.allowed


def test_helpers(spark):
    rule = lambda action: Ruleset.from_string(f'SecRule ARGS "x" "phase:1,{action}"').phases[1][0]
    assert [(outcome_status(rule(a), 429), is_terminal(rule(a)), is_allow(rule(a))) for a in ("deny", "block", "redirect:u", "drop", "allow", "pass", "log")] == [
        (403, True, False), (429, True, False), (302, True, False), (444, True, False), (200, False, True), (200, False, False), (200, False, False)]
    built = spark.range(1).select(format_log(intervention(url="u", log="m", rule_ids=("7",), phase=2)), intervention(drop_connection=True)["status"]).first()
    assert tuple(built) == ("[status 302] [rule_ids: 7] [msg: m] [redirect: u] [phase: REQUEST_BODY]", 444)
    pairs = spark.createDataFrame([([("a", "1"), ("a", "2"), ("b", "3")],)], f"c {PAIRS}")
    assert tuple(pairs.select(count(F.col("c")), count_key(F.col("c"), "a")).first()) == (3, 2)
    df = spark.createDataFrame([({"anomaly_score": "25"},)], "tx map<string,string>")
    text = expand_macros(F.lit("Score is %{TX.anomaly_score}, matched %{MATCHED_VAR}%{TX.none}"), F.col("tx"), F.lit("<script>"))
    assert df.select(text).first()[0] == "Score is 25, matched <script>"
    assert [r[0] for r in spark.range(-1, 8).select(scoring.severity_score(F.col("id"))).collect()] == [0, 5, 5, 5, 4, 3, 2, 0, 0]
    assert [tuple(r) for r in spark.range(0, 5).select(scoring.threshold(F.col("id")), scoring.threshold(F.col("id"), True)).collect()] == [(20, 16), (5, 4), (10, 8), (15, 12), (20, 16)]
    assert spark.range(1).select(scoring.exceeded(F.lit(5), F.lit(1))).first()[0] is True
    i = F.struct(F.lit(302).alias("status"), F.array(F.lit("1"), F.lit("1")).alias("rule_ids"), F.lit("m").alias("log"), F.lit("u").alias("url"), F.lit(1).alias("phase"))
    assert spark.range(1).select(format_log(i)).first()[0] == "[status 302] [rule_ids: 1, 1] [msg: m] [redirect: u] [phase: REQUEST_HEADERS]"


def test_guards_change_nothing(spark, monkeypatch):
    """Many rules of all operators that need texts, over decoded and plain texts, with and without guards."""
    rng = random.Random(8)
    words = ["union", "select", "ſhop", "K9", "ba+r", "a'b", "x\\\\y", "%3Cb", "Straße", "kelp"]
    ops = ["@rx (?i){0}.*{1}", "@rx (?:{0}|{1})[0-9]", "@contains {0}", "@pm {0} {1}", "@beginsWith /{0}", "@endsWith {1}", "@streq {0}", "@within {0} {1}", "!@contains {0}", "@rx {0}?", "@rx (?i:{0})"]
    lines = []
    for i in range(120):
        op = rng.choice(ops).format(rng.choice(words).replace("+", "[+]" if "rx" in ops[0] else "+"), rng.choice(words).replace("+", "[+]"))
        lines.append(f'SecRule {rng.choice(["ARGS|REQUEST_URI", "ARGS", "REQUEST_URI", "REQUEST_HEADERS|ARGS:q"])} "{op}" "id:{i},phase:1,{rng.choice(["t:urlDecodeUni", "t:lowercase", "t:none"])},setvar:tx.s=+1{rng.choice(["", "", ",chain"])}"')
    ruleset = Ruleset.from_string("\n".join(lines) + '\nSecRule TX:s "@ge 4" "id:999,phase:1,deny"\n')
    rows = [(m, "/" + rng.choice(["", "union", "kelp"]) + "?q=" + "".join(rng.choice([*words, "SELECT", "shop1", "K9", "1", " ", "%3cb", "&q="]) for _ in range(rng.randint(0, 5)))) for m in ("GET", "POST") for _ in range(60)]
    df = spark.createDataFrame([(i, m, u) for i, (m, u) in enumerate(rows)], "tx_id long, method string, uri string")
    results = []
    for least in (1, 8, 10_000):
        monkeypatch.setattr(engine, "GUARDED", least)
        out = engine.Evaluator(ruleset).evaluate(df).select("tx_id", "matched_rules", "intervention.status", "anomaly_score", "tx").collect()
        results.append(sorted(map(str, out)))
    assert results[0] == results[1] == results[2] and len(set(x.split("matched")[1] for x in results[0])) > 20


def test_state_is_carried_from_call_to_call(spark):
    rules = Ruleset.from_string('SecRule REQUEST_METHOD "x" "id:1,phase:1,setvar:tx.a=+2"\nSecRule TX:a "@ge 2" "id:2,phase:3,setvar:tx.a=+1"\nSecRule TX:a "@ge 3" "id:3,phase:5,deny"\n')
    df = spark.createDataFrame([(1, "x", [1]), (2, "y", [1]), (3, "x", [])], "tx_id long, method string, called array<int>").withColumn("state", F.lit(None).cast(engine.STATE_TYPE))
    keep = ["tx_id", "method", "state"]
    for phase in (3, 5):
        df = engine.Evaluator(rules).evaluate(df, carried="state", called="called").select(*keep).withColumn("called", F.array(F.lit(phase)))
    got = {r.tx_id: (r.matched_rules, r.intervention is not None) for r in engine.Evaluator(rules).evaluate(df, carried="state", called="called").collect()}
    assert got == {1: (["1", "2", "3"], True), 2: ([], False), 3: ([], False)}
