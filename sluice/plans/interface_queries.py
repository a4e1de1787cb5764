"""Queries of what surrounds rules: actions and directives without effect, helpers, registries, rules built by hand, the push interface, the command line, phases on a stream.

The helpers of rules, which no table feeds, give a small table of their own answers.
"""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import transformations
from ..functions.requests import Request, count, count_key
from ..operators import predicates
from ..operators.predicates import Predicate
from ..seclang.ast import Operator
from ..seclang.parser import parse_variables
from ..seclang.ruleset import Metadata, Rule, Ruleset, chain_matches, is_allow, is_terminal, outcome_status
from ..sources import table
from ..streaming import phases, verdicts
from .engine import Evaluator, format_log, intervention
from .rule_queries import _A, _B, TX, VALUES_SQL, _case, _form_sql, _place, _tx, _usual, _values
from .transaction import Transaction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _verdicts(out: DataFrame) -> DataFrame:
    return out.select("tx_id", F.array_join("matched_rules", ",").alias("rules"), F.coalesce("intervention.status", F.lit(0)).alias("status"), "allowed", "anomaly_score")


def _rules(name: str, text: str, sql: str) -> None:
    _add(name, lambda s, d: _verdicts(Evaluator(Ruleset.from_string(text)).evaluate(_tx(s, d))), sql)


# Actions and directives that are read and change nothing

_deny = _usual(_case((_A, "'1'"), ("method = 'POST'", "'2'"), "''"), _case((_A, "403"), ("method = 'POST'", "403"), "0"))
for _name, _actions in {
    "multiMatch": "multiMatch", "capture": "capture", "logging": "log,auditlog,nolog,noauditlog,sanitiseMatched", "ctl": "ctl:ruleEngine=Off,ctl:requestBodyProcessor=JSON",
    "collections": "initcol:ip=%{REMOTE_ADDR},expirevar:ip.x=60", "placeholders": "setsid:x,setuid:x,deprecatevar:x,exec:x,append:x,prepend:x,proxy:x,pause:5,xmlns:x", "status": "status:500",
}.items():
    _rules("eng_action_" + _name, f'SecRule REQUEST_URI "@contains /admin" "id:1,phase:1,deny,{_actions}"\nSecRule REQUEST_METHOD "@streq POST" "id:2,phase:1,{_actions},deny"\n', _deny)
for _name, _line in {"remove_by_id": 'SecRuleRemoveById "1 2"', "body_access": "SecRequestBodyAccess Off\nSecResponseBodyAccess On", "unknown": "SecUploadDir /x y\nSecArgumentSeparator &"}.items():
    _rules("eng_directive_" + _name, f'SecRule REQUEST_URI "@contains /admin" "id:1,phase:1,deny"\n{_line}\nSecRule REQUEST_METHOD "@streq POST" "id:2,phase:1,deny"\n', _deny)
_add("eng_metadata", lambda s, d: Evaluator(Ruleset.from_string(
    'SecRule REQUEST_URI "@contains /admin" "id:1,phase:1,deny,msg:\'m\',rev:2,ver:\'v/1\',maturity:7,accuracy:8,severity:ERROR,tag:\'a\',tag:b,logdata:\'d\'"\n')).evaluate(_tx(s, d)).select("tx_id", F.explode("intervention.metadata").alias("m")).select(
    "tx_id", "m.id", "m.msg", "m.rev", "m.ver", "m.maturity", "m.accuracy", "m.severity", F.array_join("m.tags", "|").alias("tags"), "m.logdata"),
    f"SELECT tx_id, '1' AS id, 'm' AS msg, '2' AS rev, 'v/1' AS ver, 7 AS maturity, 8 AS accuracy, 3 AS severity, 'b' AS tags, 'd' AS logdata FROM {TX} WHERE {_A}")


# Helpers

_KINDS = ("deny", "block", "redirect:u", "drop", "allow", "pass", "log")


def eng_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each disruptive action answers with, at a default status of 429."""
    rule = lambda action: Ruleset.from_string(f'SecRule ARGS "x" "phase:1,{action}"').phases[1][0]
    return spark.createDataFrame([(a, outcome_status(rule(a), 429), is_terminal(rule(a)), is_allow(rule(a))) for a in _KINDS], "action string, status int, terminal boolean, allow boolean")


_add("eng_outcomes", eng_outcomes, "SELECT * FROM (VALUES ('deny', 403, true, false), ('block', 429, true, false), ('redirect:u', 302, true, false), ('drop', 444, true, false), "
     "('allow', 200, false, true), ('pass', 200, false, false), ('log', 200, false, false)) AS r(action, status, terminal, allow)")


def eng_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values of all arguments, of one name, and of the header collection."""
    df = _tx(spark, d)
    args, heads = (Request(df, 1).collection(n) for n in ("ARGS", "REQUEST_HEADERS"))
    return df.select("tx_id", count(args).alias("n_args"), count_key(args, "q").alias("n_q"), count(heads).alias("n_headers"), count_key(heads, "host").alias("n_host"))


_add("eng_counts", eng_counts, f"SELECT tx_id, len(args_get)::INTEGER AS n_args, len(list_filter(args_get, lambda a: a.name = 'q'))::INTEGER AS n_q, len(request_headers)::INTEGER AS n_headers, "
     f"len(list_filter(request_headers, lambda h: lower(h.name) = 'host'))::INTEGER AS n_host FROM {TX}")


def eng_collections(spark: SparkSession, d: str) -> DataFrame:
    """Every collection as a column of pairs, seen from the last phase."""
    df = _tx(spark, d)
    names = ("ARGS", "ARGS_GET", "ARGS_POST", "REQUEST_HEADERS", "RESPONSE_HEADERS", "REQUEST_COOKIES")
    return df.select("tx_id", *[count(Request(df, 5).collection(n)).alias(n.lower()) for n in names])


_add("eng_collections", eng_collections, f"""
    WITH t AS (SELECT *, row_number() OVER () AS n FROM {TX}), p AS (SELECT n, count(*) AS c FROM ({_form_sql.replace('SELECT tx_id,', 'SELECT n,').replace(f'FROM {TX})', 'FROM t)')}) GROUP BY n)
    SELECT tx_id, (len(args_get) + coalesce(c, 0))::INTEGER AS args, len(args_get)::INTEGER AS args_get, coalesce(c, 0)::INTEGER AS args_post, len(request_headers)::INTEGER AS request_headers,
           coalesce(len(response_headers), 0)::INTEGER AS response_headers, 0 AS request_cookies FROM t LEFT JOIN p USING (n)""")


def eng_rule_count(spark: SparkSession, d: str) -> DataFrame:
    """Rules of the table in all phases, and in each."""
    rules = Ruleset.from_frame(table(spark, d, "rules"), skip_unusable=True)
    return spark.createDataFrame([("all", rules.rule_count), *[(str(p), len(own)) for p, own in rules.phases.items()]], "phase string, n bigint")


_usable = "rules WHERE NOT (argument = '' AND op_name IN ('@rx', '@pm'))"
_add("eng_rule_count", eng_rule_count, f"SELECT 'all' AS phase, count(*) AS n FROM {_usable} UNION ALL SELECT CAST(p AS VARCHAR), (SELECT count(*) FROM {_usable} AND phase = p) FROM range(1, 6) AS r(p)")


def eng_chain_helper(spark: SparkSession, d: str) -> DataFrame:
    """Whether a chain of two rules holds, for each pair of answers of its rules."""
    rules = Ruleset.from_string('SecRule ARGS "a" "id:1,phase:1,chain"\nSecRule ARGS "b" "id:2,phase:1"\n').phases[1]
    name = {True: "yes", False: "no", None: "unknown"}
    rows = [(name[a], name[b], name[chain_matches(rules, 0, lambda r: {"1": a, "2": b}[r.id])]) for a in name for b in name]
    return spark.createDataFrame(rows, "head string, link string, chain string")


_add("eng_chain_helper", eng_chain_helper, "SELECT h.a AS head, l.a AS link, CASE h.a WHEN 'yes' THEN l.a ELSE h.a END AS chain FROM (VALUES ('yes'), ('no'), ('unknown')) h(a), (VALUES ('yes'), ('no'), ('unknown')) l(a)")


# Registries and parts built by hand

def op_registered(spark: SparkSession, d: str) -> DataFrame:
    """An operator of one's own, named by a rule."""
    predicates.register("endsWithDigit", lambda a: Predicate(lambda v: v.rlike("[0-9]\\z")))
    return _verdicts(Evaluator(Ruleset.from_string('SecRule REQUEST_URI "!@endsWithDigit" "id:1,phase:1,deny"\n')).evaluate(_tx(spark, d)))


_digit = "regexp_matches(coalesce(uri, ''), '[0-9]$')"
_add("op_registered", op_registered, _usual(_case((_digit, "''"), "'1'"), _case((_digit, "0"), "403")))


def t_registered(spark: SparkSession, d: str) -> DataFrame:
    """Transformations of one's own, an expression and a function, in one pipeline with others."""
    transformations.register("reversed", native=F.reverse)
    transformations.register("doubled", python=_doubled)
    return _values(spark, d).select("tx_id", transformations.apply_transformations(F.col("v"), transformations.pipeline(["lowercase", "reversed", "doubled"])).alias("out"))


def _doubled(text: str) -> str:
    return text + text


_add("t_registered", t_registered, f"WITH {VALUES_SQL} SELECT tx_id, array_to_string(list_reverse(regexp_extract_all(lower(v), '(?s).')), '') || array_to_string(list_reverse(regexp_extract_all(lower(v), '(?s).')), '') AS out FROM vals")


def eng_manual(spark: SparkSession, d: str) -> DataFrame:
    """A rule set put together without rule text, with a marker."""
    rules = Ruleset()
    rules.add(Rule(1, parse_variables("REQUEST_URI"), Operator("contains", "/admin"), metadata=Metadata(id="1"), flow="skipafter", flow_value="END"))
    rules.add(Rule(1, parse_variables("REQUEST_METHOD"), Operator("streq", "post"), ("lowercase",), Metadata(id="2")))
    rules.add_marker("END")
    rules.add(Rule(1, parse_variables("REQUEST_URI"), Operator("beginswith", "/api"), metadata=Metadata(id="3"), disruptive="drop"))
    return _verdicts(Evaluator(rules).evaluate(_tx(spark, d)))


_add("eng_manual", eng_manual, _usual(f"concat_ws(',', CASE WHEN {_A} THEN '1' END, CASE WHEN method = 'POST' AND NOT coalesce({_A}, false) THEN '2' END, CASE WHEN {_B} THEN '3' END)", _case((_B, "444"), "0")))


def eng_builder(spark: SparkSession, d: str) -> DataFrame:
    """Interventions built from parts, one for each row by its method."""
    df = _tx(spark, d)
    built = F.when(df["method"] == "POST", intervention(url="/sorry", log="post", rule_ids=("7", "8"), phase=2)).when(df["method"] == "GET", intervention(429)).otherwise(intervention(drop_connection=True, phase=5))
    return df.select("tx_id", built["status"].alias("status"), built["url"].alias("url"), built["drop_connection"].alias("drop_connection"), format_log(built).alias("log"))


_add("eng_builder", eng_builder, f"SELECT tx_id, CASE method WHEN 'POST' THEN 302 WHEN 'GET' THEN 429 ELSE 444 END AS status, CASE method WHEN 'POST' THEN '/sorry' END AS url, method IS NULL OR method NOT IN ('POST', 'GET') AS drop_connection, "
     f"CASE method WHEN 'POST' THEN '[status 302] [rule_ids: 7, 8] [msg: post] [redirect: /sorry] [phase: REQUEST_BODY]' WHEN 'GET' THEN '[status 429] [phase: REQUEST_HEADERS]' ELSE '[status 444] [phase: LOGGING]' END AS log FROM {TX}")


# One transaction pushed in, and the command line

PUSHED = ('SecRule REQUEST_HEADERS:user-agent "@contains scan" "id:1,phase:1,setvar:tx.anomaly_score=+3"\nSecRule REQUEST_BODY "@contains union" "id:2,phase:2,setvar:tx.anomaly_score=+4"\n'
          'SecRule RESPONSE_BODY "@contains trace" "id:4,phase:4,pass"\nSecRule TX:anomaly_score "@ge 7" "id:5,phase:4,deny"\nSecRule REQUEST_URI "@beginsWith /" "id:6,phase:5,pass"\n')


def eng_push(spark: SparkSession, d: str) -> DataFrame:
    """A request and its response pushed in piece by piece, and what is known after each phase."""
    tx, out = Transaction(spark, Ruleset.from_string(PUSHED)), []
    tx.process_uri("/x?a=1", "POST")
    tx.add_request_header("User-Agent", "scanner")
    for phase, bring in ((1, None), (2, lambda: [tx.append_request_body(b) for b in (b"q=un", b"ion")]), (3, lambda: tx.add_response_header("X", "y")), (4, lambda: [tx.append_response_body(b) for b in (b"tr", b"ace")]), (5, None)):
        if bring:
            bring()
        tx.process(phase)
        out.append((phase, ",".join(tx.matched_rules), tx.intervention.status if tx.has_intervention else 0, tx.anomaly_score, tx.allowed))
    return spark.createDataFrame(out, "phase int, rules string, status int, anomaly_score int, allowed boolean")


_add("eng_push", eng_push, "SELECT * FROM (VALUES (1, '1', 0, 3, false), (2, '1,2', 0, 7, false), (3, '1,2', 0, 7, false), (4, '1,2,4,5', 403, 7, false), (5, '1,2,4,5', 403, 7, false)) AS r(phase, rules, status, anomaly_score, allowed)")


def eng_cli(spark: SparkSession, d: str) -> DataFrame:
    """What the command line prints for a rule file and a request."""
    fd, path = tempfile.mkstemp(suffix=".conf")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(PUSHED + 'SecRule ARGS:q "@streq bad" "id:7,phase:1,deny,msg:\'no\'"\n')
    rows = []
    for name, args in {"check": ["check", "-r", path], "dump": ["dump", "-r", path], "blocked": ["test", "-r", path, "-u", "/?q=bad"], "allowed": ["test", "-r", path, "-u", "/", "-m", "POST", "-H", "User-Agent: scan", "-b", "union"]}.items():
        with contextlib.redirect_stdout(io.StringIO()) as out:
            code = cli.main(args)
        rows += [(name, i, line, code) for i, line in enumerate(out.getvalue().splitlines())]
    os.unlink(path)
    return spark.createDataFrame(rows, "command string, line int, text string, code int")


_add("eng_cli", eng_cli, """SELECT *, 0 AS code FROM (VALUES ('check', 0, 'Successfully parsed 6 rules'), ('dump', 0, 'Total rules: 6'), ('dump', 1, ''), ('dump', 2, 'Rules by phase:'), ('dump', 3, ''), ('dump', 4, '  Phase 1 (REQUEST_HEADERS):'),
    ('dump', 5, '    - Rule 1'), ('dump', 6, '    - Rule 7'), ('dump', 7, ''), ('dump', 8, '  Phase 2 (REQUEST_BODY):'), ('dump', 9, '    - Rule 2'), ('dump', 10, ''), ('dump', 11, '  Phase 4 (RESPONSE_BODY):'),
    ('dump', 12, '    - Rule 4'), ('dump', 13, '    - Rule 5'), ('dump', 14, ''), ('dump', 15, '  Phase 5 (LOGGING):'), ('dump', 16, '    - Rule 6'),
    ('blocked', 0, 'BLOCKED (Phase 1)'), ('blocked', 1, '  Status: 403'), ('blocked', 2, '  Rules: [''7'', ''7'']'), ('blocked', 3, '  Message: no'),
    ('allowed', 0, 'ALLOWED'), ('allowed', 1, '  Matched rules: [''1'', ''2'']'), ('allowed', 2, '  Anomaly score: 7')) AS r(command, line, text)""")


# Phases on a stream

CARRYING = ('SecRule REQUEST_URI "@contains /admin" "id:1,phase:1,setvar:tx.anomaly_score=+4"\nSecRule REQUEST_METHOD "@streq POST" "id:2,phase:2,setvar:tx.anomaly_score=+3"\n'
            'SecRule RESPONSE_HEADERS:x-node "@beginsWith n1" "id:3,phase:3,setvar:tx.anomaly_score=+2"\nSecRule TX:anomaly_score "@ge 5" "id:9,phase:5,deny"\n')


def stream_phases(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each phase as files of a stream, evaluated with what the phases before have set; one verdict for each tx_id."""
    src, at, n = _place(spark, "calls"), _place(spark, "phases"), 1
    for phase in range(1, 6):
        phases.calls(_tx(spark, d), phase).write.mode("append").parquet(src)
        n = max(n, len(spark.read.parquet(src).inputFiles())) if phase == 1 else n
    stream = verdicts.read_transactions(spark, src, phases.CALL, files_per_batch=n)
    phases.write_phases(stream, Ruleset.from_string(CARRYING), at, at + "-checkpoint").awaitTermination()
    return phases.read_phases(spark, at).select("tx_id", F.size("ran").alias("n_phases"), F.array_join("matched_rules", ",").alias("rules"), F.coalesce("intervention.status", F.lit(0)).alias("status"), "anomaly_score")


_add("stream_phases", stream_phases, f"""
    WITH t AS (SELECT tx_id, any_value(uri) AS uri, any_value(method) AS method, coalesce(bool_or(has_request_body_phase), false) AS b, any_value(response_headers) AS hs FROM {TX} WHERE tx_id IS NOT NULL GROUP BY tx_id),
         u AS (SELECT *, coalesce({_A}, false) AS x1, b AND coalesce(method = 'POST', false) AS x2, len(list_filter(hs, lambda h: lower(h.name) = 'x-node' AND starts_with(h.value, 'n1'))) > 0 AS x3 FROM t),
         s AS (SELECT *, CASE WHEN x1 THEN 4 ELSE 0 END + CASE WHEN x2 THEN 3 ELSE 0 END + CASE WHEN x3 THEN 2 ELSE 0 END AS n FROM u)
    SELECT tx_id, CASE WHEN b THEN 5 ELSE 4 END AS n_phases, concat_ws(',', CASE WHEN x1 THEN '1' END, CASE WHEN x2 THEN '2' END, CASE WHEN x3 THEN '3' END, CASE WHEN n >= 5 THEN '9' END) AS rules,
           CASE WHEN n >= 5 THEN 403 ELSE 0 END AS status, n AS anomaly_score FROM s""")


# Many rules as real sets have them

_WORDS = ("union select script alert passwd admin login search harbor granite lagoon nickel fjord kelp basalt ember onyx pine juniper indigo cobalt meadow amber dune static media report basket "
          "profile export import delete update insert benchmark shadow windows cookie document window").split()


def _pattern(i: int) -> str:
    a, b = _WORDS[i % len(_WORDS)], _WORDS[(7 * i + 3) % len(_WORDS)]
    return "(?i)" + [rf"{a}[^&]{{0,40}}{b}", rf"(?:{a}|{b})[=:/]+[a-z0-9]+[-_]", rf"^/?{a}[-_.][0-9]+", rf"{a}[ ]*[(<][ ]*[a-z]", rf"[<;|`][ ]*{a}(?:[ ]+{b})?"][i // len(_WORDS)]


PATTERNS = [_pattern(i) for i in range(200)]
MANY_PATTERNS = "".join(f'SecRule ARGS|REQUEST_HEADERS|REQUEST_URI "@rx {p}" "id:{1000 + i},phase:1,pass,t:urlDecodeUni,setvar:tx.anomaly_score=+1"\n' for i, p in enumerate(PATTERNS)) + (
    'SecRule TX:anomaly_score "@ge 3" "id:9999,phase:1,deny"\n')


def eng_many_patterns(spark: SparkSession, d: str) -> DataFrame:
    """200 patterns over arguments, headers and URI, decoded, each of which counts. A file of one row group is spread over all cores first."""
    df = _tx(spark, d).select("tx_id", "uri", "request_headers")
    cores = spark.sparkContext.defaultParallelism
    return _verdicts(Evaluator(Ruleset.from_string(MANY_PATTERNS)).evaluate(df.repartition(cores) if df.rdd.getNumPartitions() < cores else df))


def _many_sql() -> str:
    from .decoder_sql import url_decode_uni

    hits = ", ".join("CASE WHEN len(list_filter(vs, lambda v: regexp_matches(v, '{}'))) > 0 THEN '{}' END".format(p, 1000 + i) for i, p in enumerate(PATTERNS))
    return f"""WITH t AS (SELECT tx_id, list_transform(list_transform(args_get, lambda a: a.value) || list_transform(request_headers, lambda h: coalesce(h.value, '')) || [coalesce(uri, '')], lambda x: {url_decode_uni('x')}) AS vs FROM {TX}),
             h AS (SELECT tx_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS hs FROM t)
        SELECT tx_id, array_to_string(CASE WHEN len(hs) >= 3 THEN hs || ['9999'] ELSE hs END, ',') AS rules, CASE WHEN len(hs) >= 3 THEN 403 ELSE 0 END AS status, false AS allowed, len(hs)::INTEGER AS anomaly_score FROM h"""


_add("eng_many_patterns", eng_many_patterns, _many_sql())
