"""Queries of the rule language's parts over http_transactions, with SQL that says the same in its own way.

Names: t_ transformations, op_ operators, var_ variables, eng_ evaluation, src_ sources and sinks, stream_ streams.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.requests import Request, path, resolved
from ..functions.transformations import apply_transformations
from ..operators import detectors, predicates
from ..operators.predicates import rx_groups
from ..seclang.parser import COLLECTIONS, EMPTY, SCALARS, parse_operator, parse_variables
from ..seclang.ruleset import Ruleset
from ..sources import shared_dir, table
from ..streaming import assemble, verdicts
from . import decoder_sql as said
from . import detector_sql as found
from .decoder_sql import SPACE
from .engine import Evaluator, expand_macros, format_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TX = "http_transactions"
#: Argument values, the texts most queries read.
VALUES_SQL = f"vals AS (SELECT tx_id, unnest(args_get).value AS v FROM {TX})"


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TX)


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _tx(spark, d).select("tx_id", F.explode("args_get").alias("a")).select("tx_id", F.col("a.value").alias("v"))


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Transformations

def _transformation(names: str, sql: str | None, source: str = "vals", given: Callable[[Column], Column] | None = None, label: str | None = None) -> None:
    """``given`` changes the input before; ``sql`` is the result in terms of v."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _values(spark, d) if source == "vals" else _tx(spark, d).select("tx_id", F.col(source).alias("v"))
        v = given(F.col("v")) if given else F.col("v")
        return rows.select("tx_id", apply_transformations(v, tuple(names.split())).alias("out"))

    read = f"WITH {VALUES_SQL} SELECT tx_id, {{}} AS out FROM vals" if source == "vals" else f"SELECT tx_id, {{}} AS out FROM (SELECT tx_id, {source} AS v FROM {TX})"
    _add("t_" + (label or names.split()[-1]), run, read.format(sql) if sql else None)


_no_comments = r"regexp_replace({}, '(?s)/\*.*?(?:\*/|$)', '', 'g')"
_path_sql = (
    r"list_reduce(string_split(regexp_replace(replace({0}, '\', '/'), '/+', '/', 'g'), '/'), lambda acc, x: CASE WHEN x = '.' OR (x = '' AND acc <> '') THEN acc "
    r"WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END, '')[2:]")
_touched = r"(contains({0}, '\') OR contains(replace({0}, '\', '/'), '//') OR list_has_any(string_split(replace({0}, '\', '/'), '/'), ['.', '..']))"
_normal_sql = f"CASE WHEN {_touched} THEN {_path_sql} ELSE {{0}} END"
for _names, _sql in {
    "none": "v", "utf8ToUnicode": "v", "parityEven7bit": "v", "parityOdd7bit": "v", "parityZero7bit": "v",
    "lowercase": "lower(v)", "uppercase": "replace(upper(replace(replace(replace(replace(v, 'ﬃ', 'FFI'), 'ﬁ', 'FI'), 'ﬀ', 'FF'), 'ß', 'SS')), 'ẞ', 'SS')",
    "compressWhitespace": f"regexp_replace(v, '{SPACE}+', ' ', 'g')", "removeWhitespace": f"regexp_replace(v, '{SPACE}+', '', 'g')",
    "trim": f"regexp_replace(regexp_replace(v, '^{SPACE}+', ''), '{SPACE}+$', '')", "trimLeft": f"regexp_replace(v, '^{SPACE}+', '')", "trimRight": f"regexp_replace(v, '{SPACE}+$', '')",
    "removeNulls": "replace(v, chr(0), '')", "replaceNulls": "replace(v, chr(0), ' ')",
    "removeCommentsChar": "replace(replace(replace(replace(v, '/*', ''), '*/', ''), '--', ''), '#', '')",
    "cmdLine": rf"""regexp_replace(regexp_replace(regexp_replace(replace(translate(v, ',;''"`ABCDEFGHIJKLMNOPQRSTUVWXYZ', '     abcdefghijklmnopqrstuvwxyz'), '^', ''), '{SPACE}+', ' ', 'g'), '^ ', ''), ' $', '')""",
    "md5": "md5(v)", "sha1": "sha1(v)", "sha256": "sha256(v)", "hexEncode": "lower(hex(encode(v)))", "base64Encode": "base64(encode(v))", "length": "CAST(octet_length(encode(v)) AS VARCHAR)",
    "urlEncode": "replace(replace(replace(replace(replace(url_encode(v), '-', '%2D'), '.', '%2E'), '_', '%5F'), '~', '%7E'), '*', '%2A')",
    "normalizePath": _normal_sql.format("v"), "normalizePathWin": f"replace({_normal_sql.format('v')}, '/', '\\')",
}.items():
    _transformation(_names, _sql)
_commented = lambda v: F.concat(F.lit("a/*"), v, F.lit("*/b/*c*/d/*"), v)
_transformation("removeComments", _no_comments.format("'a/*' || v || '*/b/*c*/d/*' || v"), given=_commented)
_transformation("replaceComments", r"regexp_replace(regexp_replace('a/*' || v || '*/b/*c*/d/*' || v, '(?s)/\*.*?\*/', ' ', 'g'), '(?s)/\*.*$', '')", given=_commented)
_transformation("urlDecode", "url_decode(v)", "query_string")
_transformation("lowercase removeWhitespace sha1", f"sha1(regexp_replace(lower(v), '{SPACE}+', '', 'g'))", label="pipeline")
for _name, _said in said.DECODERS.items():
    _transformation(_name, _said("v"))
# What an encoder wrote comes back, whatever the text.
for _names in ("base64Encode base64Decode", "base64Encode base64DecodeExt", "hexEncode hexDecode"):
    _transformation(_names, "v", label=_names.split()[1] + "_inverse")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Query strings, argument values and bodies of all rows as they are stored: (tx_id, field, pos, v)."""
    text = lambda field, pos, v: F.struct(F.lit(field).alias("field"), pos.cast("int").alias("pos"), v.alias("v"))
    all_ = F.concat(
        F.array(text("query_string", F.lit(0), F.col("query_string"))),
        F.coalesce(F.transform("args_get", lambda a, i: text("args_get", i, a["value"])), F.expr("array()")),
        F.array(text("request_body", F.lit(0), F.make_valid_utf8(F.col("request_body").cast("string")))))
    return _tx(spark, d).select("tx_id", F.explode(all_).alias("t")).select("tx_id", "t.*")


_STORED_SQL = (
    f"stored AS (SELECT tx_id, 'query_string' AS field, 0 AS pos, query_string AS v FROM {TX} UNION ALL SELECT tx_id, 'args_get', p - 1, a.value FROM (SELECT tx_id, unnest(args_get) AS a, generate_subscripts(args_get, 1) AS p FROM {TX}) "
    f"UNION ALL SELECT tx_id, 'request_body', 0, CASE WHEN request_body IS NOT NULL THEN {said.body('request_body')} END FROM {TX})")


def _stored_transformation(name: str, sql: str) -> None:
    """A decoder over the stored texts."""
    _add(f"t_{name}_stored", lambda s, d: _stored(s, d).select("tx_id", "field", "pos", apply_transformations(F.col("v"), (name,)).alias("out")),
         f"WITH {_STORED_SQL} SELECT tx_id, field, CAST(pos AS INTEGER) AS pos, {sql} AS out FROM stored")


for _name, _said in said.DECODERS.items():
    _stored_transformation(_name, _said("v"))


# Operators

def _operator(label: str, text: str | Callable[[], str], sql: str | None, column: str = "uri") -> None:
    """Per row whether a column satisfies an operator; ``sql`` in terms of v, null counts as no."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        op = parse_operator(text if isinstance(text, str) else text())
        rows = _values(spark, d) if column == "vals" else _tx(spark, d).select("tx_id", F.expr(column).alias("v"))
        return rows.select("tx_id", predicates.test(op, F.col("v")).alias("hit"))

    source = "vals" if column == "vals" else f"(SELECT tx_id, {column} AS v FROM {TX})"
    _add("op_" + label, run, f"WITH {VALUES_SQL} SELECT tx_id, coalesce({sql}, false) AS hit FROM {source}" if sql else None)


def _file(lines: list[str]) -> str:
    """A small file on the driver, where phrase and address files are read."""
    fd, name = tempfile.mkstemp(suffix=".data")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    return name


PORT = "CAST(client_port AS string)"
_port = lambda sql: f"regexp_matches(v, '^[+-]?[0-9]+$') AND TRY_CAST(v AS BIGINT) {sql}"
_pm = "contains(lower(v), 'admin') OR contains(lower(v), 'search') OR contains(lower(v), 'login')"
_quad = "TRY_CAST(split_part(v, '.', {}) AS BIGINT)"
_four = r"regexp_matches(v, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$') AND NOT v LIKE '%.'"
_number = f"(({_quad.format(1)} * 256 + {_quad.format(2)}) * 256 + {_quad.format(3)}) * 256 + {_quad.format(4)}"
_nets = f"{_four} AND ({_number} BETWEEN {10 << 24} AND {(11 << 24) - 1} OR {_number} BETWEEN {(198 << 24) + (18 << 16)} AND {(198 << 24) + (20 << 16) - 1})"
for _label, _text, _sql, _column in [
    ("rx", r"@rx ^/(?:admin|api)/[a-z0-9]+/", "regexp_matches(v, '^/(?:admin|api)/[a-z0-9]+/')", "uri"),
    ("rx_default", r"(?i)SEARCH$", "regexp_matches(v, '(?i)SEARCH$')", "uri"),
    ("rx_invalid", r"@rx (?=a)", "false", "uri"),
    ("pm", "@pm admin SEARCH login", _pm, "uri"), ("pmf", "@pmf admin SEARCH login", _pm, "uri"),
    ("pmFromFile", lambda: "@pmFromFile " + _file(["# phrases", "admin", "", " Search ", "login"]), _pm, "uri"),
    ("contains", "@contains /static", "contains(v, '/static')", "uri"), ("containsWord", "@containsWord /static", "contains(v, '/static')", "uri"),
    ("strmatch", "@strmatch /static", "contains(v, '/static')", "uri"), ("beginsWith", "@beginsWith /media", "starts_with(v, '/media')", "uri"),
    ("endsWith", "@endsWith .js", "suffix(v, '.js')", "uri"), ("streq", "@streq GET", "v = 'GET'", "method"), ("within", "@within GET HEAD", "v IN ('GET', 'HEAD')", "method"),
    ("eq", "@eq 443", _port("= 443"), "CAST(server_port AS string)"), ("ne", "@ne 443", "v <> '443'", "CAST(server_port AS string)"),
    ("gt", "@gt 50000", _port("> 50000"), PORT), ("ge", "@ge 50000", _port(">= 50000"), PORT), ("lt", "@lt 50000", _port("< 50000"), PORT), ("le", "@le 50000", _port("<= 50000"), PORT),
    ("eq_macro", "@eq %{TX.limit}", "false", PORT), ("not_streq", "!@streq GET", "v <> 'GET'", "method"),
    ("validateUrlEncoding", "@validateUrlEncoding", "contains(regexp_replace(v, '%[0-9A-Fa-f]{2}', '_', 'g'), '%')", "uri"),
    ("validateUtf8Encoding", "@validateUtf8Encoding", "contains(v, chr(0))", "vals"),
    ("validateByteRange", "@validateByteRange 32-126,9,x", r"regexp_matches(v, '[^\t -~]')", "vals"),
    ("ipMatch", "@ipMatch 10.0.0.0/8 198.18.0.0/15", _nets, "client_ip"), ("ipMatchF", "@ipMatchF 10.0.0.0/8 198.18.0.0/15", _nets, "client_ip"),
    ("ipMatchFromFile", lambda: "@ipMatchFromFile " + _file(["10.0.0.0/8", "# test nets", "198.18.0.0/15"]), _nets, "client_ip"),
    ("ipMatch_v6", "@ipMatch 2001:db8::/32 10.0.0.1", "starts_with(v, '2001:db8:') OR v = '10.0.0.1'", "client_ip"),
    ("unconditionalMatch", "@unconditionalMatch", "v IS NOT NULL", "client_ip"), ("noMatch", "@noMatch", "false", "client_ip"),
    *[(n, f"@{n} x", "false", "uri") for n in (
        "verifyCC verifySSN verifyCPF validateHash validateDTD validateSchema rbl geoLookup gsbLookup inspectFile fuzzyHash rsub").split()],
]:
    _operator(_label, _text, _sql, _column)

# Long lists, as threat feeds and phrase files have them.
NETWORKS = [f"{1 + 7 * i % 223}.{13 * i % 256}.{i % 256}.0/24" for i in range(6000)] + [f"198.{18 + i % 2}.{i}.0/24" for i in range(0, 256, 2)]
PHRASES = [f"/{i}" for i in range(1000, 3800)] + [f"{a}{b}" for a in ("kelp", "onyx", "pine", "dune", "fjord") for b in (".", ":", "/", "-", " ", "&", "=")]
_operator("ipMatch_many", "@ipMatch " + " ".join(NETWORKS), f"{_four} AND regexp_extract(v, '^(.*)[.][0-9]+$', 1) IN ({', '.join(sorted({chr(39) + n[:-5] + chr(39) for n in NETWORKS}))})", "client_ip")
_operator("ipMatch_many_v6", "@ipMatch 2001:db8::/33 2001:db8:8000::/33 " + " ".join(NETWORKS),
          f"starts_with(v, '2001:db8:') OR {_four} AND regexp_extract(v, '^(.*)[.][0-9]+$', 1) IN ({', '.join(sorted({chr(39) + n[:-5] + chr(39) for n in NETWORKS}))})", "client_ip")
_operator("pm_many", "@pm " + " ".join(p for p in PHRASES if " " not in p), "regexp_matches(lower(v), '" + "|".join(p.replace(".", "[.]") for p in PHRASES if " " not in p) + "')", "uri")

_VALS = f"SELECT tx_id, unnest(args_get).value AS v FROM {TX}"
for _label, _op, _sql in (("detectSQLi", "@detectSQLi", f"SELECT tx_id, sqli IS NOT NULL AS hit FROM ({found.sqli(_VALS)})"), ("detectXSS", "@detectXSS", f"SELECT tx_id, xss IS NOT NULL AS hit FROM ({found.xss(_VALS)})")):
    _operator(_label, _op, None, "vals")
    SQL[f"op_{_label}"] = _sql
_hinted = lambda hints: "(" + " OR ".join("contains(lower(v), '{}')".format(h.replace("'", "''")) for h in hints) + ")"
_any = lambda ps: "(" + " OR ".join("regexp_matches(v, '{}')".format(p.replace("'", "''")) for p in ps) + ")"
_literal = lambda ts: "(" + " OR ".join(f"contains(lower(v), '{t}')" for t in ts) + ")"
_add("op_sqli_patterns", lambda s, d: _values(s, d).select("tx_id", (detectors.sqli_hinted(F.col("v")) & detectors.sqli_by_pattern(F.col("v"))).alias("hit")),
     f"WITH {VALUES_SQL} SELECT tx_id, {_hinted(detectors.SQL_HINTS)} AND {_any(detectors.SQL_PATTERNS)} AS hit FROM vals")
_add("op_xss_patterns", lambda s, d: _values(s, d).select("tx_id", (detectors.xss_hinted(F.col("v")) & detectors.xss_by_pattern(F.col("v"))).alias("hit")),
     f"WITH {VALUES_SQL} SELECT tx_id, {_hinted(detectors.XSS_HINTS)} AND ({_any(detectors.XSS_PATTERNS)} OR "
     f"{_literal(detectors.XSS_TAGS + detectors.XSS_HANDLERS + detectors.XSS_SCHEMES)}) AS hit FROM vals")
_add("op_detection_fingerprints", lambda s, d: _values(s, d).select("tx_id", detectors.detection(F.col("v"), "sqli").alias("q"), detectors.detection(F.col("v"), "xss").alias("x")).select(
    "tx_id", F.col("q.is_injection").alias("sqli"), F.col("q.fingerprint").alias("sqli_fingerprint"), F.col("x.is_injection").alias("xss"), F.col("x.fingerprint").alias("xss_fingerprint")),
     f"SELECT tx_id, sqli IS NOT NULL AS sqli, sqli AS sqli_fingerprint, xss IS NOT NULL AS xss, xss AS xss_fingerprint FROM ({found.xss(found.sqli(_VALS))})")
_add("op_rx_captures", lambda s, d: _tx(s, d).select("tx_id", F.array_join(rx_groups(F.col("uri"), r"^/([a-z]+)/([a-z0-9]+)"), "|").alias("groups")),
     f"SELECT tx_id, CASE WHEN regexp_matches(uri, '^/([a-z]+)/([a-z0-9]+)') THEN regexp_extract(uri, '^/([a-z]+)/([a-z0-9]+)', 1) || '|' || "
     f"regexp_extract(uri, '^/([a-z]+)/([a-z0-9]+)', 2) WHEN uri IS NOT NULL THEN '' END AS groups FROM {TX}")


# Variables

def _variable(label: str, text: str, sql: str | None, phase: int = 5, observed: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _tx(spark, d)
        both = F.concat(*[resolved(df, v, phase, observed) for v in parse_variables(text)])
        return df.select("tx_id", F.explode(both).alias("x")).select("tx_id", "x.full_name", "x.value")

    _add("var_" + label, run, sql)


_scalar_sql = lambda name, sql: f"SELECT tx_id, '{name}' AS full_name, {sql} AS value FROM {TX}"
_pairs_sql = lambda name, column, key="name": (
    f"SELECT tx_id, '{name}:' || {key} AS full_name, value FROM (SELECT tx_id, unnest({column}).name AS name, unnest({column}).value AS value FROM {TX})")
_args_sql = _pairs_sql("ARGS", "args_get")
_query_sql = "CASE WHEN contains(uri, '?') THEN substr(uri, instr(uri, '?') + 1) ELSE '' END"
for _name, _sql in {
    "REQUEST_URI": "coalesce(uri, '')", "REQUEST_URI_RAW": "coalesce(uri, '')", "REQUEST_METHOD": "coalesce(method, '')", "REQUEST_PROTOCOL": "coalesce(protocol, '')",
    "QUERY_STRING": _query_sql, "REQUEST_FILENAME": "split_part(uri, '?', 1)",
    "REQUEST_BODY_LENGTH": "CAST(CASE WHEN has_request_body_phase THEN coalesce(octet_length(request_body), 0) ELSE 0 END AS VARCHAR)",
    "RESPONSE_STATUS": "'0'", "REMOTE_ADDR": "''", "REMOTE_PORT": "'0'", "SERVER_NAME": "''", "SERVER_PORT": "'0'",
    "RESPONSE_CONTENT_TYPE": "coalesce(list_filter(response_headers, lambda h: lower(h.name) = 'content-type')[-1].value, '')",
}.items():
    _variable(_name, _name, _scalar_sql(_name, _sql))
_seen_sql = "CASE WHEN has_request_body_phase AND request_body IS NOT NULL THEN {} ELSE '' END".format(said.body("request_body"))
_variable("REQUEST_BODY", "REQUEST_BODY", _scalar_sql("REQUEST_BODY", _seen_sql))
_variable("RESPONSE_BODY", "RESPONSE_BODY", _scalar_sql("RESPONSE_BODY", f"CASE WHEN response_body IS NOT NULL THEN {said.body('response_body')} ELSE '' END"))
_form_sql = (
    f"SELECT tx_id, {said.percent('split_part(p, chr(61), 1)')} AS name, {said.percent('substr(p, instr(p, chr(61)) + 1)')} AS value "
    f"FROM (SELECT tx_id, unnest(string_split({_seen_sql}, '&')) AS p FROM {TX}) WHERE contains(p, '=')")
_post_sql = lambda name: f"SELECT tx_id, '{name}:' || name AS full_name, value FROM ({_form_sql})"
_variable("ARGS_POST", "ARGS_POST", _post_sql("ARGS_POST"))
_variable("ARGS_phase1", "ARGS", _args_sql, phase=1)
_args_sql = f"{_args_sql} UNION ALL {_post_sql('ARGS')}"
_variable("ARGS_GET", "ARGS_GET", _pairs_sql("ARGS_GET", "args_get"))
_variable("ARGS", "ARGS", _args_sql)
_variable("REQUEST_HEADERS", "REQUEST_HEADERS", _pairs_sql("REQUEST_HEADERS", "request_headers", "lower(name)"))
_variable("RESPONSE_HEADERS", "RESPONSE_HEADERS", _pairs_sql("RESPONSE_HEADERS", "response_headers", "lower(name)"))
_variable("REQUEST_COOKIES", "REQUEST_COOKIES", f"SELECT tx_id, '' AS full_name, '' AS value FROM {TX} WHERE false")
_variable("key", "ARGS:q", f"SELECT * FROM ({_args_sql}) WHERE full_name = 'ARGS:q'")
_variable("key_case", "REQUEST_HEADERS:User-Agent", f"SELECT tx_id, '' AS full_name, '' AS value FROM {TX} WHERE false")
_variable("pattern", "ARGS:/^[qp]/", f"SELECT * FROM ({_args_sql}) WHERE starts_with(full_name, 'ARGS:q') OR starts_with(full_name, 'ARGS:p')")
_variable("exclusion", "ARGS|!ARGS:p", f"SELECT * FROM ({_args_sql}) WHERE NOT contains(full_name, 'ARGS:p')")
_variable("several", "REQUEST_METHOD|&ARGS:q", f"{_scalar_sql('REQUEST_METHOD', 'method')} UNION ALL SELECT * FROM ({_args_sql}) WHERE full_name = 'ARGS:q'")
_variable("observed", "REMOTE_ADDR|REMOTE_PORT|RESPONSE_STATUS|SERVER_NAME|SERVER_PORT", " UNION ALL ".join([
    _scalar_sql("REMOTE_ADDR", "coalesce(client_ip, '')"), _scalar_sql("REMOTE_PORT", "coalesce(CAST(client_port AS VARCHAR), '0')"),
    _scalar_sql("RESPONSE_STATUS", "coalesce(CAST(response_status AS VARCHAR), '0')"), _scalar_sql("SERVER_NAME", "coalesce(server_name, '')"),
    _scalar_sql("SERVER_PORT", "coalesce(CAST(server_port AS VARCHAR), '0')")]), observed=True)


def var_empty(spark: SparkSession, d: str) -> DataFrame:
    """Values in all rows of every variable that has no source."""
    df = _tx(spark, d)
    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.size(resolved(df, parse_variables(n)[0])).alias("n")) for n in EMPTY])
    return df.select(F.explode(counts).alias("x")).groupBy("x.name").agg(F.sum("x.n").alias("n_values"))


_add("var_empty", var_empty, "SELECT unnest([" + ", ".join(f"'{n}'" for n in EMPTY) + "]) AS name, 0 AS n_values")


# Evaluation

def _verdicts(label: str, rules: str, sql: str | None, columns: Callable[[], list] | None = None, phases: tuple[int, ...] = (1, 2, 3, 4, 5)) -> None:
    """Verdicts of a rule set. By default matched rules, status (0: none), allowed and score of every row."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = Evaluator(Ruleset.from_string(rules)).evaluate(_tx(spark, d), phases)
        usual = [F.array_join("matched_rules", ",").alias("rules"), F.coalesce("intervention.status", F.lit(0)).alias("status"), "allowed", "anomaly_score"]
        return out.select("tx_id", *(columns() if columns else usual))

    _add("eng_" + label, run, sql)


_usual = lambda rules, status="0", allowed="false", score="0", source=TX: (
    f"SELECT tx_id, {rules} AS rules, {status} AS status, {allowed} AS allowed, {score} AS anomaly_score FROM {source}")
_A, _B = "contains(uri, '/admin')", "starts_with(uri, '/api')"
_case = lambda *pairs: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs[:-1]) + f" ELSE {pairs[-1]} END"
RULE_A = 'SecRule REQUEST_URI "@contains /admin" "id:1,phase:1,{}"\n'
RULE_B = 'SecRule REQUEST_URI "@beginsWith /api" "id:2,phase:1,{}"\n'
_both = _case((f"{_A} AND {_B}", "'1,2'"), (_A, "'1'"), (_B, "'2'"), "''")
_stop = _case((_A, "'1'"), (_B, "'2'"), "''")
_verdicts("deny", RULE_A.format("deny,status:500") + RULE_B.format("pass"), _usual(_stop, _case((_A, "403"), "0")))
_verdicts("block", RULE_A.format("block") + RULE_B.format("pass"), _usual(_stop, _case((_A, "403"), "0")))
_verdicts("allow", RULE_A.format("allow:phase") + RULE_B.format("deny"), _usual(_stop, _case((_A, "0"), (_B, "403"), "0"), _A))
_verdicts("pass", RULE_A.format("pass") + RULE_B.format("pass"), _usual(_both))
_verdicts("detection_only", "SecRuleEngine DetectionOnly\n" + RULE_A.format("deny") + RULE_B.format("drop"), _usual(_both))
_verdicts("off", RULE_A.format("deny") + "SecRuleEngine Off\n", _usual("''"))
_intervention = lambda: [F.col("intervention.status"), F.col("intervention.url"), F.col("intervention.drop_connection"), format_log(F.col("intervention")).alias("log")]
_verdicts("redirect_drop", RULE_A.format("redirect:https://x.example/,msg:'to x'") + RULE_B.format("drop"), (
    f"SELECT tx_id, {_case((_A, '302'), (_B, '444'), 'NULL')} AS status, {_case((_A, chr(39) + 'https://x.example/' + chr(39)), 'NULL')} AS url, "
    f"{_case((_A, 'false'), (_B, 'true'), 'NULL')} AS drop_connection, CASE WHEN {_A} THEN '[status 302] [rule_ids: 1, 1] [msg: to x] [redirect: https://x.example/] "
    f"[phase: REQUEST_HEADERS]' WHEN {_B} THEN '[status 444] [rule_ids: 2, 2] [phase: REQUEST_HEADERS]' END AS log FROM {TX}"), _intervention)
_chain = RULE_A.format("pass,chain") + 'SecRule REQUEST_METHOD "@streq POST" "phase:1,id:3,setvar:tx.anomaly_score=+5"\n'
_verdicts("chain", _chain, _usual(_case((f"{_A} AND method = 'POST'", "'1,3'"), (_A, "'1'"), ("method = 'POST'", "'3'"), "''"), score=_case(("method = 'POST'", "5"), "0")))
_verdicts("chain_deny", RULE_A.format("deny,chain") + 'SecRule REQUEST_METHOD "@streq POST" "phase:1,id:3"\n', _usual(
    _case((_A, "'1'"), ("method = 'POST'", "'3'"), "''"), _case((_A, "403"), "0")))
_verdicts("skip", RULE_A.format("skip:1") + RULE_B.format("pass") + 'SecRule REQUEST_METHOD "@streq GET" "id:3,phase:1"\n', _usual(
    f"concat_ws(',', CASE WHEN {_A} THEN '1' END, CASE WHEN {_B} AND NOT {_A} THEN '2' END, CASE WHEN method = 'GET' THEN '3' END)"))
_verdicts("skip_after", RULE_A.format("skipAfter:END") + RULE_B.format("pass") + 'SecRule REQUEST_METHOD "@streq PUT" "id:4,phase:1"\nSecMarker END\n'
          'SecRule REQUEST_METHOD "@streq GET" "id:3,phase:1"\n', _usual(
              f"concat_ws(',', CASE WHEN {_A} THEN '1' END, CASE WHEN {_B} AND NOT {_A} THEN '2' END, CASE WHEN method = 'PUT' AND NOT {_A} THEN '4' END, CASE WHEN method = 'GET' THEN '3' END)"))
_verdicts("skip_after_unknown", RULE_A.format("skipAfter:NOWHERE") + RULE_B.format("pass"), _usual(_stop))
_score = 'SecRule REQUEST_METHOD "@streq POST" "id:3,phase:1,setvar:tx.anomaly_score=+3"\nSecRule TX:anomaly_score "@ge 5" "id:9,phase:1,deny"\n'
_sum = f"(CASE WHEN {_A} THEN 4 ELSE 0 END + CASE WHEN method = 'POST' THEN 3 ELSE 0 END)"
_verdicts("score", RULE_A.format("setvar:tx.anomaly_score=+4") + _score, _usual(
    f"concat_ws(',', CASE WHEN {_A} THEN '1' END, CASE WHEN method = 'POST' THEN '3' END, CASE WHEN {_sum} >= 5 THEN '9' END)", _case((f"{_sum} >= 5", "403"), "0"), score=_sum))
_vars = lambda: [F.try_element_at("tx", F.lit(k)).alias(k) for k in ("a", "b", "c", "anomaly_score", "rfi_score")]
_verdicts("setvar", RULE_A.format("setvar:tx.a=7") + RULE_B.format("setvar:TX.b") + 'SecRule REQUEST_METHOD "@streq GET" "id:3,phase:1,setvar:\'tx.c=+5\'"\n'
          'SecRule REQUEST_METHOD "@streq GET" "id:4,phase:1,setvar:tx.a=-2"\nSecRule REQUEST_METHOD "@streq HEAD" "id:5,phase:1,setvar:!tx.a"\n', (
              f"SELECT tx_id, CASE WHEN method = 'HEAD' THEN NULL WHEN method = 'GET' THEN CASE WHEN {_A} THEN '5' ELSE '-2' END WHEN {_A} THEN '7' END AS a, "
              f"CASE WHEN {_B} THEN '1' END AS b, CASE WHEN method = 'GET' THEN '1' END AS c, '0' AS anomaly_score, '0' AS rfi_score FROM {TX}"), _vars)
_verdicts("default_action", 'SecDefaultAction "phase:1,deny,t:lowercase"\nSecRule REQUEST_METHOD "@streq post"\nSecRule REQUEST_URI "@contains /admin" "id:1,pass"\n', _usual(
    _case(("method = 'POST'", "''"), (_A, "'1'"), "''"), _case(("method = 'POST'", "403"), "0")))
_verdicts("sec_action", 'SecAction "id:7,phase:1,deny"\n' + RULE_A.format("pass"), _usual(_case((_A, "'1'"), "''")))
_verdicts("negation_without_values", 'SecRule FILES "!@rx x" "id:5,phase:1,pass"\nSecRule ARGS:q "!@rx [0-9]" "id:6,phase:1,pass"\n', _usual(
    "CASE WHEN len(list_filter(args_get, lambda a: a.name = 'q')) = 0 OR len(list_filter(args_get, lambda a: a.name = 'q' AND NOT regexp_matches(a.value, '[0-9]'))) > 0 THEN '5,6' ELSE '5' END"))
_verdicts("phases", 'SecRule ARGS_POST:amount "@unconditionalMatch" "id:20,phase:2,pass"\nSecRule REQUEST_METHOD "@streq POST" "id:21,phase:2,deny"\n'
          'SecRule RESPONSE_HEADERS:x-node "@beginsWith n1" "id:30,phase:3,pass"\nSecRule REQUEST_METHOD "@rx ." "id:50,phase:5,pass"\n', _usual(
              "concat_ws(',', CASE WHEN a THEN '20' END, CASE WHEN b THEN '21' END, CASE WHEN NOT b AND n > 0 THEN '30' END, CASE WHEN NOT b AND method <> '' THEN '50' END)", _case(("b", "403"), "0"),
              source=f"(SELECT *, coalesce(has_request_body_phase AND method = 'POST', false) AS b, len(list_filter(response_headers, lambda h: lower(h.name) = 'x-node' AND starts_with(h.value, 'n1'))) AS n, "
                     f"len(list_filter(list_filter(string_split({_seen_sql}, '&'), lambda p: contains(p, '=')), lambda p: {said.percent('split_part(p, chr(61), 1)')} = 'amount')) > 0 AS a FROM {TX})"))
_verdicts("late_phases", 'SecRule REQUEST_METHOD "@streq POST" "id:21,phase:2,deny"\nSecRule RESPONSE_HEADERS:x-node "@beginsWith n1" "id:30,phase:3,pass"\n'
          'SecRule REQUEST_METHOD "@rx ." "id:50,phase:5,pass"\n', _usual(
              "concat_ws(',', CASE WHEN b THEN '21' END, CASE WHEN NOT b AND n > 0 THEN '30' END, CASE WHEN NOT b AND method <> '' THEN '50' END)", _case(("b", "403"), "0"),
              source=f"(SELECT *, coalesce(has_request_body_phase AND method = 'POST', false) AS b, len(list_filter(response_headers, lambda h: lower(h.name) = 'x-node' AND starts_with(h.value, 'n1'))) AS n FROM {TX})"))
_verdicts("detectors", 'SecRule ARGS "@detectSQLi" "id:942100,phase:1,setvar:tx.anomaly_score=+5"\nSecRule ARGS "@detectXSS" "id:941100,phase:1,setvar:tx.anomaly_score=+5"\n'
          'SecRule TX:anomaly_score "@ge 5" "id:949110,phase:1,deny"\n',
          "SELECT tx_id, concat_ws(',', CASE WHEN q THEN '942100' END, CASE WHEN x THEN '941100' END, CASE WHEN q OR x THEN '949110' END) AS rules, CASE WHEN q OR x THEN 403 ELSE 0 END AS status, "
          "false AS allowed, CASE WHEN q AND x THEN 10 WHEN q OR x THEN 5 ELSE 0 END AS anomaly_score "
          f"FROM (SELECT n, any_value(tx_id) AS tx_id, coalesce(bool_or(sqli IS NOT NULL), false) AS q, coalesce(bool_or(xss IS NOT NULL), false) AS x "
          "FROM (SELECT n, tx_id, unnest(CASE WHEN len(args_get) > 0 THEN list_transform(args_get, lambda a: a.value) ELSE [''] END) AS v "
          f"FROM (SELECT tx_id, args_get, row_number() OVER () AS n FROM {TX})) LEFT JOIN ({found.xss(found.sqli(f'SELECT DISTINCT v FROM ({_VALS})'))}) USING (v) GROUP BY n)")
_in_many = " + ".join(f"CASE WHEN contains(uri, '{w}') THEN 1 ELSE 0 END" for w in [f"/{i}" for i in range(100, 300)])
MANY = "".join(f'SecRule REQUEST_URI "@contains /{i}" "id:{i},phase:1,setvar:tx.anomaly_score=+1"\n' for i in range(100, 300)) + 'SecRule TX:anomaly_score "@ge 2" "id:999,phase:1,deny"\n'
_verdicts("many_rules", MANY, f"SELECT tx_id, {_in_many} AS anomaly_score, CASE WHEN {_in_many} >= 2 THEN 403 ELSE 0 END AS status FROM {TX}",
          lambda: ["anomaly_score", F.coalesce("intervention.status", F.lit(0)).alias("status")])
_add("eng_macros", lambda s, d: _tx(s, d).select("tx_id", expand_macros(F.lit("Score %{TX.a} %{TX.none}, %{MATCHED_VAR} in %{MATCHED_VAR_NAME}"), F.create_map(F.lit("a"), F.col("method")), path(F.col("uri")), F.lit("URI")).alias("text")),
     f"SELECT tx_id, 'Score ' || method || ' , ' || split_part(uri, '?', 1) || ' in URI' AS text FROM {TX}")
_add("eng_scores", lambda s, d: table(s, d, "rules").select("rule_id", scoring.severity_score(F.col("severity")).alias("score"), scoring.threshold(F.col("phase")).alias("inbound"), scoring.threshold(F.col("phase"), True).alias("outbound"),
     scoring.exceeded(scoring.severity_score(F.col("severity")), F.col("phase")).alias("exceeded")),
     "SELECT rule_id, CASE WHEN severity <= 2 THEN 5 WHEN severity = 3 THEN 4 WHEN severity = 4 THEN 3 WHEN severity = 5 THEN 2 ELSE 0 END AS score, "
     "CASE phase WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 15 ELSE 20 END AS inbound, CASE phase WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 12 ELSE 16 END AS outbound, "
     "CASE WHEN severity <= 2 THEN 5 WHEN severity = 3 THEN 4 WHEN severity = 4 THEN 3 WHEN severity = 5 THEN 2 ELSE 0 END >= CASE phase WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 15 ELSE 20 END AS exceeded FROM rules")
_add("eng_log_format", lambda s, d: table(s, d, "interventions").select("intervention_id", format_log(F.struct("status", "url", "log", F.coalesce("rule_ids", F.expr("cast(array() as array<string>)")).alias("rule_ids"), "phase")).alias("text")),
     "SELECT intervention_id, concat_ws(' ', '[status ' || status || ']', CASE WHEN len(rule_ids) > 0 THEN '[rule_ids: ' || array_to_string(rule_ids, ', ') || ']' END, '[msg: ' || log || ']', "
     "'[redirect: ' || url || ']', '[phase: ' || ['REQUEST_HEADERS', 'REQUEST_BODY', 'RESPONSE_HEADERS', 'RESPONSE_BODY', 'LOGGING'][phase] || ']') AS text FROM interventions")
_add("eng_hits_per_rule", lambda s, d: Evaluator(Ruleset.from_string(RULE_A.format("pass") + RULE_B.format("pass"))).evaluate(_tx(s, d)).select(F.explode("matched_rules").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n")),
     f"SELECT '1' AS rule_id, count(*) AS n FROM {TX} WHERE {_A} UNION ALL SELECT '2', count(*) FROM {TX} WHERE {_B}")
_blocked = RULE_A.format("deny")
_add("eng_blocked_per_hour", lambda s, d: verdicts.blocked_per_window(Evaluator(Ruleset.from_string(_blocked)).evaluate(_tx(s, d))),
     f"SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_rows, count(*) FILTER ({_A}) AS n_blocked FROM {TX} WHERE ts IS NOT NULL GROUP BY 1")


# Sources, sinks and streams

RULE_FILE = 'SecRule REQUEST_URI "@contains /admin" \\\n    "id:1,phase:1,deny,\\\n    msg:\'no admin\',severity:CRITICAL,tag:\'t1\'"\n# end\nSecRule ARGS:q|!ARGS:qq "@rx ^a" "id:2,phase:2,t:lowercase,chain"\nSecMarker DONE\n'


RULE_FILES = {"a.conf": RULE_FILE, "b.conf": 'SecAction "id:3,phase:5"\n'}


def _rule_files() -> str:
    """Files on the driver, which reads them itself."""
    at = tempfile.mkdtemp(prefix="rules-")
    for name, text in (*RULE_FILES.items(), ("main", "Include *.conf\nInclude nothing/*.conf\n")):
        with open(os.path.join(at, name), "w", encoding="utf-8") as f:
            f.write(text)
    return at


def _rule_rows(spark: SparkSession, rules: Ruleset) -> DataFrame:
    return rules.rules_frame(spark).select("phase", "idx", "id", "operator", "argument", "is_chain", "log")


_rules_sql = (
    "SELECT * FROM (VALUES (1, 0, '1', 'contains', '/admin', false, '[id \"1\"] [msg \"no admin\"] [severity \"CRITICAL\"] [tag \"t1\"]'), (2, 0, '2', 'rx', '^a', true, '[id \"2\"]'){}) "
    "AS r(phase, idx, id, operator, argument, is_chain, log)")
_add("src_rules_string", lambda s, d: _rule_rows(s, Ruleset.from_string(RULE_FILE)), _rules_sql.format(""))
_add("src_rules_file", lambda s, d: _rule_rows(s, Ruleset.from_file(_rule_files() + "/a.conf")), _rules_sql.format(""))
_rules_all = _rules_sql.format(", (5, 0, '3', 'unconditionalmatch', '', false, '[id \"3\"]')")
_add("src_rules_glob", lambda s, d: _rule_rows(s, Ruleset.from_glob(_rule_files() + "/*.conf")), _rules_all)


def src_rules_remote(spark: SparkSession, d: str) -> DataFrame:
    """Rule files in the shared folder, written and read by executors."""
    at = _place(spark, "rules")
    for name, text in RULE_FILES.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{at}/{name}")
    return _rule_rows(spark, Ruleset.from_remote(spark, f"{at}/*.conf/part-*"))


_add("src_rules_remote", src_rules_remote, _rules_all)
_add("src_rules_table", lambda s, d: Ruleset.from_frame(table(s, d, "rules"), skip_unusable=True).rules_frame(s).select("id", "phase", "operator", "negated", F.size("variables").alias("n_variables"), "is_chain"),
     "SELECT rule_id AS id, phase, lower(replace(replace(op_name, '!', ''), '@', '')) AS operator, starts_with(op_name, '!') AS negated, CAST(len(variables) AS INTEGER) AS n_variables, is_chain "
     "FROM rules WHERE NOT (argument = '' AND op_name IN ('@rx', '@pm'))")
_add("src_markers", lambda s, d: Ruleset.from_string(RULE_FILE).markers_frame(s), "SELECT 'DONE' AS name, 1 AS phase, 1 AS idx")


def src_rules_include(spark: SparkSession, d: str) -> DataFrame:
    """A file that includes others of its folder."""
    at = _rule_files()
    with open(at + "/main", "w", encoding="utf-8") as f:
        f.write("Include a.conf\nInclude b.conf\nInclude missing.conf\n")
    return _rule_rows(spark, Ruleset.from_file(at + "/main"))


_add("src_rules_include", src_rules_include, _rules_all)


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def sink_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts written to Parquet and read again."""
    at = _place(spark, "verdicts")
    Evaluator(Ruleset.from_string(_blocked)).evaluate(_tx(spark, d)).select("tx_id", "intervention", "matched_rules", "tx").write.parquet(at)
    return spark.read.parquet(at).select("tx_id", F.coalesce("intervention.status", F.lit(0)).alias("status"))


_status_sql = f"SELECT tx_id, CASE WHEN {_A} THEN 403 ELSE 0 END AS status FROM {TX}"
_add("sink_verdicts", sink_verdicts, _status_sql)


def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream of files, verdicts appended to Parquet."""
    at, path_ = _place(spark, "stream"), f"{d}/{TX}.parquet"
    folder = path_ if os.path.isdir(path_) else None
    stream = spark.readStream.schema(_tx(spark, d).schema).option("pathGlobFilter", "*.parquet" if folder else f"{TX}.parquet").parquet(folder or d)
    verdicts.write_verdicts(verdicts.score(stream, Ruleset.from_string(_blocked)).select("tx_id", "intervention"), at, at + "-checkpoint").awaitTermination()
    return spark.read.parquet(at).select("tx_id", F.coalesce("intervention.status", F.lit(0)).alias("status"))


_add("stream_verdicts", stream_verdicts, _status_sql)


def stream_assemble(spark: SparkSession, d: str) -> DataFrame:
    """All rows cut into parts, the parts read as a stream and put together again: one row for each tx_id (of resent ones the parts are the same)."""
    src, at = _place(spark, "parts"), _place(spark, "assembled")
    assemble.to_parts(_tx(spark, d)).write.option("compression", "zstd").parquet(src)
    whole = assemble.assemble(verdicts.read_transactions(spark, src, assemble.PART))
    assemble.write_assembled(whole, at, at + "-checkpoint").awaitTermination()
    return assemble.read_assembled(spark, at, "method", "uri", F.size("request_headers").alias("n_headers"), F.coalesce(F.octet_length("request_body"), F.lit(0)).alias("body_bytes"))


_add("stream_assemble", stream_assemble,
     f"SELECT tx_id, any_value(method) AS method, any_value(uri) AS uri, any_value(len(request_headers)) AS n_headers, coalesce(any_value(octet_length(request_body)), 0) AS body_bytes FROM {TX} GROUP BY tx_id")
