"""Queries of the general data operators: uneven keys, bad records, frequent values, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import iceberg, malformed, packed, skew
from ..sources import table
from ..sources.tables import cut

#: The packed query arguments and headers.
PACKED_ARGUMENTS = ["fields", "tags", "scope", "ids"]
PACKED_HEADERS = ["x-labels", "x-route", "accept-features"]


def _client_rows(spark: SparkSession, d: str) -> tuple[DataFrame, skew.LoadPlan]:
    rows = table(spark, d, "http_transactions").select("client_ip", "ts", "response_status")
    return rows, skew.plan_loads(rows, "client_ip")


def _per_client(rows: DataFrame, plan: skew.LoadPlan) -> DataFrame:
    first = rows.where(F.col("client_ip").isNotNull()).groupBy("client_ip").agg(F.min("ts").alias("first_ts"))
    joined = skew.fragment_replicate_join(rows, first, "client_ip", "inner", plan)
    early = F.count_if(F.col("ts") < F.col("first_ts") + F.expr("interval 1 hour"))
    return skew.balanced_aggregate(
        joined, "client_ip",
        {"n_rows": F.count("*"), "n_errors": F.count_if(F.col("response_status") >= 400), "first_ts": F.min("first_ts"), "n_first_hour": early},
        {"n_rows": F.sum("n_rows"), "n_errors": F.sum("n_errors"), "first_ts": F.min("first_ts"), "n_first_hour": F.sum("n_first_hour")})


def p1_clients(spark: SparkSession, d: str) -> DataFrame:
    """Per client: rows, errors, and rows within an hour of its first."""
    return _per_client(*_client_rows(spark, d))


def _rule_rows(spark: SparkSession, d: str) -> tuple[DataFrame, skew.LoadPlan]:
    rows = table(spark, d, "interventions").select(F.explode(F.array_distinct("rule_ids")).alias("rule_id"), "drop_connection")
    return rows, skew.plan_loads(rows, "rule_id")


def _per_rule(spark: SparkSession, d: str, rows: DataFrame, plan: skew.LoadPlan) -> DataFrame:
    rules = table(spark, d, "rules").groupBy("rule_id").agg(F.max("severity").alias("severity"))
    joined = skew.fragment_replicate_join(rows, rules, "rule_id", "left", plan)
    return skew.balanced_aggregate(
        joined.where(F.col("rule_id").isNotNull()), "rule_id",
        {"n_rows": F.count("*"), "n_dropped": F.count_if("drop_connection"), "severity": F.max("severity")},
        {"n_rows": F.sum("n_rows"), "n_dropped": F.sum("n_dropped"), "severity": F.max("severity")})


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per rule id: interventions, dropped connections and the rule's severity."""
    return _per_rule(spark, d, *_rule_rows(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys in at least 3 % of all rows, from the per-key results."""
    rows, plan = _client_rows(spark, d)
    clients = _per_client(rows, plan).where(F.col("n_rows") * 100 >= 3 * plan.total_rows)
    all_rows = table(spark, d, "interventions").count()
    rules = _per_rule(spark, d, *_rule_rows(spark, d)).where(F.col("n_rows") * 100 >= 3 * all_rows)
    return clients.select(F.lit("client_ip").alias("field"), F.col("client_ip").alias("key_text")).unionByName(
        rules.select(F.lit("rule_ids").alias("field"), F.col("rule_id").alias("key_text")))


def p2_locations(spark: SparkSession, d: str) -> DataFrame:
    """The readable location records as typed rows."""
    return malformed.strict_load(table(spark, d, "location_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The unreadable location records with the reason."""
    return malformed.rejected(table(spark, d, "location_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values in at least 1 % of all rows."""
    return iceberg.frequent_items(table(spark, d, "http_transactions"), ["uri", "client_ip"], 0.01).select("field", "key_text")


def p3_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Values in at least 0.2 % of all rows, with their counts."""
    return iceberg.frequent_items(table(spark, d, "http_transactions"), ["uri", "client_ip"], 0.002)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of every packed argument and header."""
    lists = packed.packed_fields(table(spark, d, "http_transactions"), PACKED_ARGUMENTS, PACKED_HEADERS)
    # A resent request's lists meet here, so that values need no exchange of their own; both passes read this instead of the whole requests.
    lists = cut(lists.groupBy("tx_id", "field", "name").agg(F.collect_set("packed").alias("all")).select("tx_id", "field", "name", F.explode("all").alias("packed")))
    return packed.split_packed(lists, "packed").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_clients, p1_rules, p2_found, p2_locations, p3_found, p3_frequent, p5_found)}

_Q = r'"(?:[^"]|"")*"'
_LINE = "regexp_replace(coalesce(line_text, ''), '\r\\z', '')".replace("\r", "\\r")


def _by_sep(sql: str) -> str:
    """``sql`` for each separator, {s} being the separator in a pattern and {b} the blanks."""
    marks = {"comma": (",", r" \t"), "semicolon": (";", r" \t"), "tab": (r"\t", " "), "pipe": (r"\|", r" \t")}
    return "CASE sep " + " ".join("WHEN '{}' THEN {}".format(k, sql.replace("{s}", s).replace("{b}", b)) for k, (s, b) in marks.items()) + " END"


_FIELD = rf'(?:[{{b}}]*{_Q}[{{b}}]*|[^{{s}}"]*)'
_SIX = _by_sep("regexp_extract(t, '^" + "{s}".join([f"({_FIELD})"] * 6) + r"\z', ['a', 'b', 'c', 'd', 'e', 'f'])")
_BARE = "(CASE WHEN starts_with({0}, '\"') THEN replace({0}[2:-2], '\"\"', '\"') ELSE {0} END)"
_READ = f"""
    lines AS (SELECT record_id, sep, {_LINE} AS t FROM location_records),
    judged AS (SELECT record_id, sep, t, {_by_sep(f"regexp_matches(t, '^{_FIELD}(?:{{s}}{_FIELD})*" + chr(92) + "z')")} AS whole,
        {_by_sep(f"regexp_matches(t, '^{_FIELD}(?:{{s}}{_FIELD}){{5}}" + chr(92) + "z')")} AS six, {_SIX} AS x FROM lines),
    parts AS (SELECT *, {", ".join(_BARE.format(f"trim(x.{c}, ' ' || chr(9))") + f" AS {c}" for c in "abcdef")} FROM judged),
    fine AS (SELECT *, (a = '' OR suffix(a, '.conf')) AND regexp_matches(b, '^[0-9]+\\z') AND regexp_matches(c, '^[0-9]+\\z')
        AND coalesce(TRY_CAST(b AS HUGEINT) BETWEEN 1 AND 2147483647, false) AND coalesce(TRY_CAST(c AS HUGEINT) BETWEEN 1 AND 2147483647, false)
        AND lower(d) IN ({", ".join(f"'{x.lower()}'" for x in malformed.DIRECTIVES)}) AND regexp_matches(e, '^[0-9]*\\z') AS ok FROM parts)"""
_SEP = r"[^\w\s" + r"""\-.:/"'\\""" + "]"
_SEP_SQL = _SEP.replace("'", "''")
_PIECE = rf"""\s*("(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.|'')*'|(?:[\w\s\-.:/"'\\])*)\s*{_SEP}""".replace("'", "''")
_NAMES = lambda names: ", ".join(f"'{n}'" for n in names)

SQL = {
    "p2_found": f"""WITH {_READ} SELECT record_id, CASE WHEN NOT whole THEN 'quoting' WHEN NOT six THEN 'column_count' ELSE 'value' END AS reason FROM fine WHERE NOT (six AND ok)""",
    "p2_locations": f"""WITH {_READ} SELECT record_id, nullif(a, '') AS file, CAST(b AS INTEGER) AS line, CAST(c AS INTEGER) AS col, d AS directive, nullif(e, '') AS rule_id, f AS note
        FROM fine WHERE six AND ok""",
    "p5_found": rf"""
        WITH args AS (SELECT tx_id, 'query_string' AS field, split_part(p, '=', 1) AS name, url_decode(substr(p, instr(p, '=') + 1)) AS v
                      FROM (SELECT tx_id, unnest(string_split(query_string, '&')) AS p FROM http_transactions) WHERE contains(p, '=') AND split_part(p, '=', 1) IN ({_NAMES(PACKED_ARGUMENTS)})),
             heads AS (SELECT tx_id, 'headers' AS field, lower(h.name) AS name, h.value AS v FROM (SELECT tx_id, unnest(request_headers) AS h FROM http_transactions)
                       WHERE lower(h.name) IN ({_NAMES(PACKED_HEADERS)}) AND h.value IS NOT NULL),
             lists AS (SELECT DISTINCT * FROM args UNION SELECT DISTINCT * FROM heads),
             raw AS (SELECT tx_id, field, name, list_transform(regexp_extract_all(v || ',', '{_PIECE}', 1), lambda e: trim(e)) AS es FROM lists),
             els AS (SELECT tx_id, field, name, list_filter(list_transform(es, lambda e: CASE
                        WHEN len(e) > 1 AND e[1] = '"' AND e[-1] = '"' THEN replace(replace(e[2:-2], '""', '"'), chr(92) || '"', '"')
                        WHEN len(e) > 1 AND e[1] = chr(39) AND e[-1] = chr(39) THEN replace(replace(e[2:-2], chr(39) || chr(39), chr(39)), chr(92) || chr(39), chr(39))
                        ELSE e END), lambda e: e <> '') AS es FROM raw)
        SELECT DISTINCT tx_id, field, name, pos, val FROM (SELECT tx_id, field, name, unnest(range(len(es)))::INTEGER AS pos, unnest(es) AS val FROM els)""",
    "p1_found": """
        SELECT 'client_ip' AS field, client_ip AS key_text FROM http_transactions WHERE client_ip IS NOT NULL
        GROUP BY client_ip HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM http_transactions)
        UNION ALL
        SELECT 'rule_ids', r FROM (SELECT unnest(list_distinct(rule_ids)) AS r FROM interventions)
        WHERE r IS NOT NULL GROUP BY r HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM interventions)""",
    "p1_clients": """
        WITH f AS (SELECT client_ip, min(ts) AS first_ts FROM http_transactions WHERE client_ip IS NOT NULL GROUP BY client_ip)
        SELECT t.client_ip, count(*) AS n_rows, count(*) FILTER (response_status >= 400) AS n_errors, min(f.first_ts) AS first_ts,
               count(*) FILTER (ts < f.first_ts + INTERVAL 1 HOUR) AS n_first_hour
        FROM http_transactions t JOIN f ON t.client_ip = f.client_ip GROUP BY t.client_ip""",
    "p1_rules": """
        WITH i AS (SELECT unnest(list_distinct(rule_ids)) AS rule_id, drop_connection FROM interventions),
             r AS (SELECT rule_id, max(severity) AS severity FROM rules GROUP BY rule_id)
        SELECT i.rule_id, count(*) AS n_rows, count(*) FILTER (drop_connection) AS n_dropped, max(r.severity) AS severity
        FROM i LEFT JOIN r ON i.rule_id = r.rule_id WHERE i.rule_id IS NOT NULL GROUP BY i.rule_id""",
    "p3_found": """
        SELECT 'uri' AS field, uri AS key_text FROM http_transactions WHERE uri IS NOT NULL
        GROUP BY uri HAVING count(*) * 100 >= (SELECT count(*) FROM http_transactions)
        UNION ALL
        SELECT 'client_ip', client_ip FROM http_transactions WHERE client_ip IS NOT NULL
        GROUP BY client_ip HAVING count(*) * 100 >= (SELECT count(*) FROM http_transactions)""",
    "p3_frequent": """
        SELECT 'uri' AS field, uri AS key_text, count(*) AS n FROM http_transactions WHERE uri IS NOT NULL
        GROUP BY uri HAVING count(*) * 500 >= (SELECT count(*) FROM http_transactions)
        UNION ALL
        SELECT 'client_ip', client_ip, count(*) FROM http_transactions WHERE client_ip IS NOT NULL
        GROUP BY client_ip HAVING count(*) * 500 >= (SELECT count(*) FROM http_transactions)""",
}
