"""Queries of the text operators over the tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import percent_decode
from ..sources import table
from . import language, leakage, lookalike, mixing

#: Most terms that are looked for at once; they are sent to every task.
MOST_TERMS = 100_000


def _reader(spark: SparkSession, d: str) -> lookalike.Reader:
    """Letter bigrams of the clean sentences and the terms themselves."""
    return lookalike.fit_reader(F.col("text"), F.col("term"), frames=[table(spark, d, "lang_samples"), table(spark, d, "watch_terms")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Places of requests that show a watch term in other characters."""
    rows = table(spark, d, "watch_terms").where(F.col("term").isNotNull()).select("term_id", "term").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError("too many watch terms to send to every task")
    terms = lookalike.Terms(tuple(r[0] for r in rows), tuple(r[1] for r in rows))
    return lookalike.find_terms(lookalike.request_texts(table(spark, d, "http_transactions")), terms, _reader(spark, d))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """All path, argument and body texts of requests in their consistent form."""
    texts = lookalike.request_texts(table(spark, d, "http_transactions"))
    plain = F.when(F.col("coded"), percent_decode(F.col("text"))).otherwise(F.col("text"))
    return texts.select("tx_id", "field", lookalike.canonical(plain, _reader(spark, d)).alias("canonical"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with twelve consecutive words of a held-out item."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a held-out item's wording and other names or numbers."""
    return leakage.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their target share."""
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where(~F.col("reachable")).select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: every document used, with its number of uses."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _model(spark: SparkSession, d: str) -> language.LanguageModel:
    return language.fit(table(spark, d, "lang_samples"), table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of documents with several languages or a missing or wrong label."""
    return language.wrong_labels(table(spark, d, "documents"), _model(spark, d)).select("doc_id", "run_no", "lang")


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every one-language stretch of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return language.language_runs(docs, _model(spark, d)).withColumn("confidence", F.round("confidence", 4))


QUERIES = {f.__name__: f for f in (p4_found, p4_canonical, p6_found, p6_reparameterised, p7_found, p7_mix, p7_shares, p8_found, p8_runs)}
_WORDS = "SELECT {0} AS id, regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {1} WHERE text IS NOT NULL"
_WINDOWS = "SELECT id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) AS i FROM ({}) WHERE len(ws) >= 12)"
_UNITS = "('mm', 'cm', 'm', 'km', 'g', 'kg', 'mg', 't', 'l', 'ml', 'h', 'min', 's', 'eur', 'usd', 'gbp', 'c', 'f')"
SQL = {
    "p6_found": f"""
        SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({_WINDOWS.format(_WORDS.format("doc_id", "documents"))}) d
        JOIN ({_WINDOWS.format(_WORDS.format("item_id", "eval_items"))}) i ON d.g = i.g""",
    "p6_reparameterised": f"""
        WITH own AS (SELECT DISTINCT unnest(regexp_extract_all(replace(strip_accents(lower(r)), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')) AS w
                     FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS r FROM eval_items) WHERE regexp_matches(r, '^[\\p{{Ll}}\\p{{Lo}}]')),
             texts AS (SELECT 'd' AS kind, * FROM ({_WORDS.format("doc_id", "documents")}) UNION ALL SELECT 'i', * FROM ({_WORDS.format("item_id", "eval_items")})),
             ws AS (SELECT kind, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM texts),
             typed AS (SELECT kind, id, n, ws.w, CASE WHEN ws.w IN {_UNITS} THEN '%' WHEN own.w IS NOT NULL THEN '' WHEN regexp_matches(ws.w, '^\\p{{N}}+$') THEN '=' ELSE '~' END AS m
                       FROM ws LEFT JOIN own ON ws.w = own.w),
             starts AS (SELECT *, CASE WHEN m <> '' AND m = lag(m) OVER (PARTITION BY kind, id ORDER BY n) THEN 0 ELSE 1 END AS new FROM typed),
             runs AS (SELECT *, sum(new) OVER (PARTITION BY kind, id ORDER BY n) AS g FROM starts),
             tokens AS (SELECT kind, id, g, any_value(m) AS m, string_agg(m || w, ' ' ORDER BY n) AS f FROM runs GROUP BY kind, id, g),
             lists AS (SELECT kind, id, list(CASE WHEN m = '' THEN f ELSE m END ORDER BY g) AS t, list(f ORDER BY g) AS f FROM tokens GROUP BY kind, id),
             wins AS (SELECT kind, id, array_to_string(t[k:k + 11], ' ') AS h, list_filter(f[k:k + 11], lambda x: x[1] IN ('~', '=', '%')) AS slots
                      FROM (SELECT *, unnest(range(1, len(t) - 10)) AS k FROM lists WHERE len(t) >= 12)),
             met AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, h, i.slots AS i, d.slots AS d FROM (FROM wins WHERE kind = 'd' AND len(slots) <= 6) d
                     JOIN (FROM wins WHERE kind = 'i' AND len(slots) <= 6) i USING (h)),
             named AS (SELECT doc_id, item_id, h, i AS si, d AS sd, unnest(i) AS i, unnest(d) AS d FROM met),
             counted AS (SELECT doc_id, item_id, i, d, count(*) AS n FROM (SELECT DISTINCT * FROM named) WHERE starts_with(i, '~') GROUP BY ALL),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, i ORDER BY n DESC, d) AS a, row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY n DESC, i) AS b FROM counted),
             broken AS (SELECT DISTINCT doc_id, item_id, h, si, sd FROM named JOIN ranked USING (doc_id, item_id, i, d) WHERE a > 1 OR b > 1),
             kept AS (SELECT * FROM met WHERE (doc_id, item_id, h, i, d) NOT IN (SELECT (doc_id, item_id, h, si, sd) FROM broken))
        SELECT doc_id, item_id, count(DISTINCT (h, i)) AS windows, max(len(list_filter(range(1, len(i) + 1), lambda x: i[x] <> d[x])))::INTEGER AS changed
        FROM kept GROUP BY doc_id, item_id HAVING max(len(list_filter(range(1, len(i) + 1), lambda x: i[x] <> d[x]))) > 0""",
}
