"""Variables of rules as expressions over a table of transactions.

The table has the columns of ``TRANSACTION``; of those a rule set does not use, any may be absent. Texts
become visible with the phase that brings them: the request body and its arguments with 2, response
headers with 3, the response body with 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seclang.ast import Variable
from ..seclang.parser import SCALARS
from .regex import BadPattern, compiles, to_java

PAIRS = "array<struct<name:string,value:string>>"
#: Prefix of prepared columns.
READY = "__ready_"
TRANSACTION = (
    f"tx_id bigint, ts timestamp, method string, uri string, protocol string, request_headers {PAIRS}, request_body binary, "
    f"has_request_body_phase boolean, response_status int, response_headers {PAIRS}, response_body binary, client_ip string, client_port int, "
    "server_name string, server_port int")


def path(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def query_string(uri: Column) -> Column:
    """What follows the first question mark, else ''."""
    at = F.instr(uri, "?")
    return F.when(at > 0, F.substr(uri, at + 1)).otherwise("")


def percent_decode(v: Column) -> Column:
    """Plus signs and malformed codes kept, bytes that are no UTF-8 replaced."""
    plain = F.replace(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(v, F.lit("%")), F.coalesce(F.try_url_decode(plain), v)).otherwise(v)


def _pair(p: Column) -> Column:
    at = F.instr(p, "=")
    return F.struct(
        percent_decode(F.when(at > 0, F.substring_index(p, "=", 1)).otherwise(p)).alias("name"),
        percent_decode(F.when(at > 0, F.substr(p, at + 1)).otherwise("")).alias("value"))


def arguments(query: Column) -> Column:
    """Decoded name and value of every non-empty pair; one without ``=`` has the value ''."""
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), _pair)


def form_arguments(body: Column) -> Column:
    """The same of a form body, pairs without ``=`` left out."""
    return F.transform(F.filter(F.split(body, "&"), lambda p: F.contains(p, F.lit("="))), _pair)


def lossy(binary: Column) -> Column:
    return F.coalesce(F.make_valid_utf8(binary.cast("string")), F.lit(""))


def _pairs(c: Column) -> Column:
    return F.coalesce(F.filter(c, lambda x: x["name"].isNotNull()), F.expr(f"cast(array() as {PAIRS})"))


def _headers(c: Column) -> Column:
    return F.transform(_pairs(c), lambda x: F.struct(F.lower(x["name"]).alias("name"), F.coalesce(x["value"], F.lit("")).alias("value")))


class Request:
    """The variables of ``df``'s rows as of one phase. Nulls read as '' (or no values); a missing column likewise.

    ``observed`` makes address, port and status variables show their columns; without it they are '' and '0'.
    """

    def __init__(self, df: DataFrame, phase: int, observed: bool = False):
        self._df, self._phase, self._observed = df, phase, observed

    @staticmethod
    def prepared(df: DataFrame, names: set[str]) -> DataFrame:
        """``df`` with the collections of ``names`` as columns, so that expressions which use them more than once share them."""
        late = Request(df, 5)
        parts = {"ARGS_GET": {"ARGS", "ARGS_GET"}, "ARGS_POST": {"ARGS", "ARGS_POST"}, "REQUEST_HEADERS": {"REQUEST_HEADERS"}, "RESPONSE_HEADERS": {"RESPONSE_HEADERS", "RESPONSE_CONTENT_TYPE"}}
        return df.withColumns({READY + part: late.collection(part) for part, users in parts.items() if users & names})

    def _ready(self, part: str) -> Column | None:
        return self._df[READY + part] if READY + part in self._df.columns else None

    def _col(self, name: str, kind: str) -> Column:
        c = self._df[name] if name in self._df.columns else F.lit(None)
        return c.cast(kind)

    def _text(self, name: str) -> Column:
        return F.coalesce(self._col(name, "string"), F.lit(""))

    def _seen(self, name: str) -> Column | None:
        """A body once its phase has come, else None."""
        if self._phase < (2 if name == "request_body" else 4):
            return None
        c = self._col(name, "binary")
        return F.when(self._col("has_request_body_phase", "boolean"), c) if name == "request_body" and "has_request_body_phase" in self._df.columns else c

    def _body(self, name: str) -> Column:
        seen = self._seen(name)
        return F.lit("") if seen is None else lossy(seen)

    def _number(self, name: str) -> Column:
        return F.coalesce(self._col(name, "string"), F.lit("0")) if self._observed else F.lit("0")

    def scalar(self, name: str) -> Column:
        uri = self._text("uri")
        match name:
            case "REQUEST_URI" | "REQUEST_URI_RAW":
                return uri
            case "REQUEST_METHOD":
                return self._text("method")
            case "REQUEST_PROTOCOL":
                return self._text("protocol")
            case "QUERY_STRING":
                return query_string(uri)
            case "REQUEST_FILENAME":
                return path(uri)
            case "REQUEST_BODY":
                return self._body("request_body")
            case "REQUEST_BODY_LENGTH":
                seen = self._seen("request_body")
                return F.lit("0") if seen is None else F.coalesce(F.octet_length(seen), F.lit(0)).cast("string")
            case "RESPONSE_BODY":
                return self._body("response_body")
            case "RESPONSE_CONTENT_TYPE":
                return F.coalesce(F.try_element_at(F.filter(self.collection("RESPONSE_HEADERS"), lambda h: h["name"] == "content-type"), F.lit(-1))["value"], F.lit(""))
            case "RESPONSE_STATUS":
                return self._number("response_status")
            case "REMOTE_PORT":
                return self._number("client_port")
            case "SERVER_PORT":
                return self._number("server_port")
            case "REMOTE_ADDR" | "SERVER_NAME":
                return self._text("client_ip" if name == "REMOTE_ADDR" else "server_name") if self._observed else F.lit("")
        raise KeyError(name)

    def collection(self, name: str) -> Column:
        """Pairs of name and value; of variables without a source none."""
        none = F.expr(f"cast(array() as {PAIRS})")
        seen = self._seen("request_body")
        if name == "ARGS":
            get = self.collection("ARGS_GET")
            return get if seen is None else F.concat(get, self.collection("ARGS_POST"))
        if name == "ARGS_POST" and seen is None or name == "RESPONSE_HEADERS" and self._phase < 3:
            return none
        if (ready := self._ready(name)) is not None:
            return ready
        match name:
            case "ARGS_GET":
                return arguments(query_string(self._text("uri")))
            case "ARGS_POST":
                return F.coalesce(form_arguments(lossy(seen)), none)
            case "REQUEST_HEADERS":
                return _headers(self._col("request_headers", PAIRS))
            case "RESPONSE_HEADERS":
                return _headers(self._col("response_headers", PAIRS))
        return none


def selected(pairs: Column, v: Variable) -> Column:
    """The pairs a variable selects, less its exclusions, whose text the full name must not contain."""
    if v.key is not None:
        pairs = F.filter(pairs, lambda x: x["name"] == v.key)
    if v.pattern is not None:
        try:
            java = to_java(v.pattern)
            pairs = F.filter(pairs, (lambda x: x["name"].rlike(java)) if compiles(java) else (lambda x: F.lit(False)))
        except BadPattern:
            return F.filter(pairs, lambda x: F.lit(False))
    for text in v.excluded:
        pairs = F.filter(pairs, _lacks(v.name, text))
    return pairs


def _lacks(variable: str, text: str):
    return lambda x: ~F.contains(F.concat(F.lit(variable + ":"), x["name"]), F.lit(text))


def scalar_selected(v: Variable) -> bool:
    """Whether a variable's one text stays; selections of such variables have no effect."""
    return v.name in SCALARS and not any(e in v.name for e in v.excluded)


def resolved(df: DataFrame, v: Variable, phase: int = 5, observed: bool = False) -> Column:
    """A variable as array of struct(full_name, value)."""
    request = Request(df, phase, observed)
    if v.name in SCALARS:
        kept = F.array(F.struct(F.lit(v.name).alias("full_name"), request.scalar(v.name).alias("value")))
        return kept if scalar_selected(v) else F.filter(kept, lambda x: F.lit(False))
    return F.transform(selected(request.collection(v.name), v), lambda x: F.struct(F.concat(F.lit(v.name + ":"), x["name"]).alias("full_name"), x["value"].alias("value")))


def count(pairs: Column) -> Column:
    """Values of a collection, over all its names."""
    return F.size(pairs)


def count_key(pairs: Column, key: str) -> Column:
    """Values of one name."""
    return F.size(F.filter(pairs, lambda x: x["name"] == key))
