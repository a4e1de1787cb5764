"""Rule sets over tables of transactions.

Whether a rule matches is an expression of the row, unless it reads the TX variables rules set. A phase's
rules that only match and stop reduce to the first stopping one; with flow control, TX variables or
chains the phase is an ordered fold over the rules that match or may matter unmatched, as an aggregate
over their numbers. Rows never meet: no
phase shuffles.

Where many rules read the same texts, the texts a rule's operator needs are looked for first: one trie
over those of all rules, then one for every few rules, and a rule itself is tried only where its own hit.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import any_of
from ..functions.requests import Request, scalar_selected, selected
from ..functions.transformations import apply_transformations, native_only, transformation
from ..operators.predicates import Predicate, integer, predicate, quoted
from ..seclang.parser import COLLECTIONS, SCALARS
from ..seclang.ruleset import Rule, Ruleset, is_allow, is_terminal, outcome_status

#: TX variables of the scores, those loaded from TX first.
SCORES = ["anomaly_score", "sql_injection_score", "xss_score", "rfi_score", "lfi_score", "rce_score", "php_injection_score", "session_fixation_score"]
LOADED = SCORES[:3]
STATE, STEPS, SOME, SHARED, GUARD = "__state", "__steps", "__some", "__shared_", "__guard_"
#: Rules from which texts get a guard, and rules of one of its parts.
GUARDED, PART = 8, 16
METADATA = "struct<id:string,msg:string,logdata:string,severity:int,tags:array<string>,maturity:int,accuracy:int,rev:string,ver:string>"
INTERVENTION = f"struct<status:int,url:string,log:string,rule_ids:array<string>,phase:int,drop_connection:boolean,metadata:array<{METADATA}>>"
_OPS = "array<struct<key:string,kind:string,text:string,n:bigint>>"
_RULE = f"array<struct<i:int,id:string,chain:boolean,closes:boolean,opens:boolean,jump:int,ops:{_OPS},stop:int>>"
_STATE = {"stop": "int", "allowed": "boolean", "tx": "map<string,string>", "scores": "array<int>", "hits": "array<string>"}


def _constant(value: object, kind: str) -> Column:
    """A nested literal; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


class Evaluator:
    """Plans a rule set. ``observed`` shows rules the address, port and status columns."""

    def __init__(self, ruleset: Ruleset, observed: bool = False):
        self.ruleset, self.observed = ruleset, observed
        self._all = [r for p in range(1, 6) for r in ruleset.phases[p]]
        self._texts = {s.value for r in self._all for s in r.setvars if s.kind == "set"}

    # Matching

    @staticmethod
    def _share(df: DataFrame, request: Request, rules: list[Rule]) -> tuple[DataFrame, dict]:
        """``df`` with a column for every variable's transformed texts that several rules read or Python makes, and where they are."""
        uses = Counter((v, r.transformations) for r in rules for v in dict.fromkeys(r.variables) if v.name != "TX" and (v.name in COLLECTIONS or scalar_selected(v)))
        wanted = [k for k, n in uses.items() if k[1] and (n > 1 or not native_only(k[1])) or not k[1] and n >= GUARDED and k[0].name in COLLECTIONS]
        columns = {}
        for i, (v, names) in enumerate(wanted):
            if v.name in SCALARS:
                columns[f"{SHARED}{i}"] = apply_transformations(request.scalar(v.name), names)
            else:
                columns[f"{SHARED}{i}"] = apply_transformations(F.transform(selected(request.collection(v.name), v), lambda x: x["value"]), names, many=True)
        return df.withColumns(columns) if columns else df, {k: F.col(f"{SHARED}{i}") for i, k in enumerate(wanted)}

    @staticmethod
    def _guard(df: DataFrame, request: Request, rules: list[Rule], shared: dict) -> tuple[DataFrame, dict[tuple, str], dict[int, list[str]]]:
        """``df`` with a column for all texts that many rules read: for each few rules whether a text holds what one of them needs; null where none does.

        Also the test of every (rule, variable) that has one, as SQL text (one parse is much faster than an object for
        every part of so many), and for rules that only texts with a guard can satisfy the names of these columns.
        """
        readers: dict[tuple, list[int]] = {}
        for i, r in enumerate(rules):
            p = predicate(r.operator)
            if p.needs and p.sql and not r.operator.negated:
                for v in dict.fromkeys(r.variables):
                    if v.name in COLLECTIONS and v.name != "TX" or v.name in SCALARS and scalar_selected(v):
                        readers.setdefault((v, r.transformations), []).append(i)
        readers = {k: own for k, own in readers.items() if len(own) >= GUARDED}
        texts, columns, tests, where = {}, {}, {}, {}
        for n, ((v, names), own) in enumerate(readers.items()):
            if (v, names) not in shared and v.name in COLLECTIONS:
                continue
            at, name = f"{GUARD}text{n}", f"{GUARD}{n}"
            texts[at] = shared[v, names] if (v, names) in shared else apply_transformations(request.scalar(v.name), names)
            test = (lambda t, at=at: t(at)) if v.name in SCALARS else (lambda t, at=at: f"exists({at}, x -> {t('x')})")
            # Unicode case, as patterns may ignore it.
            holds = lambda some, test=test: test(lambda x: f"{x} RLIKE {quoted(any_of(some, '(?iu)'))}")
            needs = [predicate(rules[i].operator).needs for i in own]
            parts = [holds(frozenset().union(*needs[k : k + PART])) for k in range(0, len(own), PART)]
            columns[name] = F.expr(f"CASE WHEN {holds(frozenset().union(*needs))} THEN array({', '.join(parts)}) END")
            for k, i in enumerate(own):
                tests[i, v] = f"CASE WHEN get({name}, {k // PART}) THEN {test(predicate(rules[i].operator).sql)} ELSE false END"
                where.setdefault(i, []).append(name)
        least = {i: names for i, names in where.items() if len(names) == len(set(rules[i].variables))}
        return df.withColumns(texts).withColumns(columns) if columns else df, tests, least

    @staticmethod
    def _match(request: Request, rule: Rule, shared: dict, flags: dict, tests: dict) -> tuple[Column, Column | None]:
        """Whether any value outside TX satisfies the rule, and whether there is a value (None: always).

        ``shared`` has transformed texts, ``flags`` what Python said of them for earlier rules of the phase,
        ``tests`` by variable SQL text of the rule's test where there is one.
        """
        p, neg, names = predicate(rule.operator), rule.operator.negated, rule.transformations
        sign = lambda hit: ~hit if neg else hit
        hits: list[Column] = []
        some: list[Column] = []
        always = False
        for v in rule.variables:
            ready = shared.get((v, names))
            asked = (v, names, rule.operator.name, rule.operator.argument)
            if v.name in SCALARS:
                if not scalar_selected(v):
                    continue
                always = True
                if p.constant is not None:
                    hits.append(F.lit(p.constant != neg))
                    continue
                if v in tests:
                    hits.append(F.expr(tests[v]))
                    continue
                text = apply_transformations(request.scalar(v.name), names) if ready is None else ready
                if not p.test and asked not in flags:
                    flags[asked] = p.single(text)
                hits.append(sign(p.test(text) if p.test else flags[asked]))
            elif v.name in COLLECTIONS and v.name != "TX":
                pairs = selected(request.collection(v.name), v)
                some.append(F.size(pairs) > 0)
                if v in tests:
                    hits.append(F.expr(tests[v]))
                elif p.constant is not None:
                    hits.append(F.size(pairs) > 0 if p.constant != neg else F.lit(False))
                elif p.test and ready is None:  # then the pipeline is native
                    hits.append(F.exists(pairs, lambda x: sign(p.test(apply_transformations(x["value"], names)))))
                else:
                    texts = F.transform(pairs, lambda x: x["value"]) if ready is None and not names else ready
                    if texts is None:
                        texts = apply_transformations(F.transform(pairs, lambda x: x["value"]), names, many=True)
                    if not p.test and asked not in flags:
                        flags[asked] = p.many(texts)
                    hits.append(F.exists(texts, lambda t: sign(p.test(t))) if p.test else F.exists(flags[asked], sign))
        return _or(hits), None if always else _or(some)

    def _tx_match(self, rule: Rule, tx: Column) -> tuple[Column, Column]:
        """The same for the rule's TX values, inside the fold, where no Python can run.

        TX holds what rules set: constant texts and sums. If a transformation or the operator needs
        Python, the answers for the constants are worked out beforehand; of sums, which Python's
        decoders leave alone and its detectors don't mind, only the expressions' part is taken.
        """
        p, neg = predicate(rule.operator), rule.operator.negated
        native = tuple(n for n in rule.transformations if transformation(n).native)
        direct = lambda v: p.test(apply_transformations(v, native)) if p.test else F.lit(False)
        known = {} if p.test and native == rule.transformations else self._known(rule, p)

        def hit(v: Column) -> Column:
            got = direct(v)
            for answer in (True, False):
                if texts := [t for t, a in known.items() if a is answer]:
                    got = F.when(v.isin(texts), F.lit(answer)).otherwise(got)
            return ~got if neg else got

        hits, some = [], []
        for var in rule.variables:
            if var.name == "TX":
                entries = F.transform(F.map_entries(tx), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
                pairs = selected(entries, var)
                some.append(F.size(pairs) > 0)
                hits.append(F.exists(pairs, lambda x: hit(x["value"])))
        return _or(hits), _or(some)

    def _known(self, rule: Rule, p: Predicate) -> dict[str, bool]:
        """Whether each text that rules set satisfies a rule's operator after its transformations (one row a text)."""
        if not self._texts:
            return {}
        texts = self._spark.createDataFrame([(t,) for t in sorted(self._texts)], "t string")
        out = apply_transformations(F.col("t"), rule.transformations)
        return {r[0]: bool(r[1]) for r in texts.select("t", p.test(out) if p.test else p.single(out)).collect()}

    # A phase

    def _jump(self, rule: Rule, phase: int, i: int, n: int) -> int:
        """Where evaluation goes on after a match."""
        if rule.flow == "skip":
            return min(n, i + 1 + rule.flow_value)
        if rule.flow == "skipafter":
            at = self.ruleset.markers.get(rule.flow_value)
            return min(n, at[1]) if at and at[0] == phase and at[1] > i + 1 else n
        return i + 1

    def _stops(self, rule: Rule) -> str | None:
        return rule.disruptive if is_allow(rule) or is_terminal(rule) and self.ruleset.mode == "On" else None

    def _phase(self, df: DataFrame, phase: int, invoked: Column) -> DataFrame:
        rules = self.ruleset.phases[phase]
        if not rules or self.ruleset.mode == "Off":
            return df
        request = Request(df, phase, self.observed)
        base = sum(len(self.ruleset.phases[q]) for q in range(1, phase))
        tx_rules = {i: r for i, r in enumerate(rules) if any(v.name == "TX" for v in r.variables)}
        chained = any(r.is_chain and self._jump(r, phase, i, len(rules)) != i + 1 for i, r in enumerate(rules))
        df, shared = self._share(df, request, rules)
        df, tests, narrow = self._guard(df, request, rules, shared)
        flags: dict = {}
        steps, late, filled = [], [], {}
        for i, r in enumerate(rules):
            # A rule that misses is a step only where a miss can matter: in a chain, or if TX may make it match.
            stays = i in tx_rules or chained or (i > 0 and rules[i - 1].is_chain)
            own = {v: tests[i, v] for v in r.variables if (i, v) in tests}
            if i in narrow and not stays:
                late.append(f"CASE WHEN {' OR '.join(own.values())} THEN {2 * i + 1} END")
                continue
            hit, some = self._match(request, r, shared, flags, own)
            if i in tx_rules:
                filled[i] = F.lit(True) if some is None else some
            elif some is not None and r.operator.negated and r.variables:
                hit = hit | ~some
            step = F.when(F.coalesce(hit, F.lit(False)), F.lit(2 * i + 1))
            steps.append(step.otherwise(F.lit(2 * i)) if stays else step)
        all_steps = F.array_compact(F.array(*steps)) if steps else F.expr("cast(array() as array<int>)")
        if late:  # nothing of them is looked at in rows without any guard's hit
            open_ = _or([F.col(c).isNotNull() for c in dict.fromkeys(c for names in narrow.values() for c in names)])
            more = F.when(open_, F.array_sort(F.concat(all_steps, F.expr(f"array_compact(array({', '.join(late)}))"))))
            all_steps = F.coalesce(more, all_steps)
        df = df.withColumn(STEPS, all_steps)
        if filled:
            df = df.withColumn(SOME, F.array(*[F.coalesce(c, F.lit(False)) for c in filled.values()]))
        going = invoked & (F.col(STATE)["stop"] < 0) & ~F.col(STATE)["allowed"]
        plain = not tx_rules and not any(r.flow or r.setvars for r in rules)
        after = self._plain(rules, base) if plain else self._fold(rules, phase, base, tx_rules, list(filled))
        return df.withColumn(STATE, F.when(going, after).otherwise(F.col(STATE))).drop(STEPS, SOME, *[c for c in df.columns if c.startswith((SHARED, GUARD))])

    def _plain(self, rules: list[Rule], base: int) -> Column:
        """Rules that only match and stop: hits up to the first that stops. Every step is a match here."""
        s, n = F.col(STATE), len(rules)
        stopping = [(i, self._stops(r)) for i, r in enumerate(rules) if self._stops(r)]
        matched = F.transform(STEPS, lambda x: F.floor(x / 2).cast("int"))
        first = F.coalesce(F.array_min(F.filter(matched, lambda i: i.isin([i for i, _ in stopping]))), F.lit(n)) if stopping else F.lit(n)
        ids = _constant([r.id for r in rules], "array<string>")
        hits = F.array_compact(F.transform(F.filter(matched, lambda i: i <= first), lambda i: F.get(ids, i)))
        allows = [i for i, k in stopping if k == "allow"]
        allowed = first.isin(allows) if allows else F.lit(False)
        blocked = (first < n) & ~allowed
        return F.struct(
            F.when(blocked, first + base).otherwise(F.lit(-1)).cast("int").alias("stop"), allowed.alias("allowed"),
            F.when(first < n, s["tx"]).otherwise(_synced(s["tx"], s["scores"])).alias("tx"), s["scores"].alias("scores"),
            F.concat(s["hits"], hits).alias("hits"))

    def _fold(self, rules: list[Rule], phase: int, base: int, tx_rules: dict[int, Rule], filled: list[int]) -> Column:
        n, s = len(rules), F.col(STATE)
        table = _constant([{
            "i": i, "id": r.id, "chain": r.is_chain, "closes": not r.is_chain and r.chain_next is None, "opens": r.flow == "chain",
            "jump": self._jump(r, phase, i, n), "stop": {None: 0, "allow": 2}.get(self._stops(r), 1),
            "ops": [{"key": o.key, "kind": o.kind, "text": str(o.value), "n": o.value if o.kind == "add" else 0} for o in r.setvars],
        } for i, r in enumerate(rules)], _RULE)
        steps = F.transform(F.col(STEPS), lambda x: F.struct(
            F.get(table, F.floor(x / 2).cast("int")).alias("r"), (x % 2 == 1).alias("m"), (F.col(SOME) if filled else F.lit(None)).alias("some")))

        def merge(acc: Column, x: Column) -> Column:
            r = x["r"]
            matched = x["m"]
            for i, rule in tx_rules.items():
                hit, has = self._tx_match(rule, acc["tx"])
                full = hit | x["m"]
                if rule.operator.negated:
                    full = full | ~(has | F.get(x["some"], F.lit(filled.index(i))))
                matched = F.when(r["i"] == i, full).otherwise(matched)
            matched = F.coalesce(matched, F.lit(False))
            idle = acc["done"] | (r["i"] < acc["jump"])
            broken = acc["inside"] & r["closes"] & ~acc["linked"]
            put = lambda name, value: value.alias(name)
            same = lambda *names: [put(k, acc[k]) for k in names]
            closed = F.struct(*same("stop", "allowed", "tx", "scores", "hits", "done", "jump"), put("inside", F.lit(False)), put("linked", F.lit(False)))
            vars_ = F.aggregate(r["ops"], F.struct(*same("tx", "scores")), _setvar)
            opened = acc["inside"] | r["opens"]
            hit = _let(vars_, lambda now: F.struct(
                put("stop", F.when(r["stop"] == 1, r["i"] + base).otherwise(acc["stop"])), put("allowed", acc["allowed"] | (r["stop"] == 2)),
                put("tx", now["tx"]), put("scores", now["scores"]),
                put("hits", F.when(r["id"].isNull(), acc["hits"]).otherwise(F.array_append(acc["hits"], r["id"]))),
                put("done", r["stop"] > 0), put("jump", r["jump"]),
                put("inside", opened & r["chain"]), put("linked", r["chain"] & F.when(acc["inside"], acc["linked"]).otherwise(r["opens"]))))
            miss = F.struct(
                *same("stop", "allowed", "tx", "scores", "hits", "done", "jump"), put("inside", acc["inside"] & r["chain"]), put("linked", F.lit(False)))
            return F.when(idle, acc).when(broken, closed).when(matched, hit).otherwise(miss)

        start = F.struct(
            *[s[k].alias(k) for k in _STATE], F.lit(False).alias("done"), F.lit(0).alias("jump"), F.lit(False).alias("inside"), F.lit(False).alias("linked"))
        return F.aggregate(steps, start, merge, lambda acc: F.struct(
            acc["stop"].alias("stop"), acc["allowed"].alias("allowed"),
            F.when(acc["done"], acc["tx"]).otherwise(_synced(acc["tx"], acc["scores"])).alias("tx"), acc["scores"].alias("scores"), acc["hits"].alias("hits")))

    # The whole

    def interventions(self) -> list[dict]:
        """The intervention of every rule, in the order of phases and rules. The blocking rule's id stands in ``rule_ids`` twice."""
        out = []
        for p in range(1, 6):
            for r in self.ruleset.phases[p]:
                m = r.metadata
                status = outcome_status(r, self.ruleset.default_status)
                out.append({
                    "status": status, "url": r.redirect, "log": m.msg, "rule_ids": [r.id] * 2 if r.id else [], "phase": p, "drop_connection": r.disruptive == "drop",
                    "metadata": [{**m.__dict__, "tags": list(m.tags)}]})
        return out

    def evaluate(self, df: DataFrame, phases: tuple[int, ...] = (1, 2, 3, 4, 5), carried: str | None = None, called: str | None = None) -> DataFrame:
        """``df`` with matched_rules, intervention, allowed, anomaly_score and tx (replacing columns of these names).

        Phase 2 runs for rows whose has_request_body_phase is true (for all, if the column is absent);
        other phases for all rows. Repeated rows get the same verdict each; an empty table stays empty.
        ``called`` names an array of the phases to run for a row instead. With ``carried``, evaluation goes on from
        the state of that name (null: from the beginning), and the column holds the new state.
        """
        self._spark = df.sparkSession
        new = ("matched_rules", "intervention", "allowed", "anomaly_score", "tx")
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
        empty = {"stop": F.lit(-1), "allowed": F.lit(False), "tx": F.expr("cast(map() as map<string,string>)"), "scores": F.array(*[F.lit(0)] * len(LOADED)),
                 "hits": F.expr("cast(array() as array<string>)")}
        used = {v.name for p in phases for r in self.ruleset.phases[p] for v in r.variables}
        start = F.struct(*[empty[k].cast(t).alias(k) for k, t in _STATE.items()])
        out = Request.prepared(df, used).withColumn(STATE, F.coalesce(F.col(carried), start) if carried else start)
        for p in phases:
            if called:
                invoked = F.coalesce(F.array_contains(called, p), F.lit(False))
            else:
                invoked = F.coalesce(F.col("has_request_body_phase"), F.lit(False)) if p == 2 and "has_request_body_phase" in df.columns else F.lit(True)
            out = self._phase(out, p, invoked)
        s = F.col(STATE)
        verdict = F.get(_constant(self.interventions(), f"array<{INTERVENTION}>"), F.when(s["stop"] >= 0, s["stop"]))
        return out.select(
            *[s.alias(c) if c == carried else F.col(f"`{c}`") for c in df.columns], s["hits"].alias("matched_rules"), verdict.alias("intervention"), s["allowed"].alias("allowed"),
            F.get(s["scores"], F.lit(0)).alias("anomaly_score"), s["tx"].alias("tx"))


#: Type of the state that ``evaluate`` carries.
STATE_TYPE = "struct<" + ",".join(f"{k}:{t}" for k, t in _STATE.items()) + ">"


def _put(tx: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(tx, lambda k, v: k != key), F.create_map(key, value))


def _synced(tx: Column, scores: Column) -> Column:
    """TX with the counters written over its score entries; counters no rule loads are 0."""
    values = [F.get(scores, F.lit(i)).cast("string") if i < len(LOADED) else F.lit("0") for i in range(len(SCORES))]
    pairs = [x for k, v in zip(SCORES, values) for x in (F.lit(k), v)]
    return F.map_concat(F.map_filter(tx, lambda k, v: ~k.isin(SCORES)), F.create_map(*pairs))


def _counter(tx: Column, key: str, was: Column) -> Column:
    """A counter as TX has it now: 0 if that is no 32-bit integer, unchanged if TX lacks it."""
    v = F.try_element_at(tx, F.lit(key))
    n = integer(v)
    return F.when(v.isNull(), was).otherwise(F.when(n.between(-(1 << 31), (1 << 31) - 1), n).otherwise(0)).cast("int")


def _setvar(acc: Column, op: Column) -> Column:
    tx, scores = acc["tx"], acc["scores"]
    total = (F.coalesce(integer(F.try_element_at(tx, op["key"])), F.lit(0)) + op["n"]).cast("string")
    new = F.when(op["kind"] == "delete", F.map_filter(tx, lambda k, v: k != op["key"])).otherwise(
        _put(tx, op["key"], F.when(op["kind"] == "add", total).otherwise(op["text"])))
    loaded = lambda now: F.array(*[_counter(now, k, F.get(scores, F.lit(i))) for i, k in enumerate(LOADED)])
    return _let(new, lambda now: F.struct(now.alias("tx"), F.when(op["key"] == LOADED[0], loaded(now)).otherwise(scores).alias("scores")))


def intervention(status: int = 403, phase: int = 1, url: str | None = None, log: str | None = None, rule_ids: tuple[str, ...] = (), drop_connection: bool = False) -> Column:
    """An intervention of given parts. A URL makes it a redirect (302), dropping the connection a 444."""
    status = 444 if drop_connection else 302 if url is not None else status
    return _constant({"status": status, "url": url, "log": log, "rule_ids": list(rule_ids), "phase": phase, "drop_connection": drop_connection, "metadata": []}, INTERVENTION)


def format_log(intervention: Column) -> Column:
    """``[status N] [rule_ids: a, b] [msg: …] [redirect: …] [phase: NAME]``, present parts only; null for no intervention."""
    from ..seclang.ruleset import PHASES

    part = lambda name, c: F.concat(F.lit(f"[{name}"), c, F.lit("]"))
    i = intervention
    ids = F.when(F.size(i["rule_ids"]) > 0, part("rule_ids: ", F.array_join(i["rule_ids"], ", ")))
    phase = F.get(F.array(*map(F.lit, PHASES)), i["phase"] - 1)
    return F.when(i.isNotNull(), F.concat_ws(
        " ", part("status ", i["status"].cast("string")), ids, part("msg: ", i["log"]), part("redirect: ", i["url"]), part("phase: ", phase)))


def expand_macros(text: Column, tx: Column, matched_var: Column | None = None, matched_var_name: Column | None = None) -> Column:
    """``%{TX.name}`` by the value in ``tx`` ('' if absent), ``%{MATCHED_VAR}`` and ``%{MATCHED_VAR_NAME}`` by those given."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"%\{TX\.([^}]+)\}"), F.lit(1)))
    out = F.aggregate(names, text, lambda acc, k: F.replace(acc, F.concat(F.lit("%{TX."), k, F.lit("}")), F.coalesce(F.try_element_at(tx, k), F.lit(""))))
    for name, value in (("%{MATCHED_VAR}", matched_var), ("%{MATCHED_VAR_NAME}", matched_var_name)):
        if value is not None:
            out = F.replace(out, F.lit(name), F.coalesce(value, F.lit("")))
    return out
