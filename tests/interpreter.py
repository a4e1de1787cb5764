"""A row-at-a-time reading of rule sets, for comparison with the plans. Knows few operators and no Spark."""

import re

SCORES = ["anomaly_score", "sql_injection_score", "xss_score", "rfi_score", "lfi_score", "rce_score", "php_injection_score", "session_fixation_score"]


def number(text, bits=64):
    if text is None or not re.fullmatch(r"[+-]?[0-9]+", text):
        return None
    n = int(text)
    return n if -(1 << bits - 1) <= n < 1 << bits - 1 else None


def holds(op, value):
    arg = op.argument
    if op.name in ("eq", "ge", "lt"):
        a, b = number(value), number(arg)
        return a is not None and b is not None and {"eq": a == b, "ge": a >= b, "lt": a < b}[op.name]
    return {"contains": arg in value, "streq": arg == value, "unconditionalmatch": True, "nomatch": False, "within": value in arg.split()}[op.name]


def values(rule, row, tx):
    out = []
    for v in rule.variables:
        if v.name == "REQUEST_METHOD":
            found = [("REQUEST_METHOD", row["method"])]
        elif v.name == "REQUEST_URI":
            found = [("REQUEST_URI", row["uri"])]
        elif v.name in ("ARGS", "ARGS_GET"):
            query = row["uri"].partition("?")[2]
            found = [(f"{v.name}:{p.partition('=')[0]}", p.partition("=")[2]) for p in query.split("&") if p]
        elif v.name == "TX":
            found = [(f"TX:{k}", x) for k, x in tx.items()]
        else:
            found = []
        if v.key is not None and v.name in ("ARGS", "ARGS_GET", "TX"):
            found = [f for f in found if f[0] == f"{v.name}:{v.key}"]
        out += [x for name, x in found if not any(e in name for e in v.excluded)]
    return out


def matches(rule, row, tx):
    found = values(rule, row, tx)
    if not found:
        return rule.operator.negated if rule.variables else False
    low = "lowercase" in rule.transformations
    return any(holds(rule.operator, x.lower() if low else x) != rule.operator.negated for x in found)


class Row:
    """State of one transaction across phases."""

    def __init__(self, ruleset):
        self.rules, self.tx, self.scores, self.hits, self.stop, self.allowed = ruleset, {}, [0, 0, 0], [], None, False

    def setvar(self, o):
        if o.kind == "delete":
            self.tx.pop(o.key, None)
        elif o.kind == "add":
            self.tx[o.key] = str((number(self.tx.get(o.key)) or 0) + o.value)
        else:
            self.tx[o.key] = o.value
        if o.key == SCORES[0]:
            for i in range(3):
                if SCORES[i] in self.tx:
                    self.scores[i] = number(self.tx[SCORES[i]], 32) or 0

    def phase(self, phase, row):
        rules = self.rules.phases[phase]
        if self.stop or self.allowed or self.rules.mode == "Off" or not rules:
            return
        inside = linked = False
        skip, wanted, at = 0, None, 0
        while at < len(rules):
            if skip:
                skip, at = skip - 1, at + 1
                continue
            if wanted is not None:
                mark = self.rules.markers.get(wanted)
                if mark and mark[0] == phase and mark[1] > at:
                    at, wanted = mark[1], None
                else:
                    at += 1
                continue
            r = rules[at]
            if inside and not r.is_chain and r.chain_next is None and not linked:
                inside, at = False, at + 1
                continue
            if matches(r, row, self.tx):
                if r.id is not None:
                    self.hits.append(r.id)
                for o in r.setvars:
                    self.setvar(o)
                if r.flow == "chain" and not inside:
                    inside = linked = True
                skip = r.flow_value if r.flow == "skip" else 0
                wanted = r.flow_value if r.flow == "skipafter" else None
                if r.disruptive == "allow":
                    self.allowed = True
                    return
                if r.disruptive in ("deny", "block", "redirect", "drop") and self.rules.mode == "On":
                    self.stop = (phase, at)
                    return
            elif inside:
                linked = False
            if inside and not r.is_chain:
                inside = linked = False
            at += 1
        self.tx.update(zip(SCORES, [*map(str, self.scores), "0", "0", "0", "0", "0"]))
