"""Directives to rules by phase."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.transformations import pipeline
from .ast import Action, Directive, Operator, SetVar, Variable
from .errors import RuleError
from .parser import Parser, parse_operator, parse_variables

#: Names of the phases, from 1.
PHASES = ("REQUEST_HEADERS", "REQUEST_BODY", "RESPONSE_HEADERS", "RESPONSE_BODY", "LOGGING")


@dataclass(frozen=True)
class Metadata:
    id: str | None = None
    msg: str | None = None
    severity: int | None = None
    tags: tuple[str, ...] = ()
    maturity: int | None = None
    accuracy: int | None = None
    rev: str | None = None
    ver: str | None = None
    logdata: str | None = None

    def format_log(self) -> str:
        """``[id "…"] [msg "…"] [severity "…"] [tag "…"]… [rev "…"] [ver "…"]``, present parts only."""
        from .parser import SEVERITIES

        level = None if self.severity is None else SEVERITIES[min(self.severity, 7)].upper()
        parts = [("id", self.id), ("msg", self.msg), ("severity", level), *[("tag", t) for t in self.tags], ("rev", self.rev), ("ver", self.ver)]
        return " ".join(f'[{k} "{v}"]' for k, v in parts if v is not None)


@dataclass(frozen=True)
class Rule:
    """A rule ready for planning. ``variables`` is empty for actions without a condition, which match nothing."""

    phase: int
    variables: tuple[Variable, ...]
    operator: Operator
    transformations: tuple[str, ...] = ()
    metadata: Metadata = Metadata()
    disruptive: str | None = None
    redirect: str | None = None
    flow: str | None = None
    flow_value: object = None
    setvars: tuple[SetVar, ...] = ()
    is_chain: bool = False
    chain_next: int | None = None

    @property
    def id(self) -> str | None:
        return self.metadata.id


def is_terminal(rule: Rule) -> bool:
    """Whether a match ends the request with an intervention."""
    return rule.disruptive in ("deny", "block", "redirect", "drop")


def is_allow(rule: Rule) -> bool:
    """Whether a match ends evaluation without one."""
    return rule.disruptive == "allow"


def outcome_status(rule: Rule, default_status: int = 403) -> int:
    """The status a rule's disruptive action answers with; 200 where it lets the request pass."""
    return {"deny": 403, "block": default_status, "redirect": 302, "drop": 444}.get(rule.disruptive, 200)


def _values(actions: tuple[Action, ...], family: str, name: str | None = None) -> list:
    return [a.value for a in actions if a.family == family and (name is None or a.name == name)]


def rule_of(variables: tuple[Variable, ...], operator: Operator, actions: tuple[Action, ...], chained: bool = True) -> Rule:
    """A rule of parsed parts. First id and phase count, of other repeated metadata the last; all tags are kept."""
    meta = {a.name: a.value for a in actions if a.family == "metadata"}
    phases, ids = _values(actions, "metadata", "phase"), _values(actions, "metadata", "id")
    flows = [a for a in actions if a.family == "flow"]
    flow = flows[-1] if flows and flows[-1].name != "multimatch" else None
    stops = [a for a in actions if a.family == "disruptive"]
    keep = {k: meta.get(k) for k in ("msg", "severity", "maturity", "accuracy", "rev", "ver", "logdata")}
    return Rule(
        phase=phases[0] if phases and 1 <= phases[0] <= 5 else 2, variables=variables, operator=operator,
        transformations=pipeline(_values(actions, "transformation")),
        metadata=Metadata(id=ids[-1] if ids else None, tags=tuple(_values(actions, "metadata", "tag")), **keep),
        disruptive=stops[-1].name if stops else None, redirect=stops[-1].value if stops and stops[-1].name == "redirect" else None,
        flow=flow.name if flow else None, flow_value=flow.value if flow else None,
        setvars=tuple(_values(actions, "data", "setvar")), is_chain=chained and any(a.name == "chain" for a in flows))


@dataclass
class Ruleset:
    """Rules by phase (1 to 5), marker positions, and whether the engine blocks."""

    phases: dict[int, list[Rule]] = field(default_factory=lambda: {p: [] for p in range(1, 6)})
    markers: dict[str, tuple[int, int]] = field(default_factory=dict)
    mode: str = "On"
    default_status: int = 403

    @classmethod
    def from_string(cls, text: str, **options) -> Ruleset:
        return cls.compile(Parser().text(text).directives, **options)

    @classmethod
    def from_file(cls, path: str, **options) -> Ruleset:
        return cls.compile(Parser().file(path).directives, **options)

    @classmethod
    def from_glob(cls, pattern: str, **options) -> Ruleset:
        return cls.compile(Parser().glob(pattern).directives, **options)

    @classmethod
    def from_remote(cls, spark, path: str, **options) -> Ruleset:
        """Files (or a pattern of them) that only Spark's file systems reach, in the order of their paths."""
        from pyspark.sql import functions as F

        parser = Parser()
        for name, text in spark.read.text(path, wholetext=True).select(F.input_file_name(), "value").sort(F.input_file_name()).collect():
            parser.text(text, name)
        return cls.compile(parser.directives, **options)

    @classmethod
    def from_frame(cls, rules, skip_unusable: bool = False, **options) -> Ruleset:
        """A table of rules in its columns rule_id, phase, op_name, argument, variables, transformations, severity, msg, tags and is_chain.

        Rules match and count; they stop nothing. They keep the order of ``rules``, a table small by its nature. Rules
        that can't be used (such as a phrase operator without phrases) raise, or are left out with ``skip_unusable``.
        """
        from ..operators.predicates import check

        out = cls(**options)
        for r in rules.select("rule_id", "phase", "op_name", "argument", "variables", "transformations", "severity", "msg", "tags", "is_chain").collect():
            try:
                operator = parse_operator(f"{r.op_name} {r.argument or ''}")
                check(operator)
                steps = pipeline(r.transformations or [])
                variables = parse_variables("|".join(r.variables or []))
            except RuleError:
                if not skip_unusable:
                    raise
                continue
            meta = Metadata(id=r.rule_id, msg=r.msg, severity=r.severity, tags=tuple(r.tags or ()))
            out.add(Rule(r.phase if r.phase and 1 <= r.phase <= 5 else 2, variables, operator, steps, meta, is_chain=bool(r.is_chain), flow="chain" if r.is_chain else None))
        return out

    @classmethod
    def compile(cls, directives: list[Directive], default_status: int = 403) -> Ruleset:
        """Checks names and arguments. The last engine mode holds for all; markers stand before the next phase-1 rule."""
        from ..operators.predicates import check

        out, head = cls(default_status=default_status), None
        for d in directives:
            if d.kind == "secruleengine":
                out.mode = d.value
            elif d.kind == "secmarker":
                out.add_marker(d.value)
            elif d.kind == "secaction":
                out.add(rule_of((), Operator("unconditionalmatch"), d.actions, chained=False))
            elif d.kind == "secrule":
                check(d.operator)
                rule = rule_of(d.variables, d.operator, d.actions)
                at = out.add(rule)
                if head and head[0] == rule.phase:
                    opener = out.phases[rule.phase][head[1]]
                    out.phases[rule.phase][head[1]] = Rule(**{**opener.__dict__, "chain_next": at})
                head = (rule.phase, at) if rule.is_chain else None
        return out

    def add(self, rule: Rule) -> int:
        """Appends a rule to its phase; its place there."""
        self.phases[rule.phase].append(rule)
        return len(self.phases[rule.phase]) - 1

    def add_marker(self, name: str, phase: int = 1) -> None:
        self.markers[name] = (phase, len(self.phases[phase]))

    @property
    def rule_count(self) -> int:
        return sum(map(len, self.phases.values()))

    def rules_frame(self, spark):
        """One row a rule, for looking at a ruleset with SQL."""
        rows = [
            (i, p, r.id, r.is_chain, r.chain_next, r.operator.name, r.operator.negated, r.operator.argument,
             [(v.name, v.key, v.pattern, v.count) for v in r.variables], list(r.transformations), r.disruptive, r.flow,
             [(s.key, s.kind, str(s.value)) for s in r.setvars], r.metadata.msg, r.metadata.severity, list(r.metadata.tags), r.metadata.format_log())
            for p, rules in self.phases.items() for i, r in enumerate(rules)]
        return spark.createDataFrame(rows, RULES)

    def markers_frame(self, spark):
        return spark.createDataFrame([(n, p, i) for n, (p, i) in self.markers.items()], "name string, phase int, idx int")


RULES = (
    "idx int, phase int, id string, is_chain boolean, chain_next int, operator string, negated boolean, argument string, "
    "variables array<struct<name:string,key:string,pattern:string,count:boolean>>, transformations array<string>, disruptive string, "
    "flow string, setvars array<struct<key:string,kind:string,value:string>>, msg string, severity int, tags array<string>, log string")


def chain_matches(rules: list[Rule], start: int, evaluate) -> bool | None:
    """Whether a rule and all it chains to match; ``evaluate(rule)`` gives a truth value, or None for unknown."""
    while start is not None and start < len(rules):
        got = evaluate(rules[start])
        if got is None or not got:
            return None if got is None else False
        if not (rules[start].is_chain and rules[start].chain_next is not None):
            return True
        start = rules[start].chain_next
    return False
