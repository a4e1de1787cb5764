"""What rule text parses to."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Variable:
    """``name`` in capitals; ``key`` or ``pattern`` selects from a collection; ``excluded`` texts drop values by full name."""

    name: str
    key: str | None = None
    pattern: str | None = None
    count: bool = False
    excluded: tuple[str, ...] = ()


@dataclass(frozen=True)
class Operator:
    """``name`` in lower case."""

    name: str
    argument: str = ""
    negated: bool = False


@dataclass(frozen=True)
class SetVar:
    """``kind`` is set, add or delete; ``value`` a text to set or a number to add."""

    collection: str
    key: str
    kind: str
    value: str | int = ""


@dataclass(frozen=True)
class Action:
    """``family`` groups actions of which a rule keeps only the last."""

    family: str
    name: str
    value: object = None

    @property
    def slot(self) -> tuple[str, str]:
        return (self.family, self.name if self.family == "metadata" else "")


@dataclass(frozen=True)
class Directive:
    """``kind`` is the directive's name in lower case; Sec lines of other names have kind ``unknown``."""

    kind: str
    value: object = None
    variables: tuple[Variable, ...] = ()
    operator: Operator | None = None
    actions: tuple[Action, ...] = field(default=())
    file: str | None = None
    line: int = 0
