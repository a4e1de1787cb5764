"""``python -m sluice.cli check|test|dump``: look at rules, and try a request on them."""

from __future__ import annotations

import argparse
import logging
import sys

from .seclang.errors import RuleError
from .seclang.ruleset import PHASES, Ruleset


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("-v", "--verbose", action="count", default=0)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "test", "dump"):
        c = sub.add_parser(name)
        c.add_argument("-r", "--rules", required=True)
        if name == "test":
            c.add_argument("-u", "--uri", required=True)
            c.add_argument("-m", "--method", default="GET")
            c.add_argument("-H", "--header", action="append", default=[], help="Name: Value")
            c.add_argument("-b", "--body")
    return p


def _test(args: argparse.Namespace, rules: Ruleset) -> list[str]:
    from pyspark.sql import SparkSession

    from .plans.transaction import Transaction

    tx = Transaction(SparkSession.builder.getOrCreate(), rules)
    tx.process_uri(args.uri, args.method)
    for h in args.header:
        name, colon, value = h.partition(":")
        if colon:
            tx.add_request_header(name.strip(), value.strip())
    if args.body is not None:
        tx.append_request_body(args.body.encode())
    for phase in (1, 2) if args.body is not None else (1,):
        tx.process(phase)
        if i := tx.intervention:
            out = [f"BLOCKED (Phase {phase})", f"  Status: {i.status}", f"  Rules: {i.rule_ids}"]
            return [*out, f"  Message: {i.log}"] if i.log is not None else out
    return ["ALLOWED", f"  Matched rules: {tx.matched_rules}", f"  Anomaly score: {tx.anomaly_score}"]


def _dump(rules: Ruleset) -> list[str]:
    out = [f"Total rules: {rules.rule_count}", "", "Rules by phase:"]
    for p, own in rules.phases.items():
        if own:
            out += ["", f"  Phase {p} ({PHASES[p - 1]}):", *[f"    - Rule {r.id or 'no-id'}" for r in own]]
    return out


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(2, args.verbose)])
    try:
        rules = Ruleset.from_file(args.rules)
    except RuleError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    lines = {"check": lambda: [f"Successfully parsed {rules.rule_count} rules"], "test": lambda: _test(args, rules), "dump": lambda: _dump(rules)}[args.command]()
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
