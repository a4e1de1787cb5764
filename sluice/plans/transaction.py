"""A single transaction pushed in piece by piece, for interactive use and the command line.

Every phase call evaluates the transaction so far as a one-row table; tables of transactions go to Evaluator.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.requests import TRANSACTION
from ..seclang.ruleset import Ruleset
from .engine import Evaluator


class Transaction:
    """Collects a request and response. Phases run in the order they are called, each at most once."""

    def __init__(self, spark: SparkSession, ruleset: Ruleset):
        self._spark, self._plan = spark, Evaluator(ruleset)
        self._uri, self._method, self._protocol = "", "", ""
        self._headers: dict[str, list] = {"request": [], "response": []}
        self._bodies = {"request": b"", "response": b""}
        self._phases: list[int] = []
        self._row = None

    def process_uri(self, uri: str, method: str = "GET", protocol: str = "HTTP/1.1") -> None:
        self._uri, self._method, self._protocol = uri, method, protocol

    def add_request_header(self, name: str, value: str) -> None:
        self._headers["request"].append((name, value))

    def add_response_header(self, name: str, value: str) -> None:
        self._headers["response"].append((name, value))

    def append_request_body(self, data: bytes) -> None:
        self._bodies["request"] += data

    def append_response_body(self, data: bytes) -> None:
        self._bodies["response"] += data

    def process(self, phase: int) -> None:
        """Runs a phase (1 to 5) after those called before."""
        if phase not in self._phases:
            self._phases.append(phase)
        row = (0, None, self._method, self._uri, self._protocol, self._headers["request"], bytearray(self._bodies["request"]), True, None,
               self._headers["response"], bytearray(self._bodies["response"]), None, None, None, None)
        self._row = self._plan.evaluate(self._spark.createDataFrame([row], TRANSACTION), tuple(self._phases)).first()

    def process_request_headers(self) -> None:
        self.process(1)

    def process_request_body(self) -> None:
        self.process(2)

    def process_response_headers(self) -> None:
        self.process(3)

    def process_response_body(self) -> None:
        self.process(4)

    def process_logging(self) -> None:
        self.process(5)

    def _got(self, name: str, default):
        return default if self._row is None else self._row[name]

    @property
    def intervention(self):
        return self._got("intervention", None)

    @property
    def has_intervention(self) -> bool:
        return self.intervention is not None

    @property
    def matched_rules(self) -> list[str]:
        return self._got("matched_rules", [])

    @property
    def anomaly_score(self) -> int:
        return self._got("anomaly_score", 0)

    @property
    def allowed(self) -> bool:
        return self._got("allowed", False)

    @property
    def tx(self) -> dict[str, str]:
        return self._got("tx", {})
