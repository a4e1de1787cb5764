"""Scores of severities, and thresholds by paranoia level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score by severity from 0; inbound and outbound threshold by level from 1, the last for all above and below.
SEVERITY_SCORES = [5, 5, 5, 4, 3, 2]
THRESHOLDS = [(5, 4), (10, 8), (15, 12), (20, 16)]


def severity_score(severity: Column) -> Column:
    """0 for severities without a score, and for null."""
    scores = F.array(*map(F.lit, SEVERITY_SCORES))
    return F.when(severity.between(0, len(SEVERITY_SCORES) - 1), F.get(scores, severity.cast("int"))).otherwise(0)


def threshold(level: Column, outbound: bool = False) -> Column:
    values = [t[outbound] for t in THRESHOLDS]
    return F.when(level.between(1, 3), F.get(F.array(*map(F.lit, values)), level.cast("int") - 1)).otherwise(values[3])


def exceeded(score: Column, level: Column, outbound: bool = False) -> Column:
    return score >= threshold(level, outbound)
