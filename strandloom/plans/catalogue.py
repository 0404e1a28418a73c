"""All core queries."""

from __future__ import annotations

from .annotation_problems import annotation
from .classify_queries import classification
from .compare_queries import comparison
from .detect_queries import detection
from .interval_queries import intervals
from .report_queries import reports
from .sequence_queries import sequences
from .registry import Registry

PARTS: list[Registry] = [annotation, sequences, intervals, comparison, detection, classification, reports]


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.sql.items()}
