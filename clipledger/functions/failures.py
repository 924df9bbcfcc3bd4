"""Classification of resolve failures and encoder errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger.constants import DURABLE_WORDS, HW_FAILURE_PATTERNS, TRANSIENT_WORDS, TRUNCATION_WORDS


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mentions(text: str | Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words."""
    return F.lower(_column(text)).rlike("|".join(words))


def durable_failure(kind: str, status: str | Column, message: str) -> Column:
    """Whether a failed resolve is worth remembering; false for no failure at all."""
    answer = (
        F.when(F.col(kind) == "http_status", _column(status) == 404)
        .when(F.col(kind) == "parse_failed", ~mentions(message, TRUNCATION_WORDS))
        .when(
            F.col(kind) == "process_failed",
            ~mentions(message, TRANSIENT_WORDS) & mentions(message, DURABLE_WORDS),
        )
    )
    return F.coalesce(answer, F.lit(False))


def hardware_failure(backend: Column, stderr: Column) -> Column:
    """Whether the text blames the given hardware backend."""
    branches = F.lit(False)
    for name in dict.fromkeys(b for b, _ in HW_FAILURE_PATTERNS):
        words = [p for b, p in HW_FAILURE_PATTERNS if b == name]
        branches = branches | ((backend == name) & mentions(stderr, words))
    return F.coalesce(branches, F.lit(False))


def any_hardware_failure(stderr: Column) -> Column:
    """Whether the text blames any hardware backend."""
    words = list(dict.fromkeys(p for _, p in HW_FAILURE_PATTERNS))
    return F.coalesce(mentions(stderr, words), F.lit(False))
