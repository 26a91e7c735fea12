"""Ordered rules that put a record into one of a few states, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The state of the first rule that holds; a rule that is null doesn't."""
    out = None
    for holds, state in rules:
        out = F.when(holds, state) if out is None else out.when(holds, state)
    return out.otherwise(otherwise)


def freshness(enabled: Column, configured: Column, failure: Column, last_success_s: Column, last_failure_s: Column, now_s: int, stale_after_s: int) -> Column:
    """State of a source. A success counts as stale before a later failure counts."""
    return first_of([
        (~enabled, "disabled"), (~configured, "unconfigured"), (failure == "auth", "auth"), (failure == "rate", "rate"), (last_success_s.isNull(), "never"),
        (F.lit(now_s) - last_success_s > stale_after_s, "stale"), (last_failure_s > last_success_s, "failed"),
    ], "healthy")


def coverage(enabled: Column, configured: Column, complete_s: Column, partial: Column, now_s: int, stale_after_s: int) -> Column:
    """State of a scan's coverage by the clock."""
    current = complete_s + stale_after_s >= now_s
    return first_of([(~enabled, "disabled"), (~configured, "unconfigured"), (current, "complete_current"), (complete_s.isNotNull(), "complete_stale"), (partial, "partial")], "unavailable")


def result_state(items: Column, covered: Column, state: Column) -> Column:
    """Items if there are any; an empty result says something only where a current scan covered the window."""
    return F.when(items > 0, "items").when((state == "complete_current") & covered, "valid-empty").when(state.startswith("complete"), "complete-not-eligible").otherwise(state)


def reasons(*rules: tuple[Column, str]) -> Column:
    """All reasons whose rules hold, in the order given."""
    return F.array_compact(F.array(*[F.when(holds, said) for holds, said in rules]))


def violation(df, *rules: tuple[Column, str]):
    """The rows of df that break a rule, with all reasons joined by commas."""
    return df.withColumn("reasons", F.concat_ws(",", reasons(*rules))).where("reasons <> ''")
