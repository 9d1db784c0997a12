"""Assignments and cohort -> small-cell audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.disclosure import cell_summary, dropped_rows, flag_small_cells, join_assignments, subgroup_sizes


@dataclass(frozen=True)
class DisclosureCheck:
    counts: DataFrame
    summary: DataFrame


def run_privacy_check(
    assignments: DataFrame, cohort: DataFrame, threshold: int = 10, require_subgroups: bool = True, **columns: str
) -> DisclosureCheck:
    """Flagged subgroup sizes and their summary; no subgroup at all is an error, not a pass."""
    joined = join_assignments(assignments, cohort, **columns)
    counts = flag_small_cells(subgroup_sizes(joined), threshold)
    if require_subgroups and counts.isEmpty():
        raise ValueError("no subgroup could be evaluated; check the level texts")
    both = cell_summary(counts)
    left_out = dropped_rows(joined)
    summary = both.select(*both.columns, *[left_out.select(c).scalar().alias(c) for c in left_out.columns])
    return DisclosureCheck(counts, summary)
