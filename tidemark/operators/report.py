"""Reports: grouped, rounded measures as they are filed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import partition_keys
from .measures import Measure, derive
from .rules import Step, row_stage


@dataclass(frozen=True)
class ReportSpec:
    grouping: tuple[str, ...]
    measures: tuple[Measure, ...]
    steps: tuple[Step, ...] = ()
    derived: Mapping[str, tuple[Sequence[str], str]] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ("as_of_date",)


def check_report(columns: Sequence[str], spec: ReportSpec) -> list[str]:
    """Grouping and partition columns that the row stage does not make; empty if the report can be produced."""
    wanted = partition_keys(spec.grouping, spec.partition_by)
    return [f"{c}: no such column" for c in wanted if c not in columns] + [f"{m.name}: reads {m.field}, which is no column" for m in spec.measures if m.field.isidentifier() and m.field not in columns]


def report(df: DataFrame, spec: ReportSpec) -> DataFrame:
    """Row stage, groups, rounded measures, then derived ones from the rounded. Unmatched records stay as a group of their own."""
    rows = row_stage(df, spec.steps)
    if problems := check_report(rows.columns, spec):
        raise ValueError("; ".join(problems))
    keys = partition_keys(spec.grouping, spec.partition_by)
    grouped = rows.groupBy(*keys).agg(*[m.column() for m in spec.measures], F.count("*").alias("records"))
    return derive(grouped, spec.derived)


def report_totals(filed: DataFrame, amounts: Sequence[str], by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Footing totals of filed rows."""
    return filed.groupBy(*by).agg(*[F.sum(a).cast("decimal(38,2)").alias(a) for a in amounts], F.sum("records").alias("records"))
