"""Search filters as Column predicates."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Comparison(Enum):
    EQUALS = "="
    NOT_EQUALS = "<>"
    GREATER = ">"
    LESS = "<"
    AT_LEAST = ">="
    AT_MOST = "<="
    IS_NULL = "IS NULL"
    IS_NOT_NULL = "IS NOT NULL"


@dataclass(frozen=True)
class DateFilter:
    """A comparison with a time; one with a value is never true where either side is null."""

    comparison: Comparison
    value: str | None = None


DateGroups = list[list[DateFilter]] | None


@dataclass(frozen=True)
class SearchFilters:
    """None means no constraint; an empty list of types or uuids matches nothing, of labels everything. ``property_filters`` have no effect."""

    node_labels: list[str] | None = None
    edge_types: list[str] | None = None
    edge_uuids: list[str] | None = None
    valid_at: DateGroups = None
    invalid_at: DateGroups = None
    created_at: DateGroups = None
    expired_at: DateGroups = None
    property_filters: list = field(default_factory=list)


def _date(column: Column, f: DateFilter) -> Column:
    if f.comparison is Comparison.IS_NULL:
        return column.isNull()
    if f.comparison is Comparison.IS_NOT_NULL:
        return column.isNotNull()
    value = F.lit(f.value).cast("timestamp")
    how = {"=": operator.eq, "<>": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
    return F.coalesce(how[f.comparison.value](column, value), F.lit(False))


def dates(column: str, groups: DateGroups) -> Column:
    """OR of ANDs; no groups, or an empty group, match everything."""
    if not groups:
        return F.lit(True)
    return functools.reduce(operator.or_, [functools.reduce(operator.and_, [_date(F.col(column), f) for f in g], F.lit(True)) for g in groups])


def in_groups(df: DataFrame, groups: list[str] | None) -> DataFrame:
    """None, [] and [""] mean all groups."""
    return df if not groups or groups == [""] else df.where(F.col("group_id").isin(groups))


def checked_labels(labels: list[str]) -> list[str]:
    for x in labels:
        if not re.fullmatch("[A-Za-z0-9_]+", x):
            raise ValueError(f"not a label: {x!r}")
    return labels


def checked_group(group: str) -> str:
    if not re.fullmatch("[A-Za-z0-9_-]*", group):  # the empty group is the default one
        raise ValueError(f"not a group id: {group!r}")
    return group


def with_labels(nodes: DataFrame, labels: list[str] | None) -> DataFrame:
    """Nodes with any of the labels."""
    return nodes if not labels else nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, checked_labels(labels)))))


def filter_nodes(nodes: DataFrame, f: SearchFilters | None) -> DataFrame:
    return with_labels(nodes, f.node_labels) if f else nodes


def filter_edges(edges: DataFrame, f: SearchFilters | None, entities: DataFrame | None = None) -> DataFrame:
    """Column predicates first, so that they reach the scan; then both endpoints must have a label, if labels are asked for."""
    if f is None:
        return edges
    if f.edge_types is not None:
        edges = edges.where(F.col("name").isin(f.edge_types) if f.edge_types else F.lit(False))
    if f.edge_uuids is not None:
        edges = edges.where(F.col("uuid").isin(f.edge_uuids) if f.edge_uuids else F.lit(False))
    for column in ("valid_at", "invalid_at", "created_at", "expired_at"):
        if groups := getattr(f, column):
            edges = edges.where(dates(column, groups))
    if f.node_labels:
        if entities is None:
            raise ValueError("labels of endpoints need the entities")
        ends = with_labels(entities, f.node_labels).select(F.col("uuid").alias("_end"))
        for column in ("source_node_uuid", "target_node_uuid"):
            edges = edges.join(ends, F.col(column) == F.col("_end"), "left_semi")
    return edges
