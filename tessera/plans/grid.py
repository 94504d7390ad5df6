"""The declarative grid query: filters, projection, aggregation, limits, sorting, paging."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(column: Column, operator: str, value) -> Column:
    """One of the eleven filter operators."""
    return {
        "Equals": lambda: column == value,
        "NotEqual": lambda: column != value,
        "Greater": lambda: column > value,
        "Less": lambda: column < value,
        "GreaterEqual": lambda: column >= value,
        "LessEqual": lambda: column <= value,
        "BeginsWith": lambda: column.startswith(value),
        "Contains": lambda: column.contains(value),
        "Like": lambda: column.like(value),
        "In": lambda: column.isin(*value),
        "NotIn": lambda: ~column.isin(*value),
    }[operator]()


@dataclass
class GridQuery:
    """Compiled to filter, groupBy.agg, filter, orderBy, offset and limit; Catalyst does the rest."""

    attributes: list[str]
    metrics: dict[str, Column]
    view_filter: list[tuple[str, str, object]] = field(default_factory=list)
    metric_limits: dict[str, tuple[str, object]] = field(default_factory=dict)
    sorting: list[tuple[str, bool]] = field(default_factory=list)
    offset: int = 0
    limit: int | None = None

    def run(self, table: DataFrame) -> DataFrame:
        if self.view_filter:
            table = table.where(reduce(lambda a, b: a & b, [predicate(F.col(c), op, v) for c, op, v in self.view_filter]))
        out = table.groupBy(*self.attributes).agg(*[c.alias(n) for n, c in self.metrics.items()])
        for name, (op, value) in self.metric_limits.items():
            out = out.where(predicate(F.col(name), op, value))
        if self.sorting:
            out = out.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in self.sorting])
        if self.offset:
            out = out.offset(self.offset)
        return out if self.limit is None else out.limit(self.limit)
