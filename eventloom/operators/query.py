"""The event language's clauses as one chain of DataFrame steps.

    EventQuery(events).where(equals("event_type", "purchase")) \\
        .eval(hour=floor_time("ts", "hour")).eval(n=count()) \\
        .group_by("hour").having(col("n") > 3).sort_by("hour").select("hour", "n").limit(100).frame()

eval() takes expressions in order, and later ones may redefine a name. get_state() among them becomes a lookup in one
of the tables given to with_states(). Everything stays one lazy plan, so filters and columns reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.selection import Pick
from eventloom.functions.states import StateValue

from .groups import same_groups, select_values
from .lookups import state_value
from .sorting import general_sort_keys, sort_key
from .windows import hopping

__all__ = ["EventQuery", "general_sort_keys", "sort_key"]


@dataclass(frozen=True)
class EventQuery:
    source: DataFrame
    keys: tuple[str, ...] = ()
    sorted_by: tuple[Column, ...] = ()
    most: int | None = None
    skipped: int = 0
    show: dict = field(default_factory=dict)
    states: dict = field(default_factory=dict)
    rows_by: tuple[str, ...] = ()

    def _with(self, df: DataFrame, **more) -> EventQuery:
        return replace(self, source=df, **more)

    def where(self, condition: Column) -> EventQuery:
        """A condition on stored fields."""
        return self._with(self.source.where(condition))

    def filter(self, condition: Column) -> EventQuery:
        """A condition on extracted or computed fields; Spark pushes both kinds as far down as they go."""
        return self._with(self.source.where(condition))

    def with_states(self, **tables: DataFrame) -> EventQuery:
        """The state tables that get_state() may name."""
        return replace(self, states={**self.states, **tables})

    def eval(self, **expressions: Column | StateValue) -> EventQuery:
        df = self.source
        for name, expression in expressions.items():
            if isinstance(expression, StateValue):
                df = state_value(df, self.states[expression.table], expression, name)
            else:
                df = df.withColumn(name, expression)
        return self._with(df)

    def window(self, time: str, size: str, advance: str | None = None) -> EventQuery:
        """Copies rows forward to the windows that they count in; adds window_start and period."""
        return self._with(hopping(self.source, time, size, advance or size))

    def order(self, *columns: str) -> EventQuery:
        """The order of rows, for selections from groups."""
        return replace(self, rows_by=columns)

    def group_by(self, *keys: str, **aggregates: Column | Pick) -> EventQuery:
        """Groups by the keys. Columns that are neither key nor aggregate have no value in a group and go. Selections
        such as top() take the rows of a group in the order of order()."""
        picks = {n: a for n, a in aggregates.items() if isinstance(a, Pick)}
        named = [a.alias(n) for n, a in aggregates.items() if n not in picks]
        df = self.source.groupBy(*keys).agg(*named) if named else self.source.select(*keys).distinct()
        if picks:
            df = same_groups(df, select_values(self.source, keys, self.rows_by, **picks), keys)
        return self._with(df.select(*keys, *aggregates), keys=keys)

    def having(self, condition: Column) -> EventQuery:
        return self._with(self.source.where(condition))

    def sort_by(self, *order: str | Column) -> EventQuery:
        """`name` or `name desc`; missing values are lowest."""
        return replace(self, sorted_by=tuple(x if isinstance(x, Column) else sort_key(x) for x in order))

    def select(self, *columns: str | Column, **named: str | Column) -> EventQuery:
        renamed = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()]
        df = self.source.orderBy(*self.sorted_by) if self.sorted_by else self.source
        return self._with(df.select(*columns, *renamed), sorted_by=())

    def limit(self, most: int) -> EventQuery:
        return replace(self, most=most)

    def page(self, offset: int, length: int) -> EventQuery:
        return replace(self, skipped=offset, most=length)

    def visualise(self, name: str, **settings: str) -> EventQuery:
        """Attaches a visualisation to the result: metadata only."""
        return replace(self, show={"name": name, **settings})

    def frame(self) -> DataFrame:
        df = self.source.orderBy(*self.sorted_by) if self.sorted_by else self.source
        if self.skipped:
            df = df.offset(self.skipped)
        return df if self.most is None else df.limit(self.most)
