"""getState(): a value of a named state table within an expression."""

from __future__ import annotations

from dataclasses import dataclass

from .scalar import Arg


@dataclass(frozen=True)
class StateValue:
    """The value of `key` in the state table `table`, at `time` for tables that tell times (now, if none is given).
    EventQuery.eval() turns it into a lookup join, the only join that a query of the language can have."""

    table: str
    key: Arg
    time: Arg | None = None


def get_state(table: str, key: Arg, time: Arg | None = None) -> StateValue:
    return StateValue(table, key, time)
