"""Compiles lists of conditions to boolean columns over bars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.conditions import CONDITIONS, Compiled
from barspark.functions.scan import with_scans

#: A condition of a strategy: its name and what differs from its defaults.
Spec = tuple[str, dict]


class FlowDataMissing(ValueError):
    """A condition is about flow and the bars have no such column."""


def compiled(spec: Spec) -> Compiled:
    name, params = spec
    if name not in CONDITIONS:
        raise KeyError(f"unknown condition {name}")
    condition = CONDITIONS[name]
    return condition.build(dict(condition.defaults) | dict(params or {}))


def fault(spec: Spec) -> str | None:
    """What is wrong with a condition: its name is unknown or its parameters make no expression; None if nothing is."""
    try:
        compiled(spec).predicate()
    except (KeyError, ValueError, TypeError, ArithmeticError) as e:
        return f"{type(e).__name__}: {e}"
    return None


def faults(named: dict[str, Spec]) -> dict[str, str]:
    """The faulty ones of named conditions, and why."""
    return {alias: why for alias, spec in named.items() if (why := fault(spec)) is not None}


def uses_flow(specs: Sequence[Spec]) -> bool:
    """Whether an as-of join with flow is needed at all."""
    return any(CONDITIONS[name].flow for name, _ in specs if name in CONDITIONS)


def with_conditions(bars: DataFrame, named: dict[str, Spec], keep: Sequence[str] | None = None) -> DataFrame:
    """keep (default: all columns of bars) and a boolean column for each named condition.

    Indicators that conditions share are computed once. bars may be dealt by symbol already; all windows and the
    grouped pass use that one distribution. A faulty condition is false on every bar and leaves the others alone; faults() tells why.
    """
    wrong = faults(named)
    parts = {alias: compiled(spec) for alias, spec in named.items() if alias not in wrong}
    for alias, (name, _) in named.items():
        if alias not in wrong and (flow := CONDITIONS[name].flow) and flow not in bars.columns:
            raise FlowDataMissing(f"{name} needs {flow}")
    keep = list(bars.columns if keep is None else keep)
    level0 = {n: c for p in parts.values() for n, c in p.level0.items()}
    level1 = {n: c for p in parts.values() for n, c in p.level1.items()}
    scans = [s for p in parts.values() for s in p.scans]
    rows = with_scans(bars, scans)
    if level0:
        rows = rows.withColumns(level0)
    if level1:
        rows = rows.withColumns(level1)
    return rows.select(*keep, *((F.lit(False) if alias in wrong else parts[alias].predicate()).alias(alias) for alias in named))


def combined(columns: Sequence[Column | str], logic: str = "AND") -> Column:
    """All (AND) or any (OR) of boolean columns; an empty list is false, for either."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    if not columns:
        return F.lit(False)
    return reduce(lambda a, b: a & b, columns) if logic == "AND" else reduce(lambda a, b: a | b, columns)
