"""Recursions along an array, in the JVM and in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements folded at once: an array that grows within a fold is copied at each step, so it stays this short.
RUN = 256


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str = "double") -> Column:
    """All states of a recursion: start, step(start, first value), and so on; one more than values.

    Values are folded in runs of RUN and the runs in turn.  ``values`` should be a column of a
    projection of its own, since it is cut into runs within the expression.  Unnest the result by the
    outer functions: for the others the optimiser adds a filter that computes all states once more.
    """
    one = lambda s, states: F.struct(s.alias("s"), states.alias("states"))
    none = F.array().cast(f"array<{kind}>")
    runs = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN))))
    within = lambda state, run: F.aggregate(run, one(state["s"], none), lambda st, x: one(step(st["s"], x), F.concat(st["states"], F.array(st["s"]))))
    # an array of one element binds a run's result, so that it is computed once
    whole = lambda state, run: F.transform(F.array(within(state, run)), lambda r: one(r["s"], F.concat(state["states"], F.array(r["states"]))))[0]
    begin = one(start.cast(kind), F.array().cast(f"array<array<{kind}>>"))
    made = F.aggregate(runs, begin, whole, lambda st: F.concat(F.flatten(st["states"]), F.array(st["s"])))
    return F.coalesce(made, F.array(start.cast(kind)))
