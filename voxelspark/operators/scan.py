"""Prefix scans of any size: runs of an order are reduced on their own, runs of runs next, until one row is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that one task takes, and runs of a level that make a run of the next.
RUN = 4096


@dataclass(frozen=True)
class Monoid:
    """An associative function: ``total`` reduces rows (an aggregate that works over a window too and gives null for no rows),
    ``merge`` joins two results, neither of them null."""

    total: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


SUM = Monoid(F.sum, lambda a, b: a + b)
LEAST = Monoid(F.min, F.least)
GREATEST = Monoid(F.max, F.greatest)
#: The last row's value, of structs that begin with the order.
LAST = GREATEST
ANY_BITS = Monoid(F.bit_or, lambda a, b: a.bitwiseOR(b))


def levels_of(low: int, high: int, run: int) -> int:
    """How often runs must be joined until all orders from ``low`` to ``high`` are in one."""
    last, k = (high - low) // run, 1
    while last:
        last, k = last // run, k + 1
    return k


def _joined(past: Column, inner: Column, m: Monoid) -> Column:
    return F.when(inner.isNull(), past).when(past.isNull(), inner).otherwise(m.merge(past, inner))


def scan(rows: DataFrame, order: str, what: dict[str, tuple[Column, Monoid]], by: tuple[str, ...] = (), ties: tuple[str, ...] = (), run: int = RUN, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Adds for each name the reduction of a value over all earlier rows of the same ``by``; null for the first.

    ``order`` is an integer; ``ties`` orders rows that share it.  Nulls of a value do not count; a null order stands apart, as a run
    of its own.  A window holds the rows of one run of ``run`` orders, or ``run`` reduced rows of the level below, at whatever
    level: levels are added until one run holds all, by the least and greatest order (``bounds``, else one aggregate)."""
    if bounds is None:
        low, high = rows.agg(F.min(order), F.max(order)).first()
        bounds = (0, 0) if low is None else (low, high)
    height = levels_of(*bounds, run)
    names = {n: f"_s{i}" for i, n in enumerate(what)}
    keyed = rows.select("*", F.expr(f"({order} - ({bounds[0]}L)) div {run}").alias("_r"), *[v.alias(names[n]) for n, (v, _) in what.items()])
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*by, "_r")])
    level, steps = keyed, []
    for k in range(height):
        inner = earlier(Window.partitionBy(*by, "_r").orderBy(*([order, *ties] if k == 0 else ["_o"])))
        steps.append(level.withColumns({f"{names[n]}_in": m.total(names[n]).over(inner) for n, (_, m) in what.items()}))
        if k + 1 < height:
            sums = level.groupBy(*by, "_r").agg(*[m.total(names[n]).alias(names[n]) for n, (_, m) in what.items()])
            level = sums.select(*by, F.col("_r").alias("_o"), F.expr(f"_r div {run}").alias("_r"), *names.values())
    found = steps[-1]
    for below in reversed(steps[:-1]):
        past = found.select(*by, F.col("_o").alias("_r"), *[F.col(f"{names[n]}_in").alias(f"{names[n]}_past") for n in what])
        found = below.alias("l").join(past.alias("p"), same("l", "p"), "left").select("l.*", *[f"p.{names[n]}_past" for n in what])
        found = found.withColumns({f"{c}_in": _joined(F.col(f"{c}_past"), F.col(f"{c}_in"), what[n][1]) for n, c in names.items()}).drop(*[f"{names[n]}_past" for n in what])
    return found.withColumns({n: F.col(f"{names[n]}_in") for n in what}).drop("_r", *names.values(), *[f"{c}_in" for c in names.values()])
