"""Special functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0: Stirling's series at n + 8, stepped back by the recurrence."""
    x = n.cast("double") + 8
    series = (
        (x + 0.5) * F.log(x)
        - x
        + 0.9189385332046727
        + 1 / (12 * x)
        - 1 / (360 * x * x * x)
        + 1 / (1260 * F.pow(x, F.lit(5.0)))
        - 1 / (1680 * F.pow(x, F.lit(7.0)))
    )
    product = n.cast("double") + 1
    for step in range(2, 9):
        product = product * (n.cast("double") + step)
    return series - F.log(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeom_upper_tail(k: Column, draws: Column, marked: Column, total: Column) -> Column:
    """P(X >= k) when ``draws`` of ``total`` items are taken and ``marked`` items are special.

    The first term comes from factorials, the others from the term ratio; the
    number of terms is bounded by the size of the marked set.
    """
    top = F.least(draws, marked)
    first = F.exp(log_choose(marked, k) + log_choose(total - marked, draws - k) - log_choose(total, draws))
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        x = i.cast("double")
        ratio = (marked - x) * (draws - x) / ((x + 1) * (total - marked - draws + x + 1))
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    rest = F.when(k < top, F.sequence(k.cast("bigint"), (top - 1).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.least(F.lit(1.0), F.aggregate(rest, zero, step, lambda acc: acc["sum"]))
