"""Exact tails of the hypergeometric law as column expressions: Fisher's test and overlaps, without Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Under this, log factorials are looked up; from it on, Stirling's series has 15 digits.
TABLED = 32


def log_factorial(n: Column) -> Column:
    """log(n!) of whole numbers from 0."""
    x = n.cast("double")
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(TABLED)])
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < TABLED, F.get(table, n.cast("int"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def overlap_tail(shared: Column, first: Column, second: Column, of: Column) -> Column:
    """The chance that two random sets of ``first`` and ``second`` out of ``of`` things share at least ``shared``.

    Terms fall away from the likeliest number: from ``shared`` up, or from the one under it down, which is then taken from 1. The
    first term comes from log factorials, each next one from the one before it. Null where an argument is null or the
    numbers can't be (a negative one, or sets larger than the whole); 1 for as few as must be shared, 0 for more than can be."""
    shared, first, second, of = (c.cast("long") for c in (shared, first, second, of))
    low, high = F.greatest(F.lit(0), first + second - of), F.least(first, second)
    up = shared > F.floor((first + 1) * (second + 1).cast("double") / (of + 2))
    begin = F.when(up, shared).otherwise(shared - 1)
    log_p = log_choose(first, begin) + log_choose(of - first, second - begin) - log_choose(of, second)
    # the term of k + 1 is that of k times (first - k) (second - k) / ((k + 1) (of - first - second + k + 1))
    above = lambda k: (first - k) * (second - k).cast("double") / ((k + 1) * (of - first - second + k + 1))
    steps = F.when(up & (begin < high), F.sequence(begin, high - 1)).when(~up & (begin > low), F.sequence(begin - 1, low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.exp(log_p).alias("term"), F.exp(log_p).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * F.when(up, above(k)).otherwise(1 / above(k))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(steps, start, step)["sum"]
    tail = F.least(F.lit(1.0), F.when(up, total).otherwise(1 - total))
    sound = (shared >= 0) & (first >= 0) & (second >= 0) & (first <= of) & (second <= of)
    return F.when(sound, F.when(shared > high, 0.0).when(shared <= low, 1.0).otherwise(tail))


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of the table [[a, b], [c, d]]: as many as a in its cell, or more, with the margins as they are."""
    return overlap_tail(a, a + b, a + c, a + b + c + d)


def sql_overlap_tail(shared: str, first: str, second: str, of: str) -> str:
    """The same in SQL with lgamma, as a sum over all terms."""
    choose = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - ({k}) + 1.0))"
    term = f"exp({choose(first, 'k')} + {choose(f'({of} - {first})', f'({second} - k)')} - {choose(of, second)})"
    return f"least(1.0, coalesce(list_sum([{term} FOR k IN range(greatest({shared}, 0, {first} + {second} - {of}), least({first}, {second}) + 1)]), 0.0))"
