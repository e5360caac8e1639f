"""Exact percentiles of whole tables, without a task that sees all values.

A rank is sought by counting: values are counted in equal buckets of the range that still holds it, the bucket of the rank is the next range, and once few rows are left in it they are
put in order. A pass sends a row per bucket; all ranks are sought in the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.sources.shared import kept

BUCKETS = 1024
#: Rows of a range that are put in order at once.
FEW = 20_000


@dataclass
class Range:
    """Values from low to high, before which `below` values stand, and the ranks that fall among them."""

    low: float
    high: float
    below: int
    rows: int
    ranks: list[int]


def at_ranks(d: DataFrame, value: str, ranks: Iterable[int], whole: tuple[int, float, float]) -> dict[int, float]:
    """The values of these ranks, from 0, of a table without nulls and NaN; whole: its rows, least and largest value. The table is read once a pass."""
    count, low, high = whole
    todo, found = [Range(low, high, 0, count, sorted(set(ranks)))], {}
    while todo:
        for r in [r for r in todo if r.low == r.high]:
            found |= dict.fromkeys(r.ranks, r.low)
        few = [r for r in todo if r.low < r.high and r.rows <= FEW]
        if few:
            parts = d.select(_range(value, few).alias("r"), F.col(value).alias("v")).filter("r is not null").groupBy("r").agg(F.sort_array(F.collect_list("v")).alias("v"))
            picked = parts.select("r", F.transform(_chosen(few), lambda k: F.get("v", k)).alias("v"))
            for row in picked.collect():
                found |= dict(zip(few[row["r"]].ranks, row["v"], strict=True))
        todo = [r for r in todo if r.low < r.high and r.rows > FEW]
        if not todo:
            break
        lows, highs = (F.element_at(F.array(*(F.lit(x) for x in xs)), F.col("r") + 1) for xs in ([r.low for r in todo], [r.high for r in todo]))
        place = (F.col("v") / 2 - lows / 2) / (highs / 2 - lows / 2)  # halves, as a difference may be too large
        at = d.select(_range(value, todo).alias("r"), F.col(value).alias("v")).filter("r is not null").withColumn("b", F.least(F.floor(place * BUCKETS), F.lit(BUCKETS - 1)))
        counted = sorted(tuple(x) for x in at.groupBy("r", "b").agg(F.count("*"), F.min("v"), F.max("v")).collect())
        new = []
        for k, r in enumerate(todo):
            below = r.below
            for _, _, rows, least, most in (x for x in counted if x[0] == k):
                if ranks_here := [n for n in r.ranks if below <= n < below + rows]:
                    new.append(Range(least, most, below, rows, ranks_here))
                below += rows
        todo = new
    return found


def _range(value: str, ranges: list[Range]) -> Column:
    """Number of the range that holds the value."""
    out = F.lit(None).cast("int")
    for k, r in enumerate(ranges):
        out = F.when(F.col(value).between(r.low, r.high), k).otherwise(out)
    return out


def _chosen(ranges: list[Range]) -> Column:
    """Places of a range's ranks among its values, by number r."""
    lists = F.array(*(F.array(*(F.lit(n - r.below) for n in r.ranks)) for r in ranges))
    return F.element_at(lists, F.col("r") + 1)


def percentiles(d: DataFrame, value: str | Column, shares: Iterable[float], lower: bool = False) -> list[float | None]:
    """The percentiles at these shares (0 to 1) of all values but nulls and NaN: linear between the two nearest ranks, or with `lower` the value at the lower one. None where there is no value.

    The column is computed once and kept in the shared folder, eight bytes a row. Infinities take part at the ends, and don't blend: a percentile between a number and an infinity is that infinity.
    """
    shares = list(shares)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    only = kept(d.select(v.alias("v")).filter("v is not null and not isnan(v)"), "values")
    finite = F.abs("v") != float("inf")
    n, below, low, high = only.agg(F.count("*"), F.count_if(F.col("v") == -float("inf")), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    if not n:
        return [None] * len(shares)
    inner = only.filter(finite)
    size = inner.count() if low is not None else 0
    wanted = {s: (math.floor(s * (n - 1)), math.ceil(s * (n - 1))) for s in shares}
    ranks = {k - below for pair in wanted.values() for k in pair if 0 <= k - below < size}
    got = {k + below: x for k, x in (at_ranks(inner, "v", ranks, (size, low, high)) if ranks else {}).items()}
    at = lambda k: got.get(k, -float("inf") if k < below else float("inf"))

    def blended(share: float) -> float:
        a, b = (at(k) for k in wanted[share])
        return a if lower or a == b else a + (b - a) * (share * (n - 1) - wanted[share][0])

    return [blended(s) for s in shares]
