"""Exact picks by rank, and seeded samples, that no single task or driver has to sort."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a number that one counting pass tells apart: 4096 counts at most reach the driver.
DIGIT = 12
#: A range of so few numbers is fetched instead of counted again.
FEW = 4096


class Rank(NamedTuple):
    """The ``k``-th smallest value (from 1), and how many are smaller."""

    value: int
    below: int
    k: int


def kth(numbers: DataFrame, k: int | None = None, share: float = 1.0) -> Rank | None:
    """The k-th smallest of a column of non-negative longs; int(n * share) is taken for k
    if none is given. Counts by leading bits tell the range that holds it, and only that
    range is looked at again, six passes at most. None if there is no such rank."""
    x = F.col(numbers.columns[0])
    numbers = numbers.filter(x.isNotNull())
    shift, prefix, below = 63, 0, 0
    while True:
        inside = numbers.filter(F.shiftright(x, shift) == prefix) if shift < 63 else numbers
        shift = max(0, shift - DIGIT)
        counts = sorted((r["d"], r["n"]) for r in inside.groupBy(F.shiftright(x, shift).alias("d")).agg(F.count("*").alias("n")).collect())
        k = int(sum(n for _, n in counts) * share) if k is None else k
        if not 0 < k <= below + sum(n for _, n in counts):
            return None
        for prefix, n in counts:
            if below + n >= k:
                break
            below += n
        if not shift:
            return Rank(prefix, below, k)
        if n <= FEW:
            own = sorted(r[0] for r in numbers.filter(F.shiftright(x, shift) == prefix).collect())
            value = own[k - below - 1]
            return Rank(value, below + own.index(value), k)


def seeded(key: Column, seed: int) -> Column:
    """A number of 60 bits from a seed and a key: the order of a seeded shuffle. Null counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")


def among_first(rows: DataFrame, seed: int, key: str, k: int | None = None, share: float = 1.0) -> Column:
    """Whether a row is among the first k, or int(n * share), of a seeded shuffle. Keys with
    one number come in their own order, null first; rows that repeat a key go one way, so
    the repeats of the last key may exceed what was asked for."""
    rank = kth(rows.select(seeded(F.col(key), seed)), k, share)
    if rank is None:
        return F.lit(k is not None and k > 0)  # fewer rows than k
    h, seen, last = seeded(F.col(key), seed), rank.below, None
    same = rows.filter(h == rank.value).groupBy(key).count().collect()  # keys of one number: hardly ever two
    for last, n in sorted(map(tuple, same), key=lambda r: (r[0] is not None, r[0])):
        seen += n
        if seen >= rank.k:
            break
    tie = F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= F.lit(last))
    return (h < rank.value) | ((h == rank.value) & tie)
