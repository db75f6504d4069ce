"""Recurrences over ordered series (H10-H12), spike codes and norms of vectors (2.L).

A series may be longer than a task should read: rows are sorted by range, cut into
blocks of consecutive steps, and blocks are solved side by side. A linear recurrence
is an affine map of the state before, so blocks are first reduced to their maps, and
the maps' states handed on before the second reading. A membrane that fires and
resets isn't linear: its blocks are run from a guess, and those whose predecessor
ended elsewhere are run again, until all agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.sources.shared import checkpointed

#: Steps of a block.
BLOCK = 1 << 15

_BLOCKS = "id long, run long, n long, first boolean, x array<double>"


def _blocks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """(id, run, n, before, first, x): consecutive values of one run, by ids that ascend with
    the order; ``before`` counts the run's earlier steps. Written down."""
    by = ["run", *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = dealt.select(F.monotonically_increasing_id().alias("id"), F.col("run").cast("long").alias("run"), F.col("value").cast("double").alias("x"))

    def run(batches):
        held: list[tuple] = []  # id, run and pieces of the block that is being filled
        for b in batches:
            own = b.column(1).to_pylist()
            value = b.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for i, j in zip(cuts, cuts[1:]):
                while i < j:
                    if held and (held[0][1] != own[i] or sum(len(v) for *_, v in held) >= size):
                        yield block(held)
                        held = []
                    k = min(j, i + size - sum(len(v) for *_, v in held))
                    held.append((b.column(0)[i].as_py(), own[i], value[i:k]))
                    i = k
        if held:
            yield block(held)

    def block(held):
        x = np.concatenate([v for *_, v in held])
        cols = [pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([x], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "run", "n", "x"])

    made = checkpointed(dealt.mapInArrow(run, "id long, run long, n long, x array<double>"))
    w = Window.partitionBy("run").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    at = made.select("id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return made.join(at, "id").withColumn("first", F.col("before") == 0)


def _each(blocks: DataFrame, found: Callable, schema: str) -> DataFrame:
    """Columns (id, first, x, start) of every block through ``found(first, x, start)``, which
    returns columns behind the id."""
    types = [{"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}[f.split()[-1]] for f in schema.split(",")]
    names = ["id", *(f.split()[0] for f in schema.split(","))]

    def run(batches):
        for b in batches:
            for id_, first, x, start in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                got = found(first.as_py(), x.values.to_numpy(zero_copy_only=False), start.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()], pa.int64()), *(pa.array([g], t) for g, t in zip(got, types))], names=names)

    return blocks.select("id", "first", "x", "start").mapInArrow(run, f"id long, {schema}")


def _steps(blocks: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """(run, step, out) of blocks and their results (id, out)."""
    rows = blocks.select("id", "run", "before").join(found, "id").select("run", "before", F.posexplode("out").alias("pos", "out"))
    return rows.select("run", (F.col("before") + F.col("pos") + 1).alias("step"), F.col("out").cast(kind).alias("out"))


def _folded(rate: float, x: np.ndarray, state: float | None, gain: float) -> list[float]:
    """States of s = (1 - rate) s + gain x; from None on, the first value is the state."""
    out, keep = [], 1 - rate
    for v in x.tolist():
        state = v if state is None else state * keep + v * gain
        out.append(state)
    return out


def _affine(rows: DataFrame, order: list[str], rate: float, initial: float | None, size: int) -> DataFrame:
    """s = (1 - rate) s + rate x, from ``initial`` or, if that is None, from the first value."""
    blocks = _blocks(rows, order, size)
    reduced = _each(blocks.withColumn("start", F.lit(0.0)), lambda first, x, _: (_folded(rate, x, initial if first else 0.0, rate)[-1],), "shift double")
    sums = reduced.join(blocks.select("id", "run", "n", "first"), "id").repartition("run").sortWithinPartitions("run", "id").select("id", "first", "n", "shift")

    def hand_on(batches):
        state = initial
        for b in batches:
            starts = []
            for first, n, shift in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                starts.append(initial if first else state)
                state = shift if first else (1 - rate) ** n * state + shift
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.float64())], names=["id", "start"])

    starts = sums.mapInArrow(hand_on, "id long, start double")
    out = _each(blocks.join(starts, "id"), lambda first, x, start: (_folded(rate, x, initial if first else start, rate),), "out array<double>")
    return _steps(blocks, out, "double")


def ema(rows: DataFrame, order: list[str], alpha: float, size: int = BLOCK) -> DataFrame:
    """(run, step, out) of (run, value): m = (1 - alpha) m + alpha x, starting with the first value."""
    return _affine(rows, order, alpha, None, size)


def leaky(rows: DataFrame, order: list[str], rate: float, size: int = BLOCK) -> DataFrame:
    """(run, step, out): u = u + rate (x - u), starting from 0."""
    return _affine(rows, order, rate, 0.0, size)


def spikes(rows: DataFrame, order: list[str], leak: float, threshold: float, size: int = BLOCK) -> DataFrame:
    """(run, step, out): whether a leaky membrane fires at each step; firing resets it.
    States that blocks hand on are those of one long pass, bit by bit: a round settles
    the next block of each series at least, and all whose start no longer matters, which a
    reset or enough leak brings about."""
    blocks = _blocks(rows, order, size)

    def fold(x, v):
        out = []
        for value in x.tolist():
            v = v * (1 - leak) + value
            fired = v >= threshold
            out.append(fired)
            v = 0.0 if fired else v
        return v, out

    def ends(of: DataFrame) -> DataFrame:
        return _each(of, lambda first, x, start: (start, fold(x, start)[0]), "start double, stop double")

    known = checkpointed(ends(blocks.withColumn("start", F.lit(0.0))))
    while True:
        w = Window.partitionBy("run").orderBy("id")
        due = F.coalesce(F.lag("stop").over(w), F.lit(0.0))
        asked = blocks.select("id", "run").join(known, "id").withColumn("due", due).filter("NOT due <=> start").select("id", F.col("due").alias("start"))
        again = checkpointed(ends(blocks.join(asked, "id")))
        if again.isEmpty():
            break
        known = checkpointed(known.join(again, "id", "left_anti").union(again))
    out = _each(blocks.join(known.select("id", "start"), "id"), lambda first, x, start: (fold(x, start)[1],), "out array<boolean>")
    return _steps(blocks, out, "boolean")


def rate_code(value: Column, steps: int) -> Column:
    """Spikes of a value at each of ``steps``: its logistic exceeds the step's share (2.L)."""
    chance = 1 / (1 + F.exp(-value))
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda t: (chance > t / float(steps)).cast("int"))


def rms_norm(vector: Column, eps: float = 1e-6) -> Column:
    """A vector over the root of its mean square (2.L)."""
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x) / F.size(vector)
    return F.transform(vector, lambda x: x / F.sqrt(mean + F.lit(eps)))


def fake_quantise(value: Column, scale: Column, levels: int = 127) -> Column:
    """To the nearest of the levels (halves to even) and back."""
    return F.greatest(F.lit(-levels), F.least(F.lit(levels), F.rint(value / scale))) * scale


def polynomial_fit(points: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """(power, coefficient) of the least-squares polynomial (H14): sums of powers in one
    aggregation, and the normal equations of that one row solved on the driver."""
    powers = [F.sum(F.pow(x, F.lit(i))) for i in range(2 * degree + 1)]
    sums = points.agg(*powers, *[F.sum(F.pow(x, F.lit(i)) * F.col(y)) for i in range(degree + 1)]).first()
    left = np.array([[sums[i + j] or 0.0 for j in range(degree + 1)] for i in range(degree + 1)])
    right = np.array([sums[2 * degree + 1 + i] or 0.0 for i in range(degree + 1)])
    scale = np.sqrt(np.diag(left))  # powers of large x differ by many digits
    scale[scale == 0] = 1
    found = np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=None)[0] / scale
    return points.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(found)], "power int, coefficient double")
