"""Rank correlation of two orders, and the randomness of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of either column at most, and rows of a range, about, where fewer will do.
RANGES, ROWS = 1000, 20_000


def balance(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of sign(y2 - y1) over all pairs with x1 < x2, by merging: n log(n)**2 steps."""
    order = np.lexsort((y, x))
    x = np.unique(x, return_inverse=True)[1][order]
    y = np.unique(y, return_inverse=True)[1][order]
    n, total, width = len(x), 0, 1
    place, span = np.arange(n), n + 1
    while width < n:  # pairs across the halves of stretches of 2 * width
        part, right = place // (2 * width), place // width % 2 == 1
        low = np.sort(part[~right] * span + y[~right])
        key, begin = part[right] * span + y[right], np.searchsorted(low, part[right] * span)
        less = np.searchsorted(low, key) - begin
        more = np.searchsorted(low, (part[right] + 1) * span) - np.searchsorted(low, key, "right")
        total += int((less - more).sum())
        width *= 2
    # pairs of equal x are in order of y: those that differ in y were counted as 1
    pairs = lambda many: int((many * (many - 1) // 2).sum())
    return total - pairs(np.unique(x, return_counts=True)[1]) + pairs(np.unique(x * span + y, return_counts=True)[1])


def ranged(df: DataFrame, name: str, n: int) -> Column:
    """The number of the range that a value is in, of about n of equal counts; equal values are in one range."""
    cuts = df.agg(F.percentile_approx(name, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(name)))


def kendall_tau(pairs: DataFrame, x: str, y: str, ranges: int | None = None) -> DataFrame:
    """One row, tau: the mean of sign(y2 - y1) over all pairs with x1 < x2 (equal x are not compared), null without any.

    Both columns are cut into ranges. Pairs that share neither range are settled by the counts of the cells, at most
    RANGES squared; those that share one are counted within it, by merging. So no pair is looked at by itself, and a task
    holds one range.
    """
    rows = pairs.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    n = ranges or max(1, min(RANGES, rows.count() // ROWS))
    rows = rows.select("x", "y", ranged(rows, "x", n).alias("a"), ranged(rows, "y", n).alias("b"))

    def inside(key, table):
        """Of one range of x, all its pairs; of one range of y, those of different ranges of x."""
        vx, vy, va = (table.column(c).to_numpy() for c in ("x", "y", "a"))
        total = balance(vx, vy)
        if key[1].as_py():
            for part in np.unique(va):
                total -= balance(vx[va == part], vy[va == part])
        return pa.table({"part": pa.array([total], pa.int64())})

    both = rows.withColumn("by_y", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("k", F.when(F.col("by_y"), F.col("b")).otherwise(F.col("a")))
    near = both.groupBy("k", "by_y").applyInArrow(inside, "part long").agg(F.sum("part")).first()[0] or 0
    cells = np.zeros((n + 1, n + 1), np.int64)
    for r in rows.groupBy("a", "b").count().collect():  # at most RANGES squared
        cells[r[0], r[1]] = r[2]
    above = np.cumsum(cells, axis=0) - cells  # rows of lesser ranges of x, by range of y
    less = np.cumsum(above, axis=1) - above
    more = above.sum(axis=1, keepdims=True) - less - above
    far = int((cells * (less - more)).sum())
    tied = rows.groupBy("x").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    total = int(cells.sum())
    compared = total * (total - 1) // 2 - int(tied)
    return pairs.sparkSession.createDataFrame([((far + near) / compared if compared else None,)], "tau double")


def randomness(shards: int, size: int, buffer: int, initial: int, samples: int = 250, seeds: tuple[int, int] = (1, 2)) -> float:
    """Median |tau| between two buffer-shuffled passes over shuffled shards: 1 for a fixed order, towards 0 for a random one."""
    import random
    from statistics import median

    from ..operators.shuffling import buffer_order

    def trajectory(seed):
        keys = list(range(shards))
        random.Random(seed).shuffle(keys)
        flat = [k * size + i for k in keys for i in range(size)]
        return [flat[i] for i in buffer_order(len(flat), buffer, initial, seed)]

    def tau(a, b):
        place = {v: i for i, v in enumerate(b)}
        y = np.array([place[v] for v in a])
        return balance(np.arange(len(y)), y) * 2 / (len(y) * (len(y) - 1))

    draw = random.Random(seeds[0] * 31 + seeds[1])
    return median(abs(tau(trajectory(draw.random()), trajectory(draw.random()))) for _ in range(samples))
