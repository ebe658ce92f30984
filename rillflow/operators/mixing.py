"""Streams from several sources: round robin, interleaving, and seeded sampling with or without oversampling."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .position import written

#: Draws that the driver holds at a time.
CHUNK = 500_000


def round_robin_segments(sizes: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(source, lo, hi, base, alive, rank): rows lo <= i < hi of source lie at base + (i - lo) * alive + rank.

    One row of each live source in turn; who turns out empty leaves, and the turn begins again with the first that is
    left. So a cycle that meets an end is cut short: those before it have gone, those after it wait for the next cycle.
    """
    alive, at, base, out = list(range(len(sizes))), [0] * len(sizes), 0, []
    while alive:
        left = [sizes[s] - at[s] for s in alive]
        whole = min(left)
        if whole:
            out += [(s, at[s], at[s] + whole, base, len(alive), rank) for rank, s in enumerate(alive)]
            base += whole * len(alive)
            for s in alive:
                at[s] += whole
        gone = left.index(whole)  # the first to be found empty; those before it give one row more
        for rank, s in enumerate(alive[:gone]):
            out.append((s, at[s], at[s] + 1, base + rank, 1, 0))
            at[s] += 1
        base += gone
        alive.pop(gone)
    return out


def round_robin(df: DataFrame, source: str, index: str = "row_idx", sources: list | None = None) -> DataFrame:
    """df (source, dense index by source, ...) with pos. Only the counts by source go to the driver; the plan of segments,
    at most twice the square of the sources, comes back as a broadcast range join."""
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}
    names = sorted(counts) if sources is None else sources
    plan = [(names[s], *rest) for s, *rest in round_robin_segments([counts.get(x, 0) for x in names])]
    kind = df.schema[source].dataType.simpleString()
    segments = df.sparkSession.createDataFrame(plan, f"_s {kind}, _lo long, _hi long, _base long, _alive int, _rank int")
    joined = df.join(F.broadcast(segments), (F.col(source) == F.col("_s")) & (F.col(index) >= F.col("_lo")) & (F.col(index) < F.col("_hi")))
    return joined.withColumn("pos", F.col("_base") + (F.col(index) - F.col("_lo")) * F.col("_alive") + F.col("_rank")).drop("_s", "_lo", "_hi", "_base", "_alive", "_rank")


def interleaved(df: DataFrame, ordinal: str, index: str = "row_idx") -> DataFrame:
    """Row i of every source that has one, in order of the sources, then row i + 1: order by (index, ordinal)."""
    from .position import with_position

    return with_position(df, [index, ordinal])


class Sampling:
    """Weighted sampling with oversampling: iterating gives the schedule as arrays (kept source, epoch, row), a chunk at a
    time, and leaves restarts and samples, a number for each kept source.

    Each draw picks a source; one at its end starts over and the draw gives nothing. It ends when every source has started
    over, or one has max_reinits times (0 never matches). Sources of a probability up to threshold are left out.
    """

    def __init__(self, sizes: list[int], probas: list[float] | None = None, seed: int | None = None, max_reinits: int | None = None, threshold: float = 1e-3):
        if probas is not None and len(probas) != len(sizes):
            raise ValueError("one probability a source")
        self.kept = [i for i in range(len(sizes)) if probas is None or probas[i] > threshold]
        self.sizes = [sizes[i] for i in self.kept]
        self.edges = None
        if probas is not None and self.kept:
            total = sum(probas[i] for i in self.kept)
            self.edges = np.cumsum(np.array([probas[i] for i in self.kept]) / total)
            self.edges /= self.edges[-1]
        self.most = max_reinits
        self.state = np.random.RandomState(np.random.MT19937(seed))
        self.restarts, self.samples = [0] * len(self.kept), [0] * len(self.kept)

    def draws(self, many: int):
        if self.edges is None:
            return [self.state.randint(0, len(self.kept), size=1)[0] for _ in range(many)]
        return self.edges.searchsorted(self.state.random_sample(many), side="right").tolist()

    def __iter__(self):
        n = len(self.kept)
        at, self.restarts, open_ = [0] * n, [0] * n, n > 0
        while open_:
            held = []
            while open_ and len(held) < CHUNK:
                for k in self.draws(4096):
                    if at[k] < self.sizes[k]:
                        held.append((k, self.restarts[k], at[k]))
                        at[k] += 1
                        self.samples[k] += 1
                        continue
                    at[k] = 0
                    self.restarts[k] += 1
                    if min(self.restarts) > 0 or max(self.restarts) == self.most:
                        open_ = False
                        break
            yield np.array(held, np.int64).reshape(-1, 3)


def without_oversampling(sizes: list[int], probas: list[float] | None = None, seed: object = None):
    """Arrays (source, 0, row), a chunk at a time, of weighted draws in which an empty source leaves and the others' weights
    are scaled up."""
    weights = [1.0 / len(sizes)] * len(sizes) if probas is None else list(probas)
    if len(weights) != len(sizes) or abs(sum(weights) - 1) > 1e-9 or min(weights, default=1) <= 0:
        raise ValueError("probabilities must be positive, one a source, and sum to 1")
    draw, live, at, held = random.Random(seed), list(range(len(sizes))), [0] * len(sizes), []
    while live:
        s = draw.choices(live, [weights[i] for i in live])[0]
        if at[s] < sizes[s]:
            held.append((s, 0, at[s]))
            at[s] += 1
        else:
            live.remove(s)
        if len(held) >= CHUNK or not live:
            yield np.array(held, np.int64).reshape(-1, 3)
            held = []


def plan_of(spark: SparkSession, chunks, names: list, kind: str, source: str, index: str) -> DataFrame:
    """A drawn schedule as a table (pos, source, epoch, index). The draws are one sequence, so they are made in one place,
    but chunk by chunk: each goes to the shared folder as it is made, and the driver holds one at a time."""
    labels, at = np.array(names, object), 0

    def tables():
        nonlocal at
        for x in chunks:
            cols = [np.arange(at, at + len(x)), labels[x[:, 0]] if len(x) else [], x[:, 1].astype(np.int32), x[:, 2]]
            at += len(x)
            yield pa.table(dict(zip(["pos", source, "epoch", index], cols, strict=True)))

    return written(spark, tables(), f"pos long, {source} {kind}, epoch int, {index} long")


def scheduled(df: DataFrame, schedule: DataFrame, source: str, index: str = "row_idx") -> DataFrame:
    """df's rows at the positions of schedule (source, index, pos, ...): a row comes as often as the schedule has it."""
    return schedule.join(df, [source, index])


def sizes_of(df: DataFrame, source: str) -> dict:
    """Rows by source: a row a source goes to the driver."""
    return {r[0]: r[1] for r in df.groupBy(source).count().collect()}


def sampled(df: DataFrame, source: str, probas: dict | None = None, seed: int = 42, max_reinits: int | None = None, index: str = "row_idx", sources: list | None = None) -> DataFrame:
    """df (source, dense index by source) in the order of a sampling schedule: pos, epoch."""
    return sampled_with_counts(df, source, probas, seed, max_reinits, index, sources)[0]


def sampled_with_counts(df: DataFrame, source: str, probas: dict | None = None, seed: int = 42, max_reinits: int | None = None, index: str = "row_idx", sources: list | None = None) -> tuple[DataFrame, dict]:
    """The same, and {source: (samples, restarts)} of the sources that were not left out."""
    counts = sizes_of(df, source)
    names = sorted(counts) if sources is None else sources
    plan = Sampling([counts.get(x, 0) for x in names], None if probas is None else [probas[x] for x in names], seed, max_reinits)
    kept = [names[i] for i in plan.kept]
    rows = plan_of(df.sparkSession, plan, kept, df.schema[source].dataType.simpleString(), source, index)
    return scheduled(df, rows, source, index), {k: (n, r) for k, n, r in zip(kept, plan.samples, plan.restarts, strict=True)}


def sampled_once(df: DataFrame, source: str, probas: dict | None = None, seed: object = 42, index: str = "row_idx", sources: list | None = None) -> DataFrame:
    """df (source, dense index by source) with pos: each row once, the source of each position drawn by weight."""
    counts = sizes_of(df, source)
    names = sorted(counts) if sources is None else [x for x in sources if x in counts]
    drawn = without_oversampling([counts[x] for x in names], None if probas is None else [probas[x] for x in names], seed)
    rows = plan_of(df.sparkSession, drawn, names, df.schema[source].dataType.simpleString(), source, index).drop("epoch")
    return scheduled(df, rows, source, index)


def statistics(mix: DataFrame, source: str, sizes: DataFrame) -> DataFrame:
    """Per source of a mix: n_samples, ratio of all, epochs = n_samples / size. sizes: source, size."""
    from pyspark.sql import Window

    n = mix.groupBy(source).agg(F.count("*").alias("n_samples"))
    n = n.withColumn("ratio", F.col("n_samples") / F.sum("n_samples").over(Window.partitionBy(F.lit(0))))
    return n.join(sizes, source).withColumn("epochs", F.col("n_samples") / F.col("size"))
