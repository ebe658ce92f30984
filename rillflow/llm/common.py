"""Small helpers that the training-data operators share."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.position import scratch

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A semi-join filter of at most this many 4-byte residues may be broadcast: 4 MB, whatever the input.
RESIDUES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches small enough that long texts do not pile up in a worker, for the time of a job; the session's own
    setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if int(was) <= 0 or int(was) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it outlives any executor and is computed once. It is deleted with
    the application, or by position.cleaned."""
    spark = df.sparkSession
    path = f"{scratch(spark)}-{tag}"
    if _passing:
        _passing[-1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Tables that are materialised inside are deleted at the end, but for those given to what this yields: a function
    that materialises a table and keeps it."""
    made, kept = [], []
    _passing.append(made)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = materialise(df, tag)
        kept.append(made.pop())
        return out

    try:
        yield keep
    finally:
        _passing.pop()
        if _passing:
            _passing[-1] += kept
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def residue(col: str, n: int = RESIDUES):
    """A null-safe residue of a key, for the bounded semi-join filter."""
    return F.pmod(F.xxhash64(F.col(col), F.col(col).isNull()), F.lit(n)).cast("int")


def prefilter(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows of df whose key may be in keys (a superset): what is broadcast has at most RESIDUES rows by construction."""
    small = keys.select(residue(col).alias("_res")).distinct()
    return df.withColumn("_res", residue(col)).join(F.broadcast(small), "_res", "left_semi").drop("_res")


#: Rows of texts that go to a Python worker at once, and characters that it works on at once.
BATCH_ROWS, BATCH_CHARS = 500, 1 << 21


def texts_of(batch, column: str):
    """(first row, texts) of stretches of a batch, of about BATCH_CHARS characters; one longer text is a stretch."""
    values = batch.column(column)
    at, held, size = 0, [], 0
    for i in range(len(values)):
        held.append(values[i].as_py())
        size += len(held[-1] or "")
        if size >= BATCH_CHARS:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def released() -> None:
    """Give a task's freed memory back to the machine: workers outlive tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


class Codes(dict):
    """Numbers keys in order of first sight; fresh lists those not yet looked at by the owner."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, key):
        self[key] = code = len(self)
        self.fresh.append(key)
        return code

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def taken(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every (start, length), end to end."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root) of every node of edges (u, v): alternating large and small stars until nothing changes.

    Each round is a few shuffles of at most twice the edges; a hub's edges are pre-aggregated to their minimum before
    they move, and the joins on it can be split as skewed. Nodes are longs; the root is the smallest of its component.
    """
    spark = edges.sparkSession
    down = lambda rows: rows.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(down(edges), tag)
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(down(small.union(low.select("u", F.col("m").alias("v")))), tag)
    if not seen:
        return spark.createDataFrame([], "node long, root long")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
