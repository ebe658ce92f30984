"""Count windows over a Structured Streaming source, by foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import batched, sliding


class CountWindows:
    """A foreachBatch function that gives complete batches or windows by pos, whatever order rows arrive in.

    Rows wait in a table until all positions before them have come; what is complete goes to sink(df, epoch), and only the
    tail that later windows need stays. The table and the next position lie under path in the shared folder; a batch that
    is run again after a failure starts from the state of the batch before it, so each window is given once.
    """

    def __init__(self, path: str, sink: Callable[[DataFrame, int], None], size: int, stride: int | None = None):
        self.path, self.sink, self.size, self.stride = path.rstrip("/"), sink, size, stride or size

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = batch
        from ..sources.shards import listing

        done = sorted(int(p.rsplit("=", 1)[-1]) for p, is_dir in listing(spark, self.path) if is_dir and "/epoch=" in p)
        before = [e for e in done if e < epoch]
        first = 0
        if before:
            state = spark.read.parquet(f"{self.path}/epoch={before[-1]}")
            first = state.agg(F.max("_next")).first()[0]
            held = state.where("not _mark").drop("_next", "_mark").unionByName(batch)
        ready = self._ready(held, first)
        last_start = (ready - self.size) // self.stride * self.stride if ready >= self.size else -self.stride
        upto = max(first, last_start + self.stride)
        rows = held.where((F.col("pos") >= first) & (F.col("pos") < ready)).withColumn("pos", F.col("pos") - first)
        out = batched(rows, self.size) if self.stride == self.size else sliding(rows, self.size, self.stride)
        key = "batch_id" if self.stride == self.size else "win_start"
        shift = first // self.size if self.stride == self.size else first
        self.sink(out.withColumn(key, F.col(key) + shift), epoch)
        tail = held.where(F.col("pos") >= upto).withColumn("_next", F.lit(upto).cast("long")).withColumn("_mark", F.lit(False))
        mark = spark.createDataFrame([(upto, True)], "_next long, _mark boolean")
        tail.unionByName(mark, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    @staticmethod
    def _ready(held: DataFrame, first: int) -> int:
        """The first position from first on that has not come yet."""
        p = held.where(F.col("pos") >= first).select("pos").distinct()
        gap = p.select((F.col("pos") + 1).alias("pos")).join(p, "pos", "left_anti").agg(F.min("pos")).first()[0]
        has_first = not p.where(F.col("pos") == first).isEmpty()
        return gap if has_first else first
