"""Streams from Python iterables, and synthetic shards."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.position import scratch
from .drivers import Driver, register

#: Items of an iterable that the driver holds at a time.
CHUNK = 100_000


def iterable_source(spark: SparkSession, source: Iterable | Callable[[], Iterable] = (), schema: str | None = None, item: str = "item"):
    """A stream of the items of an iterable, or of what a callable gives, in their order.

    Dictionaries become columns, other items the column item. Items go to the shared folder CHUNK at a time, so the driver
    never holds more. Without items and without a schema the stream has the column item alone.
    """
    from ..stream import Stream
    from ..operators.elementwise import schema_of
    from pyspark.sql.pandas.types import to_arrow_schema

    items = iter(source() if callable(source) else source)
    named = lambda x: dict(x) if isinstance(x, dict) else {item: x}
    arrow = to_arrow_schema(schema_of(schema)) if schema else None
    frames, at = [], 0
    path = scratch(spark)
    while held := [named(x) for x in islice(items, CHUNK)]:
        table = pa.Table.from_pylist(held, schema=arrow)
        arrow = arrow or table.schema
        table = table.append_column("pos", pa.array(range(at, at + len(held)), pa.int64()))
        frames.append(f"{path}/{at}")
        spark.createDataFrame(table).write.parquet(frames[-1])
        at += len(held)
    if frames:
        return Stream(spark.read.parquet(*frames), ["pos"], True, ("source",))
    return Stream(spark.createDataFrame([], f"{schema or f'{item} string'}, pos long"), ["pos"], True, ("source",))


@register
class DummyShardedDriver(Driver):
    """The numbers 0, 1, ... in shards of equal size: a source for measuring shuffles."""

    name = "dummy_sharded"

    def __init__(self, spark, num_shard: int, shard_size: int, **kw):
        super().__init__(spark, **kw)
        self.num_shard, self.shard_size = num_shard, shard_size

    def keys(self) -> list[str]:
        return [str(i) for i in range(self.num_shard)]

    def get(self, key: str) -> list[int]:
        if key not in self.keys():
            raise KeyError(key)
        return list(range(int(key) * self.shard_size, (int(key) + 1) * self.shard_size))

    def get_df(self) -> DataFrame:
        size = F.lit(self.shard_size)
        ids = self.spark.range(self.num_shard * self.shard_size)
        return ids.select(F.floor(F.col("id") / size).cast("string").alias("shard_key"), (F.col("id") % size).alias("row_in_shard"), F.col("id").alias("item"))
