"""Rolling throughput."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"bytes": 0, "KB": 10, "MB": 20, "GB": 30}


@dataclass
class MetricsConf:
    iops: bool = True
    throughput: bool = True
    throughput_unit: str = "MB"

    def asdict(self) -> dict:
        return asdict(self)


def iops(count: Column, seconds: Column) -> Column:
    return F.round(count / seconds, 2)


def throughput(size: Column, seconds: Column, unit: str = "MB") -> Column:
    if unit not in UNITS:
        logging.getLogger(__name__).warning("unknown unit %s, using bytes", unit)
    return F.round(size / F.lit(float(1 << UNITS.get(unit, 0))) / seconds, 2)


def monitor(df: DataFrame, time: str, size: Column, window: int = 5, conf: MetricsConf | None = None, prefix: str = "", order: str = "pos", block: int = 100_000) -> DataFrame:
    """(order, iops, throughput) from the window-th row on: window items over the time since window-1 rows before, and the
    bytes of the last window-1 rows. A disabled metric is 0; both disabled give no rows.

    The frame crosses rows by position: rows are dealt into blocks of positions, and a block also gets the window-1 rows
    before it, so that no task sees more than a block.
    """
    conf = conf or MetricsConf()
    if window < 2:
        raise ValueError("a window needs two rows or more")
    cells = df.select(F.col(order), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), size.cast("long").alias("b"))
    home = F.floor(F.col(order) / block)
    spill = F.floor((F.col(order) + (window - 1)) / block)
    rows = cells.withColumn("_home", F.explode(F.array_distinct(F.array(home, spill))))
    w = Window.partitionBy("_home").orderBy(order)
    seconds = (F.col("t") - F.lag("t", window - 1).over(w)) / 1e6
    total = F.sum("b").over(w.rowsBetween(-(window - 2), 0))
    count = iops(F.lit(window), seconds) if conf.iops else F.lit(0.0)
    rate = throughput(total, seconds, conf.throughput_unit) if conf.throughput else F.lit(0.0)
    out = rows.select(F.col(order), "_home", home.alias("_own"), count.alias(f"{prefix}iops"), rate.alias(f"{prefix}throughput"))
    out = out.where((F.col("_home") == F.col("_own")) & (F.col(order) >= window - 1)).drop("_home", "_own")
    return out if conf.iops or conf.throughput else out.limit(0)


def reports(metrics: DataFrame, conf: MetricsConf | None = None, prefix: str = "") -> Iterator[dict]:
    """The rows of monitor in order, as a callback gets them: a value for each metric under its name and unit."""
    conf = conf or MetricsConf()
    rate = f"{prefix}throughput {conf.throughput_unit}/s"
    for r in metrics.orderBy(metrics.columns[0]).toLocalIterator(prefetchPartitions=True):
        yield {f"{prefix}IOPS number/s": r[1], rate: r[2]}


def getsize(item) -> int:
    """Bytes of a Python item: an array's own, or those of its pickled form."""
    import pickle

    return int(item.nbytes) if hasattr(item, "nbytes") else len(pickle.dumps(item))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as JSON: a portable stand-in for a serialised length."""
    return F.octet_length(F.to_json(F.struct(*df.columns)))
