"""The dense position of every row in a total order, computed without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_LOCAL = (1 << 33) - 1


SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by the session's spark.checkpoint.dir; a local master may do without, as
    its executors are in the driver's machine."""
    where = spark.conf.get(SHARED, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that the cluster shares")
        where = f"file://{tempfile.gettempdir()}"
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, in one folder for the application: it is deleted when the driver's JVM ends, or by
    cleaned before that."""
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/rillflow-{context.applicationId}"
    if getattr(context, "_rillflow_root", None) != root:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        context._rillflow_root = root
    return f"{root}/{uuid.uuid4().hex}"


def cleaned(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; DataFrames that read them cannot be run again."""
    context = spark.sparkContext
    root, context._rillflow_root = getattr(context, "_rillflow_root", None), None
    if root:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, tables: Iterable[pa.Table], schema: str) -> DataFrame:
    """Tables that the driver makes one by one, as one DataFrame: each is written to the shared folder before the next."""
    fields = StructType.fromDDL(schema)
    path, kinds = scratch(spark), to_arrow_schema(fields)
    spark.createDataFrame([], fields).write.parquet(path)
    for t in tables:
        if t.num_rows:
            spark.createDataFrame(t.cast(kinds), fields).write.mode("append").parquet(path)
    return spark.read.schema(fields).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: range bounds and partition numbers are drawn once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, order_by: list[str], name: str = "pos") -> DataFrame:
    """df with its 0-based dense position in order_by, which must be unique.

    Rows are range-partitioned and sorted within partitions; monotonically_increasing_id then holds the partition and the
    row's place in it, and the running counts of partitions (a row each) make places dense.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order_by]
    rows = settled(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_mid", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    offsets = F.broadcast(offsets)  # a row for each of the n partitions
    joined = rows.withColumn("_part", part).join(offsets, "_part")
    return joined.withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOCAL))).cast("long")).drop("_part", "_mid", "_off")


def with_group_position(df: DataFrame, group: str, order_by: list[str], name: str = "row_idx") -> DataFrame:
    """df with the 0-based dense position of every row in its group: the position among all rows, less that of the group's
    first row. A group of any size spreads over tasks."""
    rows = with_position(df, [group, *order_by], name)
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min(name).alias("_first"))
    joined = rows.join(first, F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(name, F.col(name) - F.col("_first")).drop("_g", "_first")
