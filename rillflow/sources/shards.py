"""Stores of gzip shards, <url>/<key>.gz: read and written by Spark tasks, a shard each."""

from __future__ import annotations

import gzip
import re
import secrets
import string
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.elementwise import in_batches, schema_of
from .serializers import SERIALIZERS, JsonSerializer

KEY = r"([^/]+)\.gz$"
#: What a file name cannot have as it is: separators, signs of patterns, and a first character that hides a file.
UNSAFE = re.compile(r"[%/\\*?\[\]{}:\x00-\x1f]|^[_.]")


def hadoop(spark: SparkSession, url: str):
    """(file system, path) of a url, by its scheme."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def listing(spark: SparkSession, url: str, nested: bool = False) -> list[tuple[str, bool]]:
    """(path, is a folder) of what lies in url, sorted; nested: the files at any depth instead. Nothing if url is missing."""
    fs, path = hadoop(spark, url)
    if not fs.exists(path):
        return []
    out, todo = [], [path]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if nested and s.isDirectory():
                todo.append(s.getPath())
            else:
                out.append((s.getPath().toString(), bool(s.isDirectory())))
    return sorted(out)


def put_bytes(spark: SparkSession, url: str, data: bytes, replace: bool = True) -> None:
    fs, path = hadoop(spark, url)
    stream = fs.create(path, replace)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def get_bytes(spark: SparkSession, url: str) -> bytes:
    fs, path = hadoop(spark, url)
    if not fs.exists(path):
        raise KeyError(url)
    stream = fs.open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def random_key(n: int = 16) -> str:
    return "".join(secrets.choice(string.ascii_uppercase + string.digits) for _ in range(n))


def file_name(key: str) -> str:
    """A key as the name of its file: what names cannot have is percent-encoded, other keys are names as they are."""
    return UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", key)


def decoded(name: F.Column) -> F.Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name)


def key_of_path(path: F.Column) -> F.Column:
    return decoded(F.regexp_extract(path, KEY, 1))


class ShardStore:
    """A dataset of shards. format: jsonl or messagepack."""

    def __init__(self, spark: SparkSession, url: str, format: str = "jsonl", clean: bool = False, hook: Callable | None = None):
        self.spark, self.url, self.format = spark, url.rstrip("/"), format
        self.serializer = JsonSerializer(hook) if format == "jsonl" else SERIALIZERS[format]()
        if clean:
            fs, path = hadoop(spark, self.url)
            fs.delete(path, True)

    def path(self, key: str) -> str:
        return f"{self.url}/{file_name(key)}.gz"

    def keys(self) -> list[str]:
        """Shard keys, sorted: one listing, no data is read."""
        names = [p.rsplit("/", 1)[-1] for p, is_dir in listing(self.spark, self.url) if p.endswith(".gz") and not is_dir]
        return sorted(unquote(n[:-3]) for n in names if n[0] not in "._")

    def keys_df(self) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in self.keys()], "shard_key string")

    def set(self, value, key: str | None = None) -> str:
        """Write one sample or a list of samples as a shard from the driver; the key is drawn if none is given."""
        key = key or random_key()
        put_bytes(self.spark, self.path(key), self.serializer.dump_shard(value if isinstance(value, list) else [value]))
        return key

    def get(self, key: str) -> Iterator:
        """The samples of a shard, in order."""
        return self.serializer.load_shard(get_bytes(self.spark, self.path(key)))

    def read(self, schema: str, keys: DataFrame | list[str] | None = None) -> DataFrame:
        """shard_key, row_in_shard and the columns of schema. keys prunes shards before any is opened.

        A file is read by one task, which numbers its lines as it goes; nothing is shuffled. JSON shards without a hook are
        decoded in the JVM; others by the serializer, in Arrow batches.
        """
        fields = schema_of(schema).fields
        out = StructType([StructField("shard_key", StringType()), StructField("row_in_shard", LongType()), *fields])
        if keys is not None:
            wanted = keys if isinstance(keys, list) else [r[0] for r in keys.select("shard_key").collect()]
            paths = [self.path(k) for k in wanted]
        else:
            paths = [f"{self.url}/*.gz"] if self.keys() else []
        if not paths:
            return self.spark.createDataFrame([], out)
        if self.format == "jsonl" and self.serializer.hook is None:
            files = self.spark.read.text(paths, wholetext=True)
            files = files.select(key_of_path(decoded(F.col("_metadata.file_name"))).alias("shard_key"), "value")
            lines = files.select("shard_key", F.posexplode(F.split("value", "\n")).alias("row_in_shard", "line"))
            parsed = lines.where("line <> ''").select("shard_key", F.col("row_in_shard").cast("long"), F.from_json("line", StructType(fields)).alias("s"))
            return parsed.select("shard_key", "row_in_shard", "s.*")
        serializer, names, arrow = self.serializer, [f.name for f in fields], to_arrow_schema(out)

        def samples(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for key, content in zip(batch.column("shard_key"), batch.column("content"), strict=True):
                    for i, s in enumerate(serializer.load_shard(content.as_py())):
                        yield {"shard_key": key.as_py(), "row_in_shard": i, **{n: s.get(n) for n in names}}

        files = self.spark.read.format("binaryFile").load(paths).select(key_of_path(F.col("path")).alias("shard_key"), "content")
        return files.mapInArrow(lambda batches: in_batches(samples(batches), arrow), out)

    def write(self, df: DataFrame, shard: str, order: str) -> None:
        """A shard for each value of shard, rows by order, columns other than these two; the values are the keys.

        One shuffle by key. Each task streams its rows into the shards, under names that readers do not see, and gives a
        shard its name when it is complete; so a task that is lost and run again replaces what it wrote, and a shard that
        is written over stays whole until then.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        names = [c for c in df.columns if c not in (shard, order)]
        plain = self.format == "jsonl"
        value = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value") if plain else F.struct(*names).alias("value")
        rows = df.select(F.col(shard).cast("string").alias("_key"), F.col(order).alias("_order"), value)
        rows = rows.repartition(n, "_key").sortWithinPartitions("_key", "_order").select("_key", "value")
        fs, path = hadoop(self.spark, self.url)
        fs.mkdirs(path)
        serializer, url = self.serializer, self.url

        def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs as files

            system, root = files.FileSystem.from_uri(url if "://" in url else f"file://{url}")
            now = part = stream = None
            done = []

            def finish():
                stream.close()
                raw.close()
                system.move(part, f"{root}/{file_name(now)}.gz")
                done.append(now)

            for batch in batches:
                for key, item in zip(batch.column("_key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if stream is None or key != now:
                        if stream is not None:
                            finish()
                        now, part = key, f"{root}/_{uuid.uuid4().hex}"
                        raw = system.open_output_stream(part, compression=None)
                        stream = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)
                    stream.write(item.encode() + b"\n" if plain else serializer.dumps(item))
            if stream is not None:
                finish()
            yield pa.RecordBatch.from_pydict({"key": pa.array(done, pa.string())})

        rows.mapInArrow(put, "key string").agg(F.count("*")).first()
