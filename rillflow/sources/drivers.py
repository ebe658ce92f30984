"""Drivers: a uniform way from a source's address to a DataFrame, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import ShardStore, get_bytes, hadoop, listing, put_bytes

DRIVERS: dict[str, type[Driver]] = {}


def register(cls: type[Driver]) -> type[Driver]:
    """Make a driver known by its name; a class decorator, and the way plugins add theirs."""
    DRIVERS[cls.name] = cls
    return cls


def list_driver_names() -> list[str]:
    return sorted(DRIVERS)


class Driver:
    name = ""

    def __init__(self, spark: SparkSession, url: str = "", catalog=None, storage_options: dict | None = None, **kwargs):
        self.spark, self.url, self.catalog = spark, url, catalog
        self.storage_options, self.kwargs = dict(storage_options or {}), kwargs


class DataFrameDriver(Driver):
    """Tabular files. Options: those of the driver, then storage_options, then those of the call; hooks then run in order."""

    format = ""
    defaults: dict = {}

    def __init__(self, spark, url="", df_hooks: list[Callable[[DataFrame], DataFrame]] = (), read_kwargs: dict | None = None, **kw):
        super().__init__(spark, url, **kw)
        self.df_hooks, self.read_kwargs = list(df_hooks), dict(read_kwargs or {})

    def load(self, options: dict) -> DataFrame:
        return self.spark.read.format(self.format).options(**options).load(self.url)

    def get_df(self, **read_kwargs) -> DataFrame:
        df = self.load(self.defaults | self.read_kwargs | self.storage_options | read_kwargs)
        for hook in self.df_hooks:
            df = df.transform(hook)
        return df

    def get_iter(self, **read_kwargs):
        """Rows as Python objects, in the order in which Spark reads them."""
        return self.get_df(**read_kwargs).toLocalIterator(prefetchPartitions=True)

    def cached(self, **read_kwargs) -> DataFrame:
        """get_df, read once from its source and then from the executors' disks, for many passes over a remote file."""
        from pyspark import StorageLevel

        return self.get_df(**read_kwargs).persist(StorageLevel.DISK_ONLY)


@register
class CsvDriver(DataFrameDriver):
    name, format, defaults = "csv", "csv", {"header": True, "inferSchema": True}


@register
class ParquetDriver(DataFrameDriver):
    name, format = "parquet", "parquet"


@register
class FeatherDriver(DataFrameDriver):
    """Arrow files: each is decoded by the task that reads it."""

    name = "feather"

    def load(self, options: dict) -> DataFrame:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = self.spark.read.format("binaryFile").load(self.url).select("content")
        first = files.limit(1).collect()
        if not first:
            raise FileNotFoundError(self.url)
        schema = from_arrow_schema(_feather(first[0][0]).schema)

        def run(batches):
            for batch in batches:
                for content in batch.column("content"):
                    yield from _feather(content.as_py()).to_batches()

        return files.mapInArrow(run, schema)


def _feather(content):
    import pyarrow as pa
    from pyarrow import feather

    return feather.read_table(pa.BufferReader(bytes(content)))


@register
class ExcelDriver(DataFrameDriver):
    """The first sheet by default; needs an Excel package for pandas and says so if there is none."""

    name = "excel"

    def load(self, options: dict) -> DataFrame:
        import io

        import pandas as pd

        content = self.spark.read.format("binaryFile").load(self.url).select("content").first()[0]
        try:
            return self.spark.createDataFrame(pd.read_excel(io.BytesIO(bytes(content)), **options))
        except ImportError as e:
            raise ImportError("reading Excel files needs the optional package openpyxl") from e


@register
class FileDriver(Driver):
    """One file, whole: as text lines or bytes."""

    name = "file"

    def lines(self) -> DataFrame:
        return self.spark.read.text(self.url)

    def content(self) -> DataFrame:
        return self.spark.read.format("binaryFile").load(self.url)

    def open(self, mode: str = "r", create_if_not_exists: bool = False):
        """The file as a Python file object, on any file system that the session knows: what is read is read at once, what
        is written goes to its place when the object is closed."""
        import io

        if "r" in mode:
            data = get_bytes(self.spark, self.url)
            return io.BytesIO(data) if "b" in mode else io.StringIO(data.decode())
        fs, path = hadoop(self.spark, self.url)
        if not create_if_not_exists and not fs.exists(path.getParent()):
            raise FileNotFoundError(self.url)
        before = get_bytes(self.spark, self.url) if "a" in mode and fs.exists(path) else b""
        return _Written(self.spark, self.url, before, "b" in mode)


class _Written:
    """A file that is written when it is closed."""

    def __init__(self, spark, url: str, before: bytes, binary: bool):
        self.spark, self.url, self.parts, self.binary, self.closed = spark, url, [before], binary, False

    def write(self, value) -> int:
        self.parts.append(bytes(value) if self.binary else value.encode())
        return len(value)

    def close(self) -> None:
        if not self.closed:
            put_bytes(self.spark, self.url, b"".join(self.parts))
            self.closed = True

    def __enter__(self):
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()


@register
class DirectoryDriver(Driver):
    """Raw files of a folder: path relative to it, and content."""

    name = "directory"

    def get_df(self) -> DataFrame:
        root = self.url.rstrip("/")
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return df.select(F.regexp_extract("path", f"{root.split('://')[-1].lstrip('/')}/(.*)$", 1).alias("key"), "content")

    def keys(self) -> list[str]:
        return [r[0] for r in self.get_df().select("key").orderBy("key").collect()]


class StoreDriver(Driver):
    """A store of shards by key."""

    format = "jsonl"

    def __init__(self, spark, url="", schema: str | None = None, deser_hook=None, store=None, **kw):
        if store is not None:
            raise ValueError("give a url, not a store")
        super().__init__(spark, url, **kw)
        self.schema, self.hook = schema, deser_hook

    @property
    def store(self) -> ShardStore:
        return ShardStore(self.spark, self.url, self.format, hook=self.hook)

    def keys(self) -> list[str]:
        return self.store.keys()

    def get(self, key: str):
        return self.store.get(key)

    def get_df(self, keys: DataFrame | list[str] | None = None, schema: str | None = None) -> DataFrame:
        return self.store.read(schema or self.schema, keys)

    def get_stream(self, key_seed=None, key_hooks: list[Callable] = (), item_seed=None, item_buffer: int = 1, schema: str | None = None):
        """Keys, shuffled if key_seed, through the hooks (functions of a keys stream), to rows; items shuffled in blocks.

        Shards that the hooks leave out are never opened."""
        from ..stream import Stream

        keys = Stream(self.store.keys_df(), ["shard_key"])
        if key_seed is not None:
            keys = keys.shuffle(seed=key_seed)
        for hook in key_hooks:
            if not callable(hook):
                raise ValueError("a key hook must be callable")
            keys = hook(keys)
        keys = keys.indexed()
        rows = self.get_df(keys.df, schema).join(F.broadcast(keys.df.select("shard_key", F.col("pos").alias("_shard_pos"))), "shard_key")
        out = Stream(rows, ["_shard_pos", "row_in_shard"], False, keys.lineage)
        return out.shuffle(size=item_buffer, seed=item_seed) if item_buffer > 1 else out

    def get_iter(self, flatten: bool = True, **how):
        """The samples in the order of get_stream, or without flatten a list of samples for each shard, in order of keys."""
        if flatten:
            return iter(self.get_stream(**how))
        if how:
            raise ValueError("shards as lists come in order of their keys")
        return (list(self.get(k)) for k in self.keys())


@register
class JsonlDriver(StoreDriver):
    name, format = "jsonl", "jsonl"


@register
class MessagepackDriver(StoreDriver):
    name, format = "messagepack", "messagepack"


def decoder(compressor: dict | None) -> Callable[[bytes], bytes]:
    """What undoes an array's compressor: none, zlib, gzip, zstd; others, Blosc among them, through numcodecs if it is there."""
    import zlib

    if compressor is None:
        return bytes
    if compressor["id"] in ("zlib", "gzip"):
        return lambda raw: zlib.decompress(raw, 47)
    if compressor["id"] == "zstd":
        import zstandard

        return lambda raw: zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    try:
        import numcodecs
    except ImportError as e:
        raise ImportError(f"chunks of compressor {compressor['id']} need the optional package numcodecs") from e
    return numcodecs.get_codec(compressor).decode


def write_array(spark: SparkSession, url: str, key: str, array, chunks: list[int] | None = None, attrs: dict | None = None) -> None:
    """An array of a version-2 hierarchy, with zlib chunks, from the driver; written over if it is there."""
    import json
    import zlib
    from itertools import product

    import numpy as np

    array = np.asarray(array)
    chunks = list(chunks or array.shape)
    root = f"{url.rstrip('/')}/{key.strip('/')}"
    fs, path = hadoop(spark, root)
    fs.delete(path, True)
    for at in product(*[range(-(-s // c)) for s, c in zip(array.shape, chunks, strict=True)]):
        block = np.zeros(chunks, array.dtype)
        part = array[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        put_bytes(spark, f"{root}/{'.'.join(map(str, at)) or '0'}", zlib.compress(block.tobytes()))
    meta = {"zarr_format": 2, "shape": list(array.shape), "chunks": chunks, "dtype": array.dtype.str, "compressor": {"id": "zlib", "level": 6}, "fill_value": 0, "order": "C", "filters": None}
    put_bytes(spark, f"{root}/.zarray", json.dumps(meta).encode())
    put_bytes(spark, f"{root}/.zattrs", json.dumps(attrs or {}).encode())


@register
class ZarrDriver(Driver):
    """Arrays of a version-2 hierarchy: keys and metadata from the JSON files; raw and zlib chunks are decoded by tasks."""

    name = "zarr"

    def keys(self, prefix: str = "") -> list[str]:
        """Names one level below prefix; hidden files are left out."""
        return [p.rstrip("/").rsplit("/", 1)[-1] for p, _ in listing(self.spark, f"{self.url.rstrip('/')}/{prefix}".rstrip("/")) if not p.rsplit("/", 1)[-1].startswith(".")]

    def get_iter(self, fetcher: Callable | None = None, flatten: bool = False):
        """What fetcher(array row) gives for every array, in order of keys, or the rows themselves; with flatten what it
        gives is iterated. A fetcher runs in the driver on rows that tasks have decoded."""
        rows = self.get_df().orderBy("key").toLocalIterator(prefetchPartitions=True)
        items = (fetcher(r) if fetcher else r for r in rows)
        return (x for item in items for x in item) if flatten else items

    def fetched(self, fetcher: Callable[[dict], dict], schema: str) -> DataFrame:
        """The same by tasks: a row of schema for every array."""
        from ..operators.elementwise import map_rows

        return map_rows(self.get_df(), fetcher, schema)

    def get_df(self) -> DataFrame:
        """key, data (flat, as doubles), shape, dtype and attrs of every array.

        Spark's listing leaves out names that begin with a dot, so the small metadata files are read by the driver; chunks
        are read and decoded by tasks, an array each.
        """
        root = self.url.rstrip("/")
        bare = root.split("://")[-1].rstrip("/")
        metas = {}
        for path, _ in listing(self.spark, root, nested=True):
            folder, name = path.rsplit("/", 1)
            if name in (".zarray", ".zattrs"):
                key = folder[folder.index(bare) + len(bare) :].strip("/")
                metas.setdefault(key, {})[name] = get_bytes(self.spark, path).decode()
        rows = [(k, m[".zarray"], m.get(".zattrs", "{}")) for k, m in metas.items() if ".zarray" in m]
        meta = self.spark.createDataFrame(rows, "key string, meta string, attributes string")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        files = files.select(F.regexp_extract("path", f"{bare.lstrip('/')}/(.*)/[^/]+$", 1).alias("key"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")

        def build(pdf):
            import json
            from itertools import product

            import numpy as np
            import pandas as pd

            parts = {f: bytes(c) for f, c in zip(pdf["file"], pdf["content"], strict=True) if f}
            meta = json.loads(pdf["meta"].iloc[0])
            unpack = decoder(meta.get("compressor"))
            shape, chunks = meta["shape"], meta["chunks"]
            out = np.full(shape, meta.get("fill_value") or 0, dtype=meta["dtype"])
            for at in product(*[range(-(-s // c)) for s, c in zip(shape, chunks, strict=True)]):
                raw = parts.get(".".join(map(str, at)) or "0")
                if raw is None:
                    continue
                block = np.frombuffer(unpack(raw), meta["dtype"]).reshape(chunks, order=meta.get("order", "C"))
                where = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(at, chunks, shape, strict=True))
                out[where] = block[tuple(slice(0, w.stop - w.start) for w in where)]
            attrs = {k: json.dumps(v) for k, v in json.loads(pdf["attributes"].iloc[0]).items()}
            return pd.DataFrame([(pdf["key"].iloc[0], out.astype(float).ravel().tolist(), list(shape), meta["dtype"], attrs)], columns=["key", "data", "shape", "dtype", "attrs"])

        return meta.join(files, "key", "left").groupBy("key").applyInPandas(build, "key string, data array<double>, shape array<int>, dtype string, attrs map<string,string>")


@register
class SourceCombiner(Driver):
    """Named subsets of a catalogue as one source."""

    name = "source_combiner"

    def __init__(self, spark, subsets: dict[str, tuple[str, int]], catalog=None, **kw):
        super().__init__(spark, catalog=catalog, **kw)
        self.subsets = dict(subsets)

    def driver(self, subset: str) -> Driver:
        identifier, version = self.subsets[subset]
        return self.catalog[identifier, version].get_driver(self.spark)

    def get_df(self, subset: str | None = None, **kw) -> DataFrame:
        """One subset, or all by name with a subset column."""
        if subset is not None:
            return self.driver(subset).get_df(**kw)
        return combined({s: self.driver(s).get_df(**kw) for s in self.subsets})

    def get(self, subset: str, key: str):
        return self.driver(subset).get(key)

    def keys(self, subset: str) -> list[str]:
        return self.driver(subset).keys()

    def get_store(self, subset: str) -> ShardStore:
        return self.driver(subset).store

    def get_stream(self, subset: str | None = None, **kw):
        """One subset as its driver orders it, or one row of each in turn, passing over those that have ended."""
        from ..stream import interleaved

        if subset is not None:
            return self._stream(subset, **kw)
        return interleaved({s: self._stream(s, **kw) for s in self.subsets})

    def get_sampled(self, probas: dict[str, float] | None = None, seed: object = 42, **kw):
        """Every row once, the subset of each position drawn by weight among those that have rows left."""
        from ..stream import sampled_once

        return sampled_once({s: self._stream(s, **kw) for s in self.subsets}, probas, seed)

    def get_iter(self, subset: str | None = None, **kw):
        return iter(self.get_stream(subset, **kw))

    def get_iter_sampler(self, probas: dict[str, float] | None = None, seed: object = 42, **kw):
        return iter(self.get_sampled(probas, seed, **kw))

    def _stream(self, subset: str, order: list[str] | None = None, **kw):
        """Stores have an order of their own; a table needs order, columns that are unique together."""
        from ..stream import Stream

        driver = self.driver(subset)
        if hasattr(driver, "get_stream"):
            return driver.get_stream(**kw)
        return Stream(driver.get_df(**kw), order or driver.get_df(**kw).columns)


def combined(subsets: dict[str, DataFrame]) -> DataFrame:
    """The union of DataFrames by column name, with the name of its part in subset."""
    out = None
    for name, df in subsets.items():
        part = df.withColumn("subset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
