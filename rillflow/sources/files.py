"""Whole objects in a folder, file listings, and single files."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from .serializers import Serializer
from .shards import get_bytes, hadoop, listing, put_bytes, random_key


class Store(Protocol):
    """What a store offers; a class with these three methods is one, whatever it keeps its values in."""

    def set(self, value: Any, key: str | None = None) -> str | None: ...

    def get(self, key: str) -> Any: ...

    def keys(self) -> list[str]: ...


def write_to_file(spark: SparkSession, url: str, value: Any, serialize: Callable[[Any], bytes] | None = None) -> None:
    """One file with a value's bytes: those of serialize, or the value itself, bytes or text."""
    data = serialize(value) if serialize else value
    put_bytes(spark, url, data.encode() if isinstance(data, str) else bytes(data))


def read_from_file(spark: SparkSession, url: str, deserialize: Callable[[bytes], Any] | None = None) -> Any:
    data = get_bytes(spark, url)
    return deserialize(data) if deserialize else data


class FilesystemStore:
    """A folder of whole objects, a file a key; keys are paths relative to it.

    clean deletes the folder at once; it is made again by the first write, not before. Without a serializer values are
    bytes or text, and are read as bytes.
    """

    def __init__(self, spark: SparkSession, url: str, serializer: Serializer | None = None, clean: bool = False):
        self.spark, self.url, self.serializer = spark, url.rstrip("/"), serializer
        if clean:
            fs, path = hadoop(spark, self.url)
            fs.delete(path, True)

    def path(self, key: str) -> str:
        key = posixpath.normpath(key)
        if key.startswith(("/", "..")):
            raise ValueError("a key lies inside its store")
        return f"{self.url}/{key}"

    def set(self, value: Any, key: str | None = None) -> str:
        key = key or random_key()
        write_to_file(self.spark, self.path(key), value, self.serializer and self.serializer.dumps)
        return key

    def get(self, key: str) -> Any:
        return read_from_file(self.spark, self.path(key), self.serializer and self.serializer.loads)

    def keys(self, nested: bool = True) -> list[str]:
        """All keys, or without nested those of files that lie in the folder itself."""
        root = hadoop(self.spark, self.url)[1]
        fs = hadoop(self.spark, self.url)[0]
        base = fs.makeQualified(root).toString().rstrip("/") + "/"
        return [p.removeprefix(base) for p, is_dir in listing(self.spark, self.url, nested) if not is_dir]


def file_paths(spark: SparkSession, url: str, nested: bool = False, max_keys: int = 1_000_000, max_dirs: int = 10) -> DataFrame:
    """(path) of what lies in url: files and folders, or with nested the files at any depth; nothing if url is missing.

    Names are listed by the driver, max_dirs folders at a time in threads, and go to the DataFrame max_keys at a time, so
    that a listing of any length takes bounded memory. Collected in order of path.
    """
    from concurrent.futures import ThreadPoolExecutor

    fs, path = hadoop(spark, url)
    parts, held, todo = [], [], [path] if fs.exists(path) else []

    def flush():
        nonlocal held
        parts.append(spark.createDataFrame([(p,) for p in held], "path string"))
        held = []

    with ThreadPoolExecutor(max(1, max_dirs)) as pool:
        while todo:
            now, todo = todo[:max_dirs], todo[max_dirs:]
            for found in pool.map(lambda d: [(s.getPath(), bool(s.isDirectory())) for s in fs.listStatus(d)], now):
                for p, is_dir in found:
                    if nested and is_dir:
                        todo.append(p)
                        continue
                    held.append(p.toString())
                    if len(held) >= max_keys:
                        flush()
    flush()
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
