"""A store of versioned artifacts: url/collection/artifact/vN/files/..."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import FilesystemStore
from ..sources.serializers import Serializer
from ..sources.shards import get_bytes, hadoop, listing, put_bytes
from .catalog import Catalog, Source

NAME = re.compile(r"[a-zA-Z0-9\-_:]+")


class ArtifactManager:
    def __init__(self, spark: SparkSession, url: str, collection: str = "default"):
        self.spark, self.url, self._collection = spark, url.rstrip("/"), collection

    @property
    def active_collection(self) -> str:
        return self._collection

    @active_collection.setter
    def active_collection(self, name: str) -> None:
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} cannot name a collection")
        self._collection = name

    def _names(self, *parts: str) -> list[str]:
        return [p.rsplit("/", 1)[-1] for p, is_dir in listing(self.spark, "/".join([self.url, *parts])) if is_dir]

    def collections(self) -> list[str]:
        return self._names()

    def artifacts(self, collection: str | None = None) -> list[str]:
        return self._names(collection or self._collection)

    def versions(self, artifact: str, collection: str | None = None) -> list[int]:
        return sorted(int(v[1:]) for v in self._names(collection or self._collection, artifact) if re.fullmatch(r"v\d+", v))

    def exists(self, artifact: str, collection: str | None = None) -> bool:
        return bool(self.versions(artifact, collection))

    def path(self, artifact: str, version: int | None = None, collection: str | None = None) -> str:
        """The folder of a version, the latest by default."""
        known = self.versions(artifact, collection)
        if not known or version is not None and version not in known:
            raise KeyError(artifact)
        return f"{self.url}/{collection or self._collection}/{artifact}/v{max(known) if version is None else version}/files"

    def log_files(self, artifact: str, local: str, collection: str | None = None) -> Source:
        """Copy a file or a folder as the next version (one past the highest)."""
        known = self.versions(artifact, collection)
        version = max(known, default=-1) + 1
        target = f"{self.url}/{collection or self._collection}/{artifact}/v{version}/files"
        source = Path(local)
        for p in sorted(source.rglob("*")) if source.is_dir() else [source]:
            if p.is_file():
                rel = p.relative_to(source if source.is_dir() else source.parent)
                fs, path = hadoop(self.spark, f"{target}/{rel}")
                fs.copyFromLocalFile(False, True, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{p.resolve()}"), path)
        return self.source(artifact, version, collection)

    @contextmanager
    def log_folder(self, artifact: str, collection: str | None = None):
        """A folder to fill; it is logged at the end unless it is empty."""
        with tempfile.TemporaryDirectory() as d:
            yield Path(d)
            if any(Path(d).iterdir()):
                self.log_files(artifact, d, collection)

    def source(self, artifact: str, version: int | None = None, collection: str | None = None) -> Source:
        path = self.path(artifact, version, collection)
        return Source("directory", {"url": path}, {"collection": collection or self._collection, "artifact": artifact, "version": int(path.split("/")[-2][1:])})

    def download(self, artifact: str, to: str, version: int | None = None, collection: str | None = None) -> Path:
        fs, path = hadoop(self.spark, self.path(artifact, version, collection))
        target = Path(to) / artifact
        fs.copyToLocalFile(False, path, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{target.resolve()}"), True)
        return target

    @contextmanager
    def downloaded(self, artifact: str, version: int | None = None, collection: str | None = None):
        """A version in a temporary folder of the driver, which goes at the end."""
        with tempfile.TemporaryDirectory() as d:
            yield self.download(artifact, d, version, collection)

    def download_collection(self, to: str, collection: str | None = None) -> Path:
        """The latest version of every artifact of a collection, each in a folder of its name."""
        for a in self.artifacts(collection):
            self.download(a, to, None, collection)
        return Path(to)

    def to_catalog(self, collection: str | None = None) -> Catalog:
        """Every version as an entry collection/artifact; version N of the store is N+1 of the catalogue."""
        out = Catalog()
        for c in [collection] if collection else self.collections():
            for a in self.artifacts(c):
                for v in self.versions(a, c):
                    out[f"{c}/{a}", v + 1] = self.source(a, v, c)
        return out


class ArtifactFileStore:
    """Single objects as versions of artifacts: a key is artifact or collection/artifact, with /vN for a version other than
    the latest. With a serializer a version is one object; without one it is a folder of files."""

    OBJECT = "value"

    def __init__(self, manager: ArtifactManager, serializer: Serializer | None = None):
        self.manager, self.serializer = manager, serializer

    def complete_key(self, key: str) -> tuple[str, str, int]:
        """(collection, artifact, version) of a key; the version of one that does not exist is where the next goes."""
        parts = key.strip("/").split("/")
        version = int(parts.pop()[1:]) if len(parts) > 1 and re.fullmatch(r"v\d+", parts[-1]) else None
        if not 1 <= len(parts) <= 2:
            raise ValueError(f"{key!r} is no artifact's key")
        artifact, collection = parts[-1], parts[0] if len(parts) == 2 else self.manager.active_collection
        known = self.manager.versions(artifact, collection)
        return collection, artifact, version if version is not None else max(known, default=0)

    def key_exists(self, key: str) -> bool:
        collection, artifact, version = self.complete_key(key)
        return version in self.manager.versions(artifact, collection)

    def keys(self) -> list[str]:
        m = self.manager
        return [f"{c}/{a}/v{v}" for c in m.collections() for a in m.artifacts(c) for v in m.versions(a, c)]

    def set(self, value, key: str) -> str:
        """Write a value as the next version: an object, or without a serializer the path of a local file or folder."""
        collection, artifact, version = self.complete_key(key)
        known = self.manager.versions(artifact, collection)
        version = max(known) + 1 if known else version
        if self.serializer is None:
            source = self.manager.log_files(artifact, value, collection)
            return f"{collection}/{artifact}/v{source.metadata['version']}"
        path = f"{self.manager.url}/{collection}/{artifact}/v{version}/files/{self.OBJECT}"
        put_bytes(self.manager.spark, path, self.serializer.dumps(value))
        return f"{collection}/{artifact}/v{version}"

    def get(self, key: str):
        """The object, or without a serializer the files of the version as a dictionary of bytes."""
        collection, artifact, version = self.complete_key(key)
        root = self.manager.path(artifact, version, collection)
        if self.serializer is not None:
            return self.serializer.loads(get_bytes(self.manager.spark, f"{root}/{self.OBJECT}"))
        files = FilesystemStore(self.manager.spark, root)
        return {k: files.get(k) for k in files.keys()}


def versions_of(paths: DataFrame, path: str = "path") -> DataFrame:
    """(collection, artifact, version, latest) of a listing of artifact paths."""
    form = r"([^/]+)/([^/]+)/v(\d+)/"
    part = lambda i: F.regexp_extract(path, form, i)
    rows = paths.where(F.col(path).rlike(form)).select(part(1).alias("collection"), part(2).alias("artifact"), part(3).cast("int").alias("version")).distinct()
    latest = rows.groupBy("collection", "artifact").agg(F.max("version").alias("latest"))
    return rows.join(latest, ["collection", "artifact"])
