"""A versioned catalogue of sources: set algebra over (identifier, version), YAML, and drivers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATEST = -1
FORMAT = "0.4.0"
SCHEMA = "identifier string, version int, driver_name string, driver_kwargs string, metadata string"
PLUGINS: list[Callable[[], list[tuple[str, Source]]]] = []


@dataclass(frozen=True, repr=False)
class Source:
    """What a driver needs; equality leaves the driver's name out."""

    driver_name: str = field(compare=False)
    driver_kwargs: dict = field(default_factory=dict, hash=False)
    metadata: dict = field(default_factory=dict, hash=False)

    def __repr__(self) -> str:
        """Its fields as JSON."""
        return json.dumps({"driver_name": self.driver_name, "driver_kwargs": self.driver_kwargs, "metadata": self.metadata}, default=str)

    def get_driver(self, spark: SparkSession, catalog=None, **kwargs):
        """The driver of this source; storage_options are merged key by key (the call wins), the rest as a whole."""
        from ..sources.drivers import DRIVERS

        if self.driver_name not in DRIVERS:
            raise ValueError(f"no driver is registered as {self.driver_name}")
        own = self.driver_kwargs
        storage = _deep(own.get("storage_options", {}), kwargs.get("storage_options", {}))
        return DRIVERS[self.driver_name](spark, **(own | kwargs | {"storage_options": storage, "catalog": catalog}))


def _deep(low: dict, high: dict) -> dict:
    return low | {k: _deep(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}


class Versions:
    """The versions of one identifier; setting on an unknown one makes it."""

    def __init__(self, catalog: Catalog, identifier: str):
        self.catalog, self.identifier = catalog, identifier

    @property
    def versions(self) -> dict[int, Source]:
        return self.catalog.entries.get(self.identifier, {})

    def __getitem__(self, version: int) -> Source:
        return self.catalog[self.identifier, version]

    def __setitem__(self, version: int, source: Source) -> None:
        self.catalog[self.identifier, version] = source

    def __delitem__(self, version: int) -> None:
        del self.catalog[self.identifier, version]

    def __contains__(self, version: int) -> bool:
        return bool(self.versions) if version == LATEST else version in self.versions

    def __len__(self) -> int:
        return len(self.versions)


class Catalog:
    def __init__(self, entries: dict[str, dict[int, Source]] | None = None):
        self.entries = {k: dict(v) for k, v in (entries or {}).items() if v}

    def __setitem__(self, key, source: Source) -> None:
        if isinstance(key, str):
            key = key, max(self.entries.get(key, ()), default=0) + 1
        identifier, version = key
        if version < 1:
            raise ValueError("versions begin at 1")
        self.entries.setdefault(identifier, {})[version] = source

    def __getitem__(self, key):
        if isinstance(key, str):
            return Versions(self, key)
        if not isinstance(key, tuple):
            raise TypeError("an identifier, or an identifier and a version")
        own = self.entries[key[0]]
        return own[max(own) if key[1] == LATEST else key[1]]

    def __delitem__(self, key) -> None:
        if isinstance(key, str):
            del self.entries[key]
            return
        own = self.entries[key[0]]
        del own[max(own) if key[1] == LATEST else key[1]]
        if not own:
            del self.entries[key[0]]

    def __contains__(self, key) -> bool:
        return key in self.entries if isinstance(key, str) else key[0] in self.entries and key[1] in Versions(self, key[0])

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self) -> Iterator[tuple[str, Source]]:
        return ((k, self[k, LATEST]) for k in self.entries)

    items = __iter__

    def keys(self) -> list[str]:
        return list(self.entries)

    def all(self) -> dict[tuple[str, int], Source]:
        return {(k, v): s for k, own in self.entries.items() for v, s in own.items()}

    @classmethod
    def of(cls, flat: dict[tuple[str, int], Source]) -> Catalog:
        out = cls()
        for key, source in flat.items():
            out[key] = source
        return out

    def union(self, other: Catalog) -> Catalog:
        """Entries of both; other's where both have one."""
        return Catalog.of(self.all() | other.all())

    def intersection(self, other: Catalog) -> Catalog:
        mine, theirs = self.all(), other.all()
        both = {k: s for k, s in mine.items() if k in theirs}
        if any(s != theirs[k] for k, s in both.items()):
            raise ValueError("an entry differs between the catalogues")
        return Catalog.of(both)

    def difference(self, other: Catalog) -> Catalog:
        """Entries of one of the two alone."""
        mine, theirs = self.all(), other.all()
        return Catalog.of({k: s for k, s in (mine | theirs).items() if (k in mine) != (k in theirs)})

    def join(self, other: Catalog) -> Catalog:
        if set(self.all()) & set(other.all()):
            raise ValueError("the catalogues share entries")
        return self.union(other)

    def filter(self, predicate: Callable[[Source], bool]) -> Catalog:
        return Catalog.of({k: s for k, s in self.all().items() if predicate(s)})

    def slice(self, identifiers: list[str]) -> Catalog:
        return Catalog({k: self.entries[k] for k in identifiers})

    def copy(self) -> Catalog:
        return Catalog.from_str(self.to_str())

    def __eq__(self, other) -> bool:
        return isinstance(other, Catalog) and self.all() == other.all()

    def __repr__(self) -> str:
        return str(sorted(self.entries, key=str.lower))

    def to_str(self) -> str:
        rows = [{"identifier": k, "version": v, "driver_name": s.driver_name, "driver_kwargs": s.driver_kwargs, "metadata": s.metadata} for (k, v), s in self.all().items()]
        return yaml.safe_dump({"version": FORMAT, "sources": rows}, sort_keys=False)

    @classmethod
    def from_str(cls, text: str) -> Catalog:
        """A catalogue from YAML; tags of mappings are read as the mappings they mark."""
        loaded = yaml.load(text, _Loader)
        if tuple(map(int, str(loaded["version"]).split(".")[:2])) < (0, 4):
            raise ValueError("the catalogue's format is too old")
        return cls.of({(r["identifier"], r.get("version", 1)): Source(r["driver_name"], r.get("driver_kwargs") or {}, r.get("metadata") or {}) for r in loaded["sources"]})

    def to_file(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_str())

    @classmethod
    def from_files(cls, paths: list[str]) -> Catalog:
        out = cls()
        for p in paths:
            with open(p) as f:
                out = out.join(cls.from_str(f.read()))
        return out

    @classmethod
    def from_dirs(cls, paths: list[str]) -> Catalog:
        from pathlib import Path

        return cls.from_files([str(p) for d in paths for p in sorted(Path(d).glob("*.yaml"))])

    @classmethod
    def from_plugins(cls) -> Catalog:
        out = cls()
        for plugin in PLUGINS:
            for identifier, source in plugin():
                out[identifier] = source
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, v, s.driver_name, json.dumps(s.driver_kwargs, sort_keys=True), json.dumps(s.metadata, sort_keys=True)) for (k, v), s in self.all().items()]
        return spark.createDataFrame(rows, SCHEMA)


class _Loader(yaml.SafeLoader):
    pass


_Loader.add_multi_constructor("!", lambda loader, tag, node: loader.construct_mapping(node, deep=True))
KEYS = ["identifier", "version"]


def union_df(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same algebra over catalogue tables; right wins."""
    return right.unionByName(left.join(right, KEYS, "left_anti"))


def intersection_df(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries of both. Entries that differ in more than the driver's name fail the query when it runs."""
    rest = [c for c in left.columns if c not in (*KEYS, "driver_name")]
    both = left.join(right.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in rest]), KEYS)
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    differs = F.raise_error(F.lit("an entry differs between the catalogues")).cast("int")
    checked = both.withColumn("version", F.when(same, F.col("version")).otherwise(differs))
    return checked.select(*left.columns)


def difference_df(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, KEYS, "left_anti").unionByName(right.join(left, KEYS, "left_anti"))


def latest_df(catalog: DataFrame) -> DataFrame:
    w = Window.partitionBy("identifier").orderBy(F.desc("version"))
    return catalog.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_new_versions(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """new (a row an identifier) appended, each one version past the latest."""
    last = catalog.groupBy("identifier").agg(F.max("version").alias("_v"))
    rows = new.join(last, "identifier", "left").withColumn("version", F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_v")
    return catalog.unionByName(rows.select(*catalog.columns))


