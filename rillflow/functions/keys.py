"""Keys of hierarchical stores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of metadata files (fixed values of the array-store format).
METADATA = (".zarray", ".zgroup", ".zattrs")
CHUNK = r"^(\d+\.)+\d+"


def key_end(key: Column, separator: str = "/") -> Column:
    """What follows the last separator."""
    return F.substring_index(key, separator, -1)


def is_metadata(key: Column) -> Column:
    return F.coalesce(F.greatest(*[key.endswith(x) for x in METADATA]), F.lit(False))


def is_chunk(key: Column) -> Column:
    """Whether the last part begins with numbers joined by dots."""
    return key_end(key).rlike(CHUNK)


def is_reserved(key: Column, prefix: str = ".rill") -> Column:
    """Keys that a store keeps for itself."""
    return key_end(key).startswith(prefix) | key.contains(f"/{prefix}/")


def is_dir(key: Column, prefix: str = ".rill") -> Column:
    return ~(is_metadata(key) | is_chunk(key) | key.endswith(".zip") | is_reserved(key, prefix))


def normalize_key(key: Column) -> Column:
    """Outer white space and slashes off, a slash after a folder; empty stays empty."""
    bare = F.regexp_replace(F.regexp_replace(key, r"^\s+|\s+$", ""), "^/+|/+$", "")
    return F.when(F.length(key) == 0, key).otherwise(F.concat(bare, F.when(is_dir(key_end(bare)), F.lit("/")).otherwise(F.lit(""))))


def zero_padded(n: Column, width: int) -> Column:
    return F.format_string(f"%0{width}d", n)


def without_gz(key: Column) -> Column:
    return F.regexp_replace(key, r"\.gz$", "")


def relative(path: Column, root: str) -> Column:
    return F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)


def protocol(url: Column) -> Column:
    """The protocol of a URL, empty for local paths."""
    return F.regexp_extract(url, "^([^:/]+)://", 1)


def protocol_of(url: str, storage_options: dict | None = None) -> str:
    """The protocol of one URL; a protocol in storage_options wins."""
    given = (storage_options or {}).get("protocol")
    return given if given is not None else url.split("://", 1)[0] if "://" in url else ""


def key_of(batch_id: Column) -> Column:
    """Sixteen upper-case characters that depend on the batch alone."""
    return F.upper(F.substring(F.md5(batch_id.cast("string")), 1, 16))


def merged(low: Column, high: Column) -> Column:
    """Two maps as one; high wins."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(low), lambda e: ~F.map_contains_key(high, e["key"])), F.map_entries(high)))
