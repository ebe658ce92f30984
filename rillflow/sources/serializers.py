"""Serializers of samples: JSON lines and MessagePack, always gzip in shards."""

from __future__ import annotations

import base64
import gzip
import json
import struct
from collections.abc import Iterable, Iterator


class Serializer:
    """What a store needs: one object to bytes and back, and a shard of samples to bytes and back."""

    def dumps(self, value) -> bytes:
        raise NotImplementedError

    def loads(self, data: bytes):
        raise NotImplementedError

    def dump_shard(self, samples: Iterable) -> bytes:
        raise NotImplementedError

    def load_shard(self, data: bytes) -> Iterator:
        raise NotImplementedError


def _plain(value):
    """numpy values as JSON has them: scalars as numbers, arrays as data, type and shape."""
    if hasattr(value, "tolist") and hasattr(value, "shape") and value.shape:
        return {"data": value.tolist(), "type": str(value.dtype), "shape": list(value.shape)}
    if hasattr(value, "item"):
        return value.item()
    if isinstance(value, (bytes, bytearray)):
        return {"base64": base64.b64encode(bytes(value)).decode()}
    if hasattr(value, "isoformat"):
        return value.isoformat()
    raise TypeError(f"cannot serialise {type(value).__name__}")


class JsonSerializer(Serializer):
    """One JSON document a line. hook(dict) -> object is applied to every decoded document, shards included."""

    def __init__(self, hook=None):
        self.hook = hook

    def dumps(self, value) -> bytes:
        return json.dumps(value, default=_plain, ensure_ascii=False).encode()

    def loads(self, data: bytes):
        return json.loads(data, object_hook=self.hook)

    def dump_shard(self, samples: Iterable) -> bytes:
        return gzip.compress(b"".join(self.dumps(s) + b"\n" for s in samples), mtime=0)

    def load_shard(self, data: bytes) -> Iterator:
        return (self.loads(line) for line in gzip.decompress(data).splitlines() if line.strip())


class MessagepackSerializer(Serializer):
    """Concatenated MessagePack objects, coded here from the public format; arrays read as tuples."""

    def dumps(self, value) -> bytes:
        out = bytearray()
        _pack(value, out)
        return bytes(out)

    def loads(self, data: bytes):
        return _unpack(data, 0)[0]

    def dump_shard(self, samples: Iterable) -> bytes:
        return gzip.compress(b"".join(map(self.dumps, samples)), mtime=0)

    def load_shard(self, data: bytes) -> Iterator:
        raw, at = gzip.decompress(data), 0
        while at < len(raw):
            value, at = _unpack(raw, at)
            yield value


def _sized(n: int, out: bytearray, small: tuple[int, int] | None, codes: tuple[int | None, int, int]) -> None:
    if small and n < small[1]:
        out.append(small[0] | n)
        return
    for code, form, most in zip(codes, (">B", ">H", ">I"), (1 << 8, 1 << 16, 1 << 32), strict=True):
        if code is not None and n < most:
            out.append(code)
            out += struct.pack(form, n)
            return
    raise ValueError("too long for MessagePack")


def _pack(value, out: bytearray) -> None:
    if value is None:
        out.append(0xC0)
    elif isinstance(value, bool):
        out.append(0xC3 if value else 0xC2)
    elif isinstance(value, int):
        if -32 <= value < 128:
            out += struct.pack(">b", value)
        else:
            out += struct.pack(">Bq", 0xD3, value) if value < 1 << 63 else struct.pack(">BQ", 0xCF, value)
    elif isinstance(value, float):
        out += struct.pack(">Bd", 0xCB, value)
    elif isinstance(value, str):
        raw = value.encode()
        _sized(len(raw), out, (0xA0, 32), (0xD9, 0xDA, 0xDB))
        out += raw
    elif isinstance(value, (bytes, bytearray)):
        _sized(len(value), out, None, (0xC4, 0xC5, 0xC6))
        out += value
    elif isinstance(value, dict):
        _sized(len(value), out, (0x80, 16), (None, 0xDE, 0xDF))
        for k, v in value.items():
            _pack(k, out)
            _pack(v, out)
    elif isinstance(value, (list, tuple)):
        _sized(len(value), out, (0x90, 16), (None, 0xDC, 0xDD))
        for v in value:
            _pack(v, out)
    else:
        _pack(_plain(value), out)


_FORMS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("array", ">H"), 0xDD: ("array", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def _unpack(raw: bytes, at: int):
    code, at = raw[at], at + 1
    if code < 0x80 or code >= 0xE0:
        return (code if code < 0x80 else code - 256), at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in _FORMS:
        form = _FORMS[code]
        return struct.unpack_from(form, raw, at)[0], at + struct.calcsize(form)
    if code in _LENGTHS:
        kind, form = _LENGTHS[code]
        n = struct.unpack_from(form, raw, at)[0]
        at += struct.calcsize(form)
    elif code < 0x90:
        kind, n = "map", code & 15
    elif code < 0xA0:
        kind, n = "array", code & 15
    elif code < 0xC0:
        kind, n = "str", code & 31
    else:
        raise ValueError(f"MessagePack type {code:#x} is not supported")
    if kind in ("bin", "str"):
        part = raw[at : at + n]
        return (part if kind == "bin" else part.decode()), at + n
    if kind == "array":
        items = []
        for _ in range(n):
            v, at = _unpack(raw, at)
            items.append(v)
        return tuple(items), at
    out = {}
    for _ in range(n):
        k, at = _unpack(raw, at)
        out[k], at = _unpack(raw, at)
    return out, at


SERIALIZERS: dict[str, type[Serializer]] = {"jsonl": JsonSerializer, "messagepack": MessagepackSerializer}
