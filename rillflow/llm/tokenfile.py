"""Token-id files: Simple-8b words with escapes, in blocks that decode independently.

A file set is a table of chunks. A chunk holds the ids of consecutive documents; its ids are cut into blocks of BLOCK
ids, and each block is a run of 64-bit words. The top four bits of a word select how many ids of how many bits the lower
60 bits hold; the last word of a block may be partly filled. Selector 0 is the escape: its payload is an index into the
chunk's list of ids that need more than 60 bits. offsets[b] is the first word of block b, so that any block, or all
blocks at once, can be decoded without touching the others.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, spread, texts_of

BLOCK = 1024
#: Fixed values of the format: selector -> (ids in a word, bits of an id); 0 is the escape and 1 is unused.
LAYOUT = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
#: Ids of one chunk, about; a longer document makes a longer chunk of its own.
CHUNK = 1 << 20
#: White space beyond ASCII, and control characters that some libraries take for white space.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]").search
ODD_CONTROL = re.compile("[\x00\x1c-\x1f]").search
#: Kinds of bytes.
SPACE, LETTER, HIGH, OTHER = 0, 1, 2, 3
KIND = np.array([SPACE if b in b" \t\n\r\x0b\x0c" else LETTER if bytes([b]).isalpha() else HIGH if b > 127 else OTHER for b in range(256)], np.uint8)
#: Parts whose first positions are broadcast; beyond, the join is left to the planner.
BROADCAST_PARTS = 100_000
#: Distinct parts, and bytes of them, that a worker remembers before it starts anew.
REMEMBER, REMEMBER_BYTES = 2_500_000, 1 << 26
#: Bytes of parts that are looked up at a time; a longer part than LONG_PART goes to the library without being remembered.
STRETCH, LONG_PART = 1 << 20, 1 << 16
SCHEMA = "part int, chunk int, before long, doc_ids array<bigint>, lens array<bigint>, n_ids long, offsets binary, words binary, wide binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets uint32, words uint64, wide uint64) of ids; wide has the ids of over 60 bits."""
    ids = np.asarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64 if ids.max() >> np.uint64(32) else np.uint32)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    at = np.arange(BLOCK + 60, dtype=np.int16)
    wide_bits = np.zeros(grid.shape, np.uint8)
    for _, bits in LAYOUT.values():  # the bits of the narrowest word that holds the id, or over 60
        wide_bits += grid >= 1 << bits if bits < 32 or grid.dtype == np.uint64 else False
    rank = {bits: i for i, (_, bits) in enumerate(sorted(LAYOUT.values(), key=lambda x: x[1]))}
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for sel in sorted(LAYOUT, reverse=True):  # from the widest to the fullest word; the last that fits holds most
        count, bits = LAYOUT[sel]
        fits = wide_bits <= rank[bits]
        width = 1  # fits[i]: the ids i..i+width-1 all fit
        while width < count:
            more = min(width, count - width)
            fits = fits[:, :-more] & fits[:, more:]
            width += more
        choice[fits[:, :BLOCK]] = sel
    step = np.ones(16, np.int64)
    for sel, (count, _) in LAYOUT.items():
        step[sel] = count
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    pos, live, seen = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        sel = choice[live, pos[live]]
        seen.append((live, pos[live], sel))
        pos[live] += step[sel]
        live = live[pos[live] < length[live]]
    b, p, s = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.lexsort((p, b))
    b, p, s = b[order], p[order], s[order]
    words = np.zeros(len(b), np.uint64)
    for sel, (count, bits) in LAYOUT.items():
        at_sel = np.nonzero(s == sel)[0]
        word = np.full(len(at_sel), sel << 60, np.uint64)
        for i in range(count):
            word |= grid[b[at_sel], p[at_sel] + i].astype(np.uint64) << np.uint64(i * bits)
        words[at_sel] = word
    escaped = np.nonzero(s == 0)[0]
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=blocks))])
    return offsets.astype(np.uint32), words, grid[b[escaped], p[escaped]].astype(np.uint64)


def unpack(offsets: np.ndarray, words: np.ndarray, wide: np.ndarray, n: int) -> np.ndarray:
    """The n ids of pack(), all blocks at once."""
    out = np.zeros(n + 60, np.uint64)
    if not n:
        return out[:0]
    sel = (words >> np.uint64(60)).astype(np.int64)
    held = np.ones(16, np.int64)
    for k, (count, _) in LAYOUT.items():
        held[k] = count
    count = held[sel]
    before = np.cumsum(count) - count
    first = offsets[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(offsets.astype(np.int64)))
    start = before - before[first][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for k, (num, bits) in LAYOUT.items():
        mine = np.nonzero(sel == k)[0]
        mask = np.uint64((1 << bits) - 1)
        for i in range(num):
            ok = mine[start[mine] + i < end[mine]]
            out[start[ok] + i] = (words[ok] >> np.uint64(i * bits)) & mask
    mine = np.nonzero(sel == 0)[0]
    out[start[mine]] = wide[words[mine].astype(np.int64)]
    return out[:n]


class Grown:
    """A numpy array that grows at its end, in amortised constant time."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            more = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : need] = values
        self.n = need


class Parts:
    """What is known of parts of texts: bytes -> a number, by an open hash table that doubles when it is half full.

    A part is found by a 64-bit hash and then compared byte by byte; parts whose hash another one has taken are kept by
    their bytes in a dictionary.
    """

    def __init__(self):
        self.bits = 12
        self.key, self.code = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.raw, self.at, self.len = Grown(np.uint8), Grown(np.int64), Grown(np.int64)
        self.odd: dict[bytes, int] = {}

    def __len__(self):
        return self.at.n

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number that is filed under each key, -1 for keys that are free. A key is never 0."""
        mask, pos = len(self.key) - 1, self.slot(keys)
        there = self.key[pos]
        more = np.nonzero((there != keys) & (there != 0))[0]
        while len(more):
            pos[more] = (pos[more] + 1) & mask
            there[more] = self.key[pos[more]]
            more = more[(there[more] != keys[more]) & (there[more] != 0)]
        return np.where(there == keys, self.code[pos], -1)

    def file(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """File numbers under keys that differ and are all free."""
        mask, pos = len(self.key) - 1, self.slot(keys)
        while len(keys):
            free = self.key[pos] == 0
            self.key[pos[free]] = keys[free]
            won = self.key[pos] == keys
            self.code[pos[won]] = codes[won]
            keys, codes, pos = keys[~won], codes[~won], (pos[~won] + 1) & mask

    def add(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers for new parts raw[start:start+len]."""
        first = len(self)
        self.at.add(self.raw.n + np.cumsum(lens) - lens)
        self.len.add(lens)
        self.raw.add(raw[spread(starts, lens)])
        return np.arange(first, len(self), dtype=np.int32)

    def learn(self, keys: np.ndarray, codes: np.ndarray) -> None:
        used = np.nonzero(self.key)[0]
        if 2 * (len(used) + len(keys)) > len(self.key):
            old, numbers = self.key[used], self.code[used]
            self.bits = max(self.bits + 1, int(2 * (len(used) + len(keys))).bit_length() + 1)
            self.key, self.code = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self.file(old, numbers)
        self.file(keys, codes)

    def same(self, codes: np.ndarray, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Whether the part of each number has the bytes raw[cuts[i]:cuts[i+1]]."""
        lens = np.diff(cuts)
        ok = self.len.data[codes] == lens
        if ok.all():
            differs = self.raw.data[spread(self.at.data[codes], lens)] != raw[cuts[0] : cuts[-1]]
            if differs.any():
                ok[np.searchsorted(cuts - cuts[0], np.nonzero(differs)[0], "right") - 1] = False
            return ok
        for i in np.nonzero(ok)[0].tolist():  # a clash of lengths: rare, so one by one
            a = self.at.data[codes[i]]
            ok[i] = (self.raw.data[a : a + lens[i]] == raw[cuts[i] : cuts[i + 1]]).all()
        return ok


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct part of the texts once.

    Texts fall apart where a piece of the library's own pre-split always begins: at a blank or line end between two
    characters that are not white space, after that line end, and where an ASCII letter is followed by another kind of
    ASCII character. Cutting and looking up works on all bytes of a stretch of parts at once; what is remembered is bounded
    in parts and bytes, whatever the length of a text. A text with white space outside ASCII goes to the library whole, and
    so does one that holds an added token's content where special is set: special strings are then the library's special
    ids, as by its defaults.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if special else []
        self.up = self.down = np.ones(1, np.uint64)
        self.forget()

    def forget(self):
        self.known, self.at, self.len, self.ids = Parts(), Grown(np.int64), Grown(np.int64), Grown(np.int64)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, new), np.int64, len(new))
        return np.fromiter(chain.from_iterable(new), np.int64, int(lens.sum())), lens

    def hashes(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A hash, not 0, of raw[cuts[i]:cuts[i+1]]: differences of running sums of byte times power, moved to the start."""
        if len(self.up) < len(raw) + 1:
            n, base = len(raw) + (1 << 20), 0x9E3779B97F4A7C15
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64)])
        h = (run[cuts[1:]] - run[cuts[:-1]]) * self.down[cuts[:-1]] + (cuts[1:] - cuts[:-1]).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h[h == 0] = 1
        return h

    def taught(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of new parts, whose ids come from the library."""
        blob = raw.tobytes()
        ids, many = self.library([blob[a : a + n].decode() for a, n in zip(starts.tolist(), lens.tolist(), strict=True)])
        self.at.add(self.ids.n + np.cumsum(many) - many)
        self.len.add(many)
        self.ids.add(ids)
        return self.known.add(raw, starts, lens)

    def stretch(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each part) of the parts raw[cuts[i]:cuts[i+1]]."""
        if len(cuts) == 2 and len(raw) > LONG_PART:
            return self.library([raw.tobytes().decode()])
        if len(self.known) > REMEMBER or self.known.raw.n > REMEMBER_BYTES:
            self.forget()
        with np.errstate(over="ignore"):
            key = self.hashes(raw, cuts)
        code = self.known.find(key)
        missing = np.nonzero(code < 0)[0]
        if len(missing):
            uniq, which, back = np.unique(key[missing], return_index=True, return_inverse=True)
            which = missing[which]
            new = self.taught(raw, cuts[which], cuts[which + 1] - cuts[which])
            self.known.learn(uniq, new)
            code[missing] = new[back]
        for i in np.nonzero(~self.known.same(code, raw, cuts))[0].tolist():  # another part has this hash
            part = raw[cuts[i] : cuts[i + 1]].tobytes()
            if part not in self.known.odd:
                self.known.odd[part] = int(self.taught(raw, cuts[i : i + 1], cuts[i + 1 : i + 2] - cuts[i : i + 1])[0])
            code[i] = self.known.odd[part]
        lens = self.len.data[code]
        return self.ids.data[spread(self.at.data[code], lens)], lens

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        kind = KIND[raw]
        a, b = np.concatenate([[SPACE], kind[:-1]]), np.concatenate([kind[1:], [SPACE]])
        lone = ((kind == SPACE) & (a != SPACE) & (b != SPACE)) & ((raw == 32) | (raw == 10))
        new = lone | ((a == LETTER) & (kind != LETTER) & (kind != HIGH) & (kind != SPACE))
        new[1:] |= lone[:-1] & (raw[:-1] == 10)
        many = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
        ends = np.cumsum(many)
        new[0] = True
        new[ends[:-1][ends[:-1] < len(raw)]] = True
        cuts = np.append(np.nonzero(new)[0], len(raw))
        # stretches of about STRETCH bytes, and every part of over LONG_PART bytes on its own
        step = (cuts[:-1] // STRETCH)[1:] != (cuts[:-1] // STRETCH)[:-1]
        long = np.diff(cuts) > LONG_PART
        edges = np.concatenate([[0], np.nonzero(step | long[1:] | long[:-1])[0] + 1, [len(cuts) - 1]])
        got = [self.stretch(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        total = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in got]))])
        upto = total[np.searchsorted(cuts, ends)]
        return np.concatenate([x for x, _ in got]), np.diff(upto, prepend=0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)"""
        whole = lambda t: WIDE_SPACE(t) or ODD_CONTROL(t) or any(x in t for x in self.added)
        none = np.zeros(0, np.int64)
        if any(not t or not t.isascii() and WIDE_SPACE(t) or ODD_CONTROL(t) or any(x in t for x in self.added) for t in texts):
            own = [(none, np.zeros(1, np.int64)) if not t else self.library([t]) if whole(t) else self.parts([t]) for t in texts]
            return np.concatenate([x for x, _ in own]), np.concatenate([n for _, n in own])
        return self.parts(texts) if texts else (none, none)


@lru_cache(maxsize=1)
def encoder(path: str, special: bool) -> Encoder:
    return Encoder(path, special)


def write(docs: DataFrame, tokenizer: str, end_id: int, tag: str = "tokens", special: bool = False) -> DataFrame:
    """The file set of docs (doc_id, text), in ascending doc_id order: part by part, chunk by chunk.

    Special strings in a text are ordinary text, or with special the library's special ids. Null and empty texts have the
    end id alone; a null doc_id comes first; rows of one doc_id are ordered by text. Only the two named columns are read.
    One range shuffle of the texts; each task holds one chunk. An empty table gives none.
    """
    n = partitions(docs.sparkSession)
    first = F.col("doc_id").asc_nulls_first()
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, first).sortWithinPartitions(first, "text")
    longs = pa.list_(pa.int64())
    kinds = {"part": pa.int32(), "chunk": pa.int32(), "before": pa.int64(), "doc_ids": longs, "lens": longs, "n_ids": pa.int64()}
    out_schema = pa.schema([*kinds.items(), *[(c, pa.binary()) for c in ("offsets", "words", "wide")]])

    def encode(batches):
        enc, part = encoder(tokenizer, special), TaskContext.get().partitionId()
        chunk = before = 0
        held, held_ids, held_lens, total = [], [], [], 0

        def out():
            nonlocal chunk, before, held, held_ids, held_lens, total
            ids = np.concatenate(held_ids)
            offsets, words, wide = pack(ids)
            blobs = {"offsets": offsets.astype("<u4").tobytes(), "words": words.astype("<u8").tobytes(), "wide": wide.astype("<u8").tobytes()}
            row = {"part": part, "chunk": chunk, "before": before, "doc_ids": held, "lens": held_lens, "n_ids": len(ids), **blobs}
            chunk, before, held, held_ids, held_lens, total = chunk + 1, before + len(ids), [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=out_schema)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in texts_of(batch, "text"):
                ids, lens = enc(texts)
                held_ids.append(np.insert(ids, np.cumsum(lens), end_id))
                held += keys[at : at + len(texts)]
                held_lens += (lens + 1).tolist()
                total += len(ids) + len(lens)
                if total >= CHUNK:
                    yield out()
        if held:
            yield out()

    return materialise(dealt.mapInArrow(encode, SCHEMA), tag)


def read(files: DataFrame) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32, decoded from the words.

    start needs the ids of all earlier parts: a running sum over one row a part.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["offsets"], "<u4"), np.frombuffer(row["words"], "<u8"), np.frombuffer(row["wide"], "<u8"), row["n_ids"]).astype("<u4")
                lens = np.array(row["lens"], np.int64)
                ends = np.cumsum(lens)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                starts = row["first"] + row["before"] + ends - lens
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row["doc_ids"], starts, lens, crc)], schema=schema)

    if partitions(files.sparkSession) <= BROADCAST_PARTS:  # a row of two numbers for each part, and as many parts
        whole = F.broadcast(whole)
    return files.join(whole, "part").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
