"""Exact removal of repeated byte strings, with a logarithmic family of sparse suffix arrays.

Which 50-byte strings start in an earlier document? Every 50-byte window has an anchor: the 20-byte string in it of the
least hash, the leftmost of equals. Equal windows have equal anchors, so windows need to be compared only under anchors
that occur in more than one place, and the windows of one anchor are a run of neighbouring starts, its context.

1. Texts are dealt into groups by a hash of the row. Each group tells, by hash range of the anchors, which anchors it has
   (each once, so that a line that a third of all documents share costs one entry a group, not one a document).
2. Each range answers with the anchors that several groups have, or one group several times.
3. Each group sends the contexts of those anchors, equal contexts once, with the least doc_id that has them. An anchor
   that very many groups have is hot: the windows of its contexts are sent one by one, dealt by their own bytes.
4. In each range, the contexts of one group after the other get a suffix array, lexicographic, and are merge-scanned
   against the levels before it; equal ones become one with the least doc_id, what no level has becomes a level of its
   own, and levels of about equal size merge, so that n suffixes lie in at most log2(n) levels. A context that is alone
   under its anchor meets no other string. The starts of the rest go through a second such family, of suffixes of 50
   bytes: neighbours in a merge that share all 50 are one string. The answer to a group is a bit for each start: does a
   smaller doc_id have this string?
5. Each group marks the bytes that matched strings cover.

The texts' shuffle (by group) is one exchange that steps 1, 3 and 5 share. Groups and ranges are sized by bytes; nothing
but the byte count goes to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, spread

LENGTH = 50
ANCHOR = 20
SPAN = LENGTH - ANCHOR + 1
#: Bytes of text in a group, and so in one task at a time.
GROUP = 8 << 20
#: Starts that are hashed at a time.
STRETCH = 1 << 19
#: Suffixes of one batch, about.
BATCH = 1 << 18
#: An anchor of more groups than this is hot: its windows are dealt by their own bytes, so that they spread over all ranges.
HOT = 256
#: In a length, the sign of a window of a hot anchor.
LONE = 128
NO_ID = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of every size-byte string of raw, built by doubling."""
    power, part, done = _M, raw.astype(np.uint64) + np.uint64(1), 0
    out, width = None, 1
    while True:
        if size & width:
            if out is None:
                out, done, out_power = part, width, power
            else:
                n = len(raw) - done - width + 1
                out = part[:n] * out_power + out[width : width + n]
                done, out_power = done + width, out_power * power
        if width * 2 > size:
            return _mix(out[: len(raw) - size + 1])
        part = part[:-width] * power + part[width:]
        power, width = power * power, width * 2


def anchors(raw: np.ndarray, ends: np.ndarray):
    """(first start, last start, anchor's hash) of every context of the texts that lie end to end in raw."""
    starts = np.concatenate([[0], ends[:-1]])
    firsts, lasts, keys = [], [], []
    at, total = 0, len(raw)
    with np.errstate(over="ignore"):
        while at + LENGTH <= total:
            upto = min(at + STRETCH, total - LENGTH + 1)  # starts at..upto-1
            h = rolling(raw[at : upto + LENGTH - 1], ANCHOR)
            x = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while width * 2 <= SPAN:
                x = np.minimum(x[:-width], x[width:])
                width *= 2
            if width < SPAN:
                x = np.minimum(x[: len(x) - (SPAN - width)], x[SPAN - width :])
            where = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)[: upto - at]
            ok = np.zeros(upto - at + 1, np.int8)  # starts whose string lies inside a text
            lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(starts, upto, "left")
            a = np.clip(starts[lo:hi] - at, 0, upto - at)
            b = np.clip(ends[lo:hi] - LENGTH + 1 - at, 0, upto - at)
            keep = b > a
            np.add.at(ok, a[keep], 1)
            np.add.at(ok, b[keep], -1)
            good = np.nonzero(np.cumsum(ok[:-1]))[0]
            if len(good):
                w = where[good]
                new = np.nonzero((np.diff(w) != 0) | (np.diff(good) != 1))[0] + 1
                i = np.concatenate([[0], new])
                j = np.concatenate([new - 1, [len(good) - 1]])
                firsts.append(good[i] + at)
                lasts.append(good[j] + at)
                keys.append(_mix(h[w[i]] * _M))
            at = upto
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(keys)


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def cut_strings(raw: np.ndarray, at: np.ndarray, lens: np.ndarray, width: int, sign: np.ndarray | int = 0) -> np.ndarray:
    """raw[at:at+len] as strings of width+1 bytes, padded with zeros, the length (and a sign) in the last byte, so that
    padding counts."""
    out = np.zeros((len(at), width + 1), np.uint8)
    if len(at) and (lens == width).all():
        out[:, :width] = np.lib.stride_tricks.sliding_window_view(raw, width)[at]
    elif len(at):
        out.reshape(-1)[spread(np.arange(len(at)) * (width + 1), lens)] = raw[spread(at, lens)]
    out[:, width] = lens + sign
    return out.reshape(-1).view(f"S{width + 1}")


class Level:
    """A suffix array: strings in lexicographic order, each once, the least document of each, and a tag that they carry."""

    def __init__(self, strings: np.ndarray, docs: np.ndarray, tags: np.ndarray):
        self.strings, self.docs, self.tags = strings, docs, tags

    def __len__(self):
        return len(self.strings)

    @classmethod
    def of(cls, strings: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> Level:
        """The suffix array of a batch: sorted, and neighbours that share all their bytes made one with the least document."""
        order = np.argsort(strings, kind="stable")
        strings, docs = strings[order], docs[order]
        heads = np.nonzero(np.append(True, strings[1:] != strings[:-1]))[0]
        return cls(strings[heads], np.minimum.reduceat(docs, heads), tags[order][heads])


class Family:
    """A logarithmic family of suffix arrays: no two levels hold the same string, and a level is at least twice as long as
    the next, so that n strings lie in at most log2(n) of them."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, strings: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> None:
        """A batch: its suffix array is merge-scanned against every level; what a level has lowers its document there, the
        rest becomes a level of its own, and levels of about equal size merge."""
        if not len(strings):
            return
        new = Level.of(strings, docs, tags)
        for level in self.levels:
            old, mine = scanned(level.strings, new.strings)
            level.docs[old] = np.minimum(level.docs[old], new.docs[mine])
            rest = np.ones(len(new), bool)
            rest[mine] = False
            new = Level(new.strings[rest], new.docs[rest], new.tags[rest])
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.merge()

    def merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        strings = np.concatenate([a.strings, b.strings])
        order = np.argsort(strings, kind="stable")  # two sorted runs: one linear merge
        self.levels.append(Level(strings[order], np.concatenate([a.docs, b.docs])[order], np.concatenate([a.tags, b.tags])[order]))

    def whole(self) -> Level | None:
        """All that the family holds, as one suffix array."""
        while len(self.levels) > 1:
            self.merge()
        return self.levels[0] if self.levels else None


def scanned(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of two suffix arrays are equal, as (places in old, places in new): both are merged, and an entry
    is compared with its neighbour, with which its longest common prefix is the longest."""
    both = np.concatenate([old, new])
    order = np.argsort(both, kind="stable")  # two sorted runs: one linear merge
    merged = both[order]
    same = np.nonzero(merged[1:] == merged[:-1])[0]
    return order[same], order[same + 1] - len(old)


class Group:
    """The rows of one group, in an order that does not depend on how they arrived."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        rows = sorted(((NO_ID if i is None else i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)))
        self.ids = np.array([i for i, _ in rows], np.int64)
        lens = np.array([len(t) for _, t in rows], np.int64)
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.bytes = b"".join(t for _, t in rows)
        del rows
        self.raw = np.frombuffer(self.bytes, np.uint8)
        self.first, self.last, self.keys = anchors(self.raw, self.ends)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def own(self) -> np.ndarray:
        """Keys that this group has, sorted; those that it has in several documents come twice."""
        if not len(self.keys):
            return self.keys
        doc = self.ids[self.doc(self.first)]
        order = np.argsort(self.keys, kind="stable")
        k, d = self.keys[order], doc[order]
        heads = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
        twice = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
        return np.repeat(k[heads], 1 + twice)

    def contexts(self, asked: dict[int, np.ndarray], hot: dict[int, np.ndarray], n: int) -> Contexts:
        """The distinct contexts of the keys asked for (range -> low halves of the keys), and where they occur."""
        wanted, hot = whole(asked), whole(hot)
        rng = ranges_of(self.keys, n)
        full = (self.keys & np.uint64(0xFFFFFFFF)) | (rng.astype(np.uint64) << np.uint64(32))
        at = np.nonzero(among(full, wanted))[0]
        first, rng, full = self.first[at], rng[at], full[at]
        lens = self.last[at] + LENGTH - first
        strings = cut_strings(self.raw, first, lens, LENGTH + SPAN - 1)
        order = np.argsort(strings, kind="stable")
        order = order[np.argsort(rng[order], kind="stable")]
        strings, rng, first, lens, full = (x[order] for x in (strings, rng, first, lens, full))
        new = np.append(True, (strings[1:] != strings[:-1]) | (rng[1:] != rng[:-1])) if len(order) else np.zeros(0, bool)
        return Contexts(self, np.nonzero(new)[0], np.cumsum(new) - 1, rng, first, lens, full, hot, n)


def whole(keys: dict[int, np.ndarray]) -> np.ndarray:
    """Keys with their ranges, in order."""
    parts = [np.sort(v).astype(np.uint64) | np.uint64(r << 32) for r, v in sorted(keys.items())]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in known, which is sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


class Contexts:
    """Occurrences of contexts, by range and context, and in a context by place, so that the first has the least document.

    heads: the first occurrence of each distinct context; which: the distinct context of each occurrence; count and starts:
    windows of each distinct context, end to end. A distinct context of a hot key is taken apart: its windows (the arrays
    of near) have ranges and keys of their own bytes.
    """

    def __init__(self, group: Group, heads, which, rng, first, lens, full, hot, n):
        self.group, self.heads, self.which, self.first, self.lens = group, heads, which, first, lens
        self.ids = group.ids[group.doc(first)]
        self.under = (full & np.uint64(0xFFFFFFFF)).astype("<u4")
        self.count = lens[heads] - (LENGTH - 1)
        self.starts = np.cumsum(self.count) - self.count
        apart = among(full[heads], hot)
        some = np.nonzero(apart)[0]
        self.near_first = spread(first[heads[some]], self.count[some])
        self.near_slot = spread(self.starts[some], self.count[some])
        self.near_ids = np.repeat(self.ids[heads[some]], self.count[some])
        keys = np.zeros(len(self.near_first), np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(keys), BATCH):
                flat = group.raw[spread(self.near_first[at : at + BATCH], np.full(len(keys[at : at + BATCH]), LENGTH))]
                keys[at : at + BATCH] = _mix(rolling(flat, LENGTH)[::LENGTH] * _A)
        near_rng = ranges_of(keys, n)
        self.near_under = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        self.whole, self.near = by_range(rng[heads], np.nonzero(~apart)[0]), by_range(near_rng, np.arange(len(keys)))

    def of(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts, and the windows of hot ones, that go to a range."""
        none = np.zeros(0, np.int64)
        return self.whole.get(r, none), self.near.get(r, none)

    def shipped(self, r: int) -> dict[str, bytes]:
        mine, near = self.of(r)
        heads = self.heads[mine]
        first = np.concatenate([self.first[heads], self.near_first[near]])
        lens = np.concatenate([self.lens[heads], np.full(len(near), LENGTH)])
        sign = np.repeat(np.array([0, LONE]), [len(mine), len(near)])
        under = np.concatenate([self.under[heads], self.near_under[near]])
        ids = np.concatenate([self.ids[heads], self.near_ids[near]])
        raw = self.group.raw[spread(first, lens)]
        return {"lens": (lens + sign).astype(np.uint8).tobytes(), "under": under.tobytes(), "ids": ids.astype("<i8").tobytes(), "bytes": raw.tobytes()}

    def answered(self, bits: dict[int, bytes]) -> np.ndarray:
        """The answers of all ranges, a bit for each window of each distinct context."""
        given = np.zeros(int(self.count.sum()), bool)
        for r, blob in bits.items():
            mine, near = self.of(r)
            slots = np.concatenate([spread(self.starts[mine], self.count[mine]), self.near_slot[near]])
            given[slots] = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(slots)).astype(bool)
        return given


def by_range(rng: np.ndarray, some: np.ndarray) -> dict[int, np.ndarray]:
    """range -> its part of some, in order"""
    some = some[np.argsort(rng[some], kind="stable")]
    there, start = np.unique(rng[some], return_index=True)
    return dict(zip(there.tolist(), np.split(some, start[1:]) if len(there) else [], strict=True))


def _told(table: pa.Table, column: str) -> dict[int, np.ndarray]:
    rows = zip(table.column("rng").to_pylist(), table.column(column).to_pylist(), strict=True)
    return {r: np.frombuffer(blob, "<u4") for r, blob in rows}


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the text without repeated strings.

    A byte goes if a string of 50 bytes that covers it also starts in a row with a smaller doc_id. Null text is empty;
    texts under 50 bytes stay whole; rows of equal doc_id do not remove each other's bytes; a null doc_id (and the least long) is smaller
    than all others; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // GROUP))
    dealt = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    ranged, keyed = "rng int, grp int, keys binary", {"rng": pa.int32(), "grp": pa.int32(), "keys": pa.binary()}
    blob = pa.schema([*keyed.items()])

    def tell(key, table):
        own = Group(table).own()
        rng = ranges_of(own, n)
        there, first = np.unique(rng, return_index=True)
        low = (own & np.uint64(0xFFFFFFFF)).astype("<u4")
        parts = [x.tobytes() for x in np.split(low, first[1:])] if len(there) else []
        return pa.Table.from_arrays([pa.array(there, pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array(parts, pa.binary())], schema=blob)

    answered = pa.schema([*keyed.items(), ("hot", pa.binary())])

    def shared(table):
        parts = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        values, many = np.unique(np.concatenate(parts), return_counts=True)
        several, hot = values[many > 1], values[many > HOT]
        keep = [np.unique(p[among(p, several)]) for p in parts]
        some = [i for i, p in enumerate(keep) if len(p)]
        passed = [table.column(c).take(pa.array(some, pa.int64())) for c in ("rng", "grp")]
        blobs = [[keep[i].tobytes() for i in some], [keep[i][among(keep[i], hot)].tobytes() for i in some]]
        return pa.Table.from_arrays([*passed, *[pa.array(b, pa.binary()) for b in blobs]], schema=answered)

    sent = pa.schema([*answered, *[(c, pa.binary()) for c in ("lens", "under", "ids", "bytes")]])

    def send(key, table, wanted):
        if not wanted.num_rows or not table.num_rows:
            return sent.empty_table()
        g, asked, hot, rows = Group(table), _told(wanted, "keys"), _told(wanted, "hot"), []
        c, none = g.contexts(asked, hot, n), np.zeros(0, "<u4")
        for r in sorted(c.whole.keys() | c.near.keys() | asked.keys()):
            said = {"keys": asked.get(r, none).tobytes(), "hot": hot.get(r, none).tobytes()}
            rows.append({"rng": r, "grp": key[0].as_py(), **said, **c.shipped(r)})
        return pa.Table.from_pylist(rows, schema=sent)

    told = pa.schema([*answered, ("bits", pa.binary())])

    def resolve(table):
        rows = sorted(table.to_pylist(), key=lambda x: x["grp"])
        longest = LENGTH + SPAN - 1
        contexts, batches, held = Family(), [], []
        for i, row in enumerate(rows):  # batches of whole contexts, of several groups where they are small
            lens = np.frombuffer(row["lens"], np.uint8).astype(np.int64)
            sign, lens = lens & LONE, lens & (LONE - 1)
            raw, docs = np.frombuffer(row["bytes"], np.uint8), np.frombuffer(row["ids"], "<i8")
            row["bytes"] = b""
            strings = cut_strings(raw, np.cumsum(lens) - lens, lens, longest, sign)
            batches.append((strings, docs))
            held.append((strings, docs, np.frombuffer(row["under"], "<u4")))
            if i + 1 == len(rows) or sum(len(x) for x, _, _ in held) >= BATCH // SPAN * 8:
                contexts.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        known = contexts.whole() or Level(np.zeros(0, f"S{longest + 1}"), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        # a context that is alone under its anchor meets no other string; windows of the rest get suffix arrays of their own
        _, back, many = np.unique(known.tags, return_inverse=True, return_counts=True)
        rivals = np.nonzero(many[back] > 1)[0]
        windows, at = Family(), 0
        flat = known.strings.view(np.uint8).reshape(len(known), longest + 1)
        count = (flat[:, longest] & (LONE - 1)).astype(np.int64) - (LENGTH - 1)
        steps = np.cumsum(count[rivals])
        while at < len(rivals):
            upto = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + BATCH)))
            strings, docs = windows_of(flat, rivals[at:upto], count, known.docs)
            windows.add(strings, docs, np.zeros(len(docs), np.uint8))
            at = upto
        starts = np.cumsum(count) - count
        seen = np.zeros(int(count.sum()), bool)  # of each window of each distinct context: has a smaller document the string?
        for at in range(0, len(rivals), BATCH // SPAN):
            some = rivals[at : at + BATCH // SPAN]
            strings, docs = windows_of(flat, some, count, known.docs)
            least = windows.whole()
            seen[spread(starts[some], count[some])] = least.docs[np.searchsorted(least.strings, strings)] < docs
        out = []
        for row, (strings, docs) in zip(rows, batches, strict=True):
            which = np.searchsorted(known.strings, strings)
            bits = seen[spread(starts[which], count[which])] | np.repeat(docs > known.docs[which], count[which])
            out.append({**{k: row[k] for k in ("rng", "grp", "keys", "hot")}, "bits": np.packbits(bits).tobytes()})
        return pa.Table.from_pylist(out, schema=told)

    final = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(key, table, answers):
        if not table.num_rows:
            return final.empty_table()
        g = Group(table)
        dup = np.zeros(len(g.raw) + 1, bool)
        if answers.num_rows:
            bits = dict(zip(answers.column("rng").to_pylist(), answers.column("bits").to_pylist(), strict=True))
            c = g.contexts(_told(answers, "keys"), _told(answers, "hot"), n)
            given = c.answered(bits)
            for at in range(0, len(c.which), BATCH // SPAN):  # a bounded number of windows at a time
                some = slice(at, at + BATCH // SPAN)
                which = c.which[some]
                later = c.ids[some] > c.ids[c.heads[which]]
                dup[spread(c.first[some], c.count[which])] = given[spread(c.starts[which], c.count[which])] | np.repeat(later, c.count[which])
        upto = np.cumsum(dup[:-1], dtype=np.int32)  # matched strings that have begun; those of the last LENGTH bytes cover
        covered = upto > 0
        covered[LENGTH:] = upto[LENGTH:] > upto[:-LENGTH]
        rows = []
        for i, a, b in zip(g.ids.tolist(), g.starts.tolist(), g.ends.tolist(), strict=True):
            c = covered[a:b]
            gone = int(c.sum())
            spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if gone else 0
            kept = g.bytes[a:b] if not gone else g.raw[a:b][~c].tobytes()
            rows.append((None if i == NO_ID else i, b - a, gone, spans, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), final, strict=True)], schema=final)

    def freed(function):  # a worker lives on after its group
        def one(table):
            try:
                return function(table)
            finally:
                released()

        def two(key, table):
            try:
                return function(key, table)
            finally:
                released()

        def three(key, table, other):
            try:
                return function(key, table, other)
            finally:
                released()

        return [one, two, three][function.__code__.co_argcount - 1]

    # a task for each group and each range, so that its share does not grow with the input
    dealt = dealt.repartitionById(n, "grp")
    groups = lambda: dealt.groupBy("grp")
    have = groups().applyInArrow(freed(tell), ranged)
    asked = have.repartitionById(n, "rng").groupBy("rng").applyInArrow(freed(shared), f"{ranged}, hot binary")
    shipped = f"{ranged}, hot binary, lens binary, under binary, ids binary, bytes binary"
    given = groups().cogroup(asked.repartitionById(n, "grp").groupBy("grp")).applyInArrow(freed(send), shipped)
    bits = given.repartitionById(n, "rng").groupBy("rng").applyInArrow(freed(resolve), f"{ranged}, hot binary, bits binary")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return groups().cogroup(bits.repartitionById(n, "grp").groupBy("grp")).applyInArrow(freed(finish), result)


def windows_of(flat: np.ndarray, some: np.ndarray, count: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strings, documents) of all windows of LENGTH bytes of some rows of flat, which have count windows each."""
    at = spread(some * flat.shape[1], count[some])
    strings = np.lib.stride_tricks.sliding_window_view(flat.reshape(-1), LENGTH)[at]
    return strings.reshape(-1).view(f"S{LENGTH}"), np.repeat(docs[some], count[some])


#: The same in DuckDB's SQL. Texts are compared as hex, two digits a byte.
ORACLE = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
g AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS s FROM d),
k AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 100)) AS k FROM g),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
m AS (SELECT k.doc_id, k.s FROM k JOIN f USING (k) WHERE f.first < k.doc_id),
i AS (SELECT *, CASE WHEN s <= lag(s) OVER w + 50 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
j AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM i),
runs AS (SELECT doc_id, r, min(s) AS a, max(s) + 50 AS b FROM j GROUP BY doc_id, r),
kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
glued AS (
  SELECT d.doc_id, sum(b - a) AS gone, count(*) AS spans,
         string_agg(substr(d.h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) || substr(any_value(d.h), CAST(2 * max(b) + 1 AS BIGINT)) AS h
  FROM kept JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(glued.h, d.h))) AS kept_sha256
FROM d LEFT JOIN glued USING (doc_id)
"""
