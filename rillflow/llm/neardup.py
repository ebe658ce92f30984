"""N-gram Jaccard join: MinHash bands propose, Bayesian pruning thins, exact sets decide.

1. Texts of one shingle set are one class; all that follows works on one text of each class.
2. A class has 128 MinHash values of 16 bits in 32 bands of 4. Two sets of Jaccard 0.8 share no band with probability
   (1 - 0.8**4)**32, 5 in 10**8.
3. The classes of a band value are compared 16 values at a time; a pair goes when the posterior probability that its
   Jaccard reaches the threshold, given the values that agree so far and a uniform prior, is under the tolerance. Only
   links to one root per connected part of what is left leave the task, never the pairs.
4. Connected components of those links hold every pair that is still open. Each component's texts come together once
   more, the pairs that the pruning leaves are decided by exact intersections, and the links that hold are counted and
   joined again.

A band value or component of more than BLOCK classes is cut into blocks, and each pair of blocks is a task of its own, so
a group of any size spreads; every pair is still looked at, in one task. Components of long texts are cut finer, by their
shingles, so that what a task holds is bounded by its longest texts, not by their number. Texts are found again through a semi-join filter
of bounded size. What a task emits is a row a class, not a row a pair.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, components, materialise, partitions, passing, prefilter, released, residue, texts_of

SIZE, THRESHOLD = 5, 0.8
HASHES, BANDS = 128, 32
STEP, TOLERANCE = 16, 1e-7
#: Classes of one block; a task holds two.
BLOCK = 1024
#: Shingles of a class, on average over a component, up to which BLOCK classes make a block; longer texts make smaller ones.
TYPICAL = 4096
REMEMBER = 400_000
_M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


@lru_cache(maxsize=1)
def least_agreeing() -> list[int]:
    """For n = STEP, 2*STEP, ... values: the fewest agreeing ones at which P(Jaccard >= THRESHOLD) reaches TOLERANCE.

    With a uniform prior the posterior after k of n agree is Beta(k+1, n-k+1), whose upper tail at t is the chance of at
    most k successes in n+1 trials of probability t.
    """
    from math import comb

    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for k in range(n + 1):
            tail += comb(n + 1, k) * THRESHOLD**k * (1 - THRESHOLD) ** (n + 1 - k)
            if tail >= TOLERANCE:
                out.append(k)
                break
    return out


class Shingler:
    """Sets of 64-bit hashes of five neighbouring words. A text of one to four words has one shingle, all its words."""

    def __init__(self):
        self.codes, self.hash = Codes(), np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.codes) > REMEMBER:
            self.__init__()
        flat, many = [], []
        for text in texts:
            ws = text.encode().split() if text else []
            many.append(len(ws))
            flat += ws
        code = self.codes.of(flat)
        if fresh := self.codes.taken():
            self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))])
        w = self.hash[code]
        with np.errstate(over="ignore"):
            if len(w) >= SIZE:
                h = w[: len(w) - SIZE + 1].copy()
                for k in range(1, SIZE):
                    h = h * _M + w[k : len(w) - SIZE + 1 + k]
                h = mixed(h)
            out, at = [], 0
            for n in many:
                if n >= SIZE:
                    out.append(np.unique(h[at : at + n - SIZE + 1]))
                elif n:
                    s = np.uint64(n)
                    for x in w[at : at + n]:
                        s = s * _M + x
                    out.append(mixed(np.array([s ^ np.uint64(0x5BD1E995)])))
                else:
                    out.append(np.zeros(0, np.uint64))
                at += n
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def signature(s: np.ndarray) -> np.ndarray:
    a, b = family()
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 1024):
            v = x[at : at + 1024][:, None] * a + b
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA6B)
            low = np.minimum(low, v.min(axis=0))
    return ((low ^ (low >> np.uint32(16))) & np.uint32(0xFFFF)).astype("<u2")


def class_of(s: np.ndarray) -> bytes:
    return blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, _k, hi, lo, size, sig) of docs: hi and lo are the 128 bits of the shingle set's digest, null without
    shingles; size is the set's; _k is a hash of doc_id and text."""
    names = ["doc_id", "_k", "hi", "lo", "size", "sig"]

    def run(batches):
        shingle = Shingler()
        for batch in batches:
            for at, texts in texts_of(batch, "text"):
                sets = shingle(texts)
                keys = np.frombuffer(b"".join(class_of(s) for s in sets), "<i8").reshape(-1, 2)
                none = np.array([not len(s) for s in sets], bool)
                passed = [batch.column(c).slice(at, len(texts)) for c in ("doc_id", "_k")]
                sigs = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*passed, *[pa.array(keys[:, i], pa.int64(), mask=none) for i in (0, 1)], pa.array(map(len, sets), pa.int64()), sigs], names=names)
        shingle = None
        released()

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), "text").mapInArrow(run, "doc_id long, _k long, hi long, lo long, size long, sig binary")


def labelled(n: int, hit: np.ndarray) -> np.ndarray:
    """The least member of each one's connected part under the symmetric matrix hit."""
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(hit, label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def survivors(sig: np.ndarray) -> np.ndarray:
    """Pairs of rows that Bayesian pruning leaves, as a symmetric matrix."""
    n = len(sig)
    agree = np.zeros((n, n), np.int16)
    live = np.ones((n, n), bool)
    for step, least in enumerate(least_agreeing()):
        part = sig[:, step * STEP : (step + 1) * STEP]
        if live.mean() > 0.05 or n < 64:
            for k in range(STEP):
                agree += part[:, k, None] == part[None, :, k]
        else:
            i, j = np.nonzero(live)
            agree[i, j] += (part[i] == part[j]).sum(axis=1, dtype=np.int16)
        live &= agree >= least
    np.fill_diagonal(live, False)
    return live


def in_groups(batches, keys: list[str]):
    """Runs of rows with equal keys from batches that are sorted by them, as tables; a run may span batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.nonzero(new)[0].tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if now is not None and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, keys: list[str], count: DataFrame, member: str) -> DataFrame:
    """rows once for each pair of blocks of their group that their block is in: (a, b, mine), a <= b. count: keys, n."""
    rows = rows.join(count, keys).withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(F.col(member), F.lit("block")), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumns({"a": F.least("mine", "_other"), "b": F.greatest("mine", "_other")}).drop("_other", "_blocks", "n")


def candidates(reps: DataFrame) -> DataFrame:
    """Links (u, v) between classes of reps (cid, sig) that hold all pairs left by the bands and the pruning."""
    n = partitions(reps.sparkSession)
    width = 2 * HASHES // BANDS
    bands = reps.select("cid", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("i"), "sig").select("cid", F.xxhash64("i", F.expr(f"substring(sig, i * {width} + 1, {width})")).alias("band"))
    count = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(in_blocks(bands, ["band"], count, "cid"), "bands")
    met = met.join(reps.select("cid", "sig"), "cid").repartition(n, "band", "a", "b").sortWithinPartitions("band", "a", "b")

    def links(batches):
        for t in in_groups(batches, ["band", "a", "b"]):
            if t.num_rows < 2:
                continue
            cid = t.column("cid").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(cid), HASHES)
            if len(cid) == 2:
                same = np.cumsum((sig[0] == sig[1]).reshape(-1, STEP).sum(axis=1))
                if (same >= least_agreeing()).all():
                    yield pa.RecordBatch.from_arrays([pa.array(cid[:1]), pa.array(cid[1:])], names=["u", "v"])
                continue
            root = labelled(len(cid), survivors(sig))
            some = np.nonzero(root != np.arange(len(cid)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[root[some]])], names=["u", "v"])

    return met.mapInArrow(links, "u long, v long").distinct()


def verified(sets: list[np.ndarray], live: np.ndarray) -> np.ndarray:
    """Which pairs of the symmetric matrix live have a Jaccard of THRESHOLD or more, exactly.

    Few pairs are merged one by one; many by products of the sets' incidence matrices, a stretch of shingles at a time,
    for the sets that have a live pair.
    """
    n = len(sets)
    hit = np.zeros((n, n), bool)
    lens = np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(live))
    if not len(i):
        return hit
    if len(i) < 4 * n:
        inter = np.fromiter((np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    else:
        inter = shared(sets)[i, j]
    ok = 9 * inter >= 4 * (lens[i] + lens[j])  # inter / union >= 4/5
    hit[i[ok], j[ok]] = hit[j[ok], i[ok]] = True
    return hit


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    word = np.cumsum(new) - 1
    several = np.bincount(word)[word] > 1
    word, owner = word[several], owner[several]
    _, word = np.unique(word, return_inverse=True)
    inter = np.zeros((n, n), np.float32)
    width, total = 4096, int(word.max()) + 1 if len(word) else 0
    cut = np.searchsorted(word, np.arange(0, total + width, width))
    for k in range(len(cut) - 1):
        x = np.zeros((n, width), np.float32)
        x[owner[cut[k] : cut[k + 1]], word[cut[k] : cut[k + 1]] - k * width] = 1
        inter += x @ x.T
    return np.rint(inter).astype(np.int64)


def join(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id, n_links, n_copies, n_texts (and has_words, _k: a hash of doc_id and text).

    class_id: the least doc_id of the connected class of links (Jaccard of five-word shingles at least 0.8); n_links: the
    rows that are linked to this one directly, copies included; n_copies: those of them with the same shingles; n_texts:
    linked shingle sets that differ. Null, empty and blank texts have no shingles and no links; they and rows without
    links are classes of their own. Rows of equal doc_id are rows of their own. Only the two named columns are read.
    """
    docs = docs.select("doc_id", "text")
    with passing(docs.sparkSession) as keep:
        rows = keep(classes(docs), "classes")
        known = keep(grouped(docs, rows), "known")
    first = known.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least")).alias("m")).select("root", F.col("m.least").alias("class_id"))
    named = known.join(first, "root").select("hi", "lo", "copies", "sets", "docs", "class_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    copies, has_words = zero(F.col("copies") - 1), F.col("hi").isNotNull()
    counted = [(copies + zero(F.col("docs"))).alias("n_links"), copies.alias("n_copies"), zero(F.col("sets")).alias("n_texts")]
    own = F.when(has_words, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")
    return rows.select("doc_id", "_k", "hi", "lo").join(named, ["hi", "lo"], "left").select("doc_id", own, *counted, has_words.alias("has_words"), "_k")


def grouped(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(hi, lo, copies, least, sets, docs, root) of the classes of rows: rows that have each, its least doc_id, linked classes
    and their rows, and the connected part that it is in."""
    n = partitions(docs.sparkSession)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("_least")
    reps = rows.where("hi is not null").groupBy("hi", "lo").agg(F.first("sig").alias("sig"), F.first("size").alias("size"), F.count("*").alias("copies"), least)
    # a class is numbered as the table is written, so that what follows moves one long a class
    reps = reps.select(F.monotonically_increasing_id().alias("cid"), "hi", "lo", "sig", "size", "copies", F.col("_least.doc_id").alias("least"))
    reps = materialise(reps, "sets")
    near = components(candidates(reps), "near")
    near = near.join(reps, near["node"] == F.col("cid")).select("cid", "root", "hi", "lo", "sig", "size", "copies", "least")
    near = materialise(near, "open")
    texts = prefilter(docs, near.select(F.col("least").alias("doc_id")), "doc_id")
    texts = texts.join(near, F.col("doc_id").eqNullSafe(F.col("least"))).select("cid", "root", "hi", "lo", "sig", "copies", "text")
    count = near.groupBy("root").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") / TYPICAL)).alias("n"))
    texts = in_blocks(texts, ["root"], count, "cid").repartition(n, "root", "a", "b").sortWithinPartitions("root", "a", "b")
    out = pa.schema([("cid", pa.int64()), ("sets", pa.int64()), ("docs", pa.int64()), ("link", pa.int64())])

    def decide(batches):
        shingle = Shingler()
        for t in in_groups(batches, ["root", "a", "b"]):
            whose = np.stack([t.column(c).to_numpy() for c in ("hi", "lo")], axis=1).astype("<i8")
            cid, seen, keep, sets = t.column("cid").to_pylist(), set(), [], []
            text = t.column("text").to_pylist()
            for at in range(0, len(text), 256):
                for i, s in enumerate(shingle(text[at : at + 256]), at):
                    # a row of the same doc_id may have another text
                    if len(s) and cid[i] not in seen and class_of(s) == whose[i].tobytes():
                        seen.add(cid[i])
                        keep.append(i)
                        sets.append(s)
            if len(keep) < 2:
                continue
            ids, copies, mine = (np.array(t.column(c).to_numpy())[keep] for c in ("cid", "copies", "mine"))
            sig = np.frombuffer(b"".join(t.column("sig").take(pa.array(keep)).to_pylist()), "<u2").reshape(len(keep), HASHES)
            live = survivors(sig)
            if t.column("a")[0].as_py() != t.column("b")[0].as_py():
                live &= mine[:, None] != mine[None, :]
            hit = verified(sets, live)
            root = labelled(len(ids), hit)
            some = np.nonzero(hit.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(hit.sum(axis=1)[some]), pa.array((hit @ copies)[some]), pa.array(ids[root[some]])], schema=out)
        shingle = None
        released()

    links = materialise(texts.mapInArrow(decide, "cid long, sets long, docs long, link long"), "links")
    parts = components(links.select(F.col("cid").alias("u"), F.col("link").alias("v")), "parts")
    counts = links.groupBy("cid").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    known = reps.select("cid", "hi", "lo", "copies", "least").join(counts, "cid", "left").join(parts.select(F.col("node").alias("cid"), "root"), "cid", "left")
    return known.select("hi", "lo", "copies", "least", "sets", "docs", F.coalesce("root", "cid").alias("root"))


def distinct(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; rows without words all stay.

    A row without a doc_id is the greatest of its class; rows that are equal in doc_id and text are one document and
    share its fate. Columns and their values pass through; only texts that may go are shuffled.
    """
    names = docs.columns
    with passing(docs.sparkSession) as keep:
        gone = join(docs).where(F.col("has_words") & ~F.col("doc_id").eqNullSafe(F.col("class_id")))
        gone = keep(gone.select("_k", F.col("doc_id").alias("_i")).distinct(), "gone")
    small = F.broadcast(gone.select(residue("_k").alias("_res")).distinct())  # at most RESIDUES rows
    flat = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d"), "doc_id", F.xxhash64("doc_id", "text").alias("_key"))
    flat = flat.withColumn("_res", residue("_key"))
    may = flat.join(small, "_res", "left_semi").join(gone, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left_anti")
    kept = may.select("_d").union(flat.join(small, "_res", "left_anti").select("_d"))
    return kept.select(*[F.col(f"_d.`{c}`").alias(c) for c in names])


#: op10's rows in DuckDB's SQL: every pair of texts that share a shingle, by exact sets of the shingles themselves.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN NULL WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)])) END AS shingles
  FROM w),
k AS (SELECT rid, doc_id, sha256(array_to_string(shingles, chr(10))) AS cid, shingles FROM g),
c AS (SELECT cid, count(*) AS copies, min(doc_id) AS least, any_value(shingles) AS shingles FROM k WHERE cid IS NOT NULL GROUP BY cid),
s AS (SELECT cid, len(shingles) AS n, unnest(shingles) AS shingle FROM c),
p AS (
  SELECT a.cid AS u, b.cid AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.cid < b.cid
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT r.u AS cid, min(c.least) AS least FROM r JOIN c ON r.v = c.cid GROUP BY r.u),
o AS (SELECT e.u AS cid, sum(c.copies) AS docs, count(*) AS texts FROM e JOIN c ON e.v = c.cid GROUP BY e.u)
SELECT k.doc_id, CASE WHEN k.cid IS NULL THEN k.doc_id ELSE least(c.least, m.least) END AS class_id,
       CAST(coalesce(c.copies - 1, 0) + coalesce(o.docs, 0) AS BIGINT) AS n_links,
       CAST(coalesce(c.copies - 1, 0) AS BIGINT) AS n_copies, CAST(coalesce(o.texts, 0) AS BIGINT) AS n_texts
FROM k LEFT JOIN c ON k.cid = c.cid LEFT JOIN m ON k.cid = m.cid LEFT JOIN o ON k.cid = o.cid
"""
