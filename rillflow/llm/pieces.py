"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, materialise, released, spread, texts_of

REMEMBER = 400_000
#: Characters of a word beyond which its pairs wait in a queue.
LONG_WORD = 1000
CHUNK = re.compile(r" +[^ ]*|[^ ]+")
BLANK = "▁"


class Pieces:
    """A byte-fallback BPE model of the sentencepiece library: its pieces and scores are read, its encoder is not used.

    No piece has a blank after another character, so a text falls into words, each with the blanks before it, that never
    merge with one another; each distinct word is encoded once.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.end = sp.eos_id()
        self.byte = np.zeros(256, np.int64)
        symbols: dict[str, int] = {}
        score: dict[int, float] = {}
        self.raw: list[bytes] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
            else:
                symbols[piece] = i
                score[i] = sp.get_score(i)
                self.raw.append(piece.replace(BLANK, " ").encode())
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError("a piece spans words")
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.size = size
        pairs = [(symbols[p[:k]], symbols[p[k:]], i) for p, i in symbols.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        key = np.array([a * size + b for a, b, _ in pairs], np.int64)
        rank = np.array([order[score[i]] for _, _, i in pairs], np.int64)
        # an open hash table with few collisions: key -> (rank, piece)
        self.shift = np.uint64(64 - max(4, (8 * len(pairs)).bit_length()))
        slots = 1 << int(64 - self.shift)
        self.key, self.rank, self.into = np.full(slots + 64, -2, np.int64), np.zeros(slots + 64, np.int64), np.zeros(slots + 64, np.int64)
        for k, r, (_, _, i), at in zip(key.tolist(), rank.tolist(), pairs, self.slot(key).tolist(), strict=True):
            while self.key[at] != -2:
                at += 1
            self.key[at], self.rank[at], self.into[at] = k, r, i
        ranks = {}
        for i, s in score.items():
            ranks.setdefault(order[s], set()).add(i)
        self.alone = np.array([len(ranks[k]) == 1 for k in range(len(order))], bool)  # ranks of a single piece
        self.symbols, self.merges = symbols, None
        self.forget()

    def forget(self):
        self.codes, self.at, self.len, self.ids = Codes(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of neighbouring symbols; the rank is past all others where they do not merge."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        pos = self.slot(key)
        there = self.key[pos]
        more = np.nonzero((there != key) & (there != -2))[0]
        while len(more):
            pos[more] += 1
            there[more] = self.key[pos[more]]
            more = more[(there[more] != key[more]) & (there[more] != -2)]
        ok = there == key
        return np.where(ok, self.rank[pos], len(self.alone)), np.where(ok, self.into[pos], -1)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each word). Words have blanks in place of spaces.

        A round: the least pair rank of every word that can still merge; its leftmost occurrence merges, and with it the
        other occurrences that do not overlap. They wait, and only the leftmost merges, where the library's order could
        differ: if several pieces have that rank, or if a merge makes a pair of a lower rank.
        """
        if any(len(w) > LONG_WORD for w in words):
            own = [self.queued(w) if len(w) > LONG_WORD else self.words([w])[0] for w in words]
            return np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
        chars = "".join(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        uniq, inv = np.unique(code, return_inverse=True)
        table = np.array([self.symbols.get(chr(c), -1 - c) for c in uniq.tolist()], np.int64)
        sym = table[inv] if len(code) else code
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        none = len(self.alone)
        while len(sym):
            rank, into = self.pair(sym[:-1], sym[1:])
            rank = np.where(word[:-1] == word[1:], rank, none)
            rank = np.append(rank, none)
            into = np.append(into, -1)
            heads = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
            best = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(sym)))
            live = np.repeat(best < none, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, into = sym[live], word[live], rank[live], into[live]
                size, best = size[best < none], best[best < none]
                if not len(sym):
                    break
                heads = np.cumsum(size) - size
            least = np.repeat(best, size)
            hit = np.nonzero(rank == least)[0]
            # leftmost of overlapping occurrences: within a run of neighbours, every second one
            run = np.append(True, np.diff(hit) != 1)
            start = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            pick = hit[(hit - start) % 2 == 0]
            owner = np.repeat(np.arange(len(size)), size)[pick]
            first = np.append(True, owner[1:] != owner[:-1])
            many = np.zeros(len(size), bool)
            many[owner[~first]] = True
            if many.any():  # is it safe to merge them together?
                risky = ~self.alone[best]
                merged = sym.copy()
                merged[pick] = into[pick]
                gone = np.zeros(len(sym), bool)
                gone[pick + 1] = True
                kept = np.nonzero(~gone)[0]
                m = merged[kept]
                r, _ = self.pair(m[:-1], m[1:])
                fresh = np.zeros(len(sym), bool)
                fresh[pick] = True
                f = fresh[kept]
                w = np.repeat(np.arange(len(size)), size)[kept]
                low = np.nonzero((f[:-1] | f[1:]) & (w[:-1] == w[1:]) & (r < best[w[:-1]]))[0]
                risky[w[low]] = True
                pick = pick[first | ~risky[owner]]
            sym[pick] = into[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        sym, width = self.fallen(sym)
        return sym, np.bincount(np.repeat(word, width), minlength=len(words))

    def fallen(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each symbol): a character that is no piece falls back to its bytes."""
        width = np.ones(len(sym), np.int64)
        unknown = np.nonzero(sym < 0)[0]
        if not len(unknown):
            return sym, width
        parts = [chr(-1 - c).encode("utf-8", "replace") for c in sym[unknown].tolist()]
        width[unknown] = [len(p) for p in parts]
        first = np.cumsum(width) - width
        out = np.repeat(sym, width)
        out[spread(first[unknown], width[unknown])] = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        return out, width

    def queued(self, word: str) -> np.ndarray:
        """The ids of one long word: its pairs wait in a queue by rank and place, so that each merge looks at its two
        neighbours alone. Rounds would look at the whole word for every rank in it."""
        if self.merges is None:
            there = np.nonzero(self.key != -2)[0]
            self.merges = dict(zip(self.key[there].tolist(), zip(self.rank[there].tolist(), self.into[there].tolist(), strict=True), strict=True))
        sym = [self.symbols.get(c, -1 - ord(c)) for c in word]
        n, merges, size = len(sym), self.merges, self.size
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []

        def offer(i, j):
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0:
                found = merges.get(sym[i] * size + sym[j])
                if found:
                    heapq.heappush(queue, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = -(1 << 40)
        while queue:
            _, i, j, a, b, into = heapq.heappop(queue)
            if sym[i] != a or sym[j] != b or right[i] != j:
                continue
            sym[i], sym[j] = into, gone
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return self.fallen(np.array([s for s in sym if s != gone], np.int64))[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text), without end ids."""
        if len(self.codes) > REMEMBER:
            self.forget()
        found, many = [], []
        for text in texts:
            if not text:
                many.append(0)
                continue
            text = text.replace(BLANK, " ")
            if "  " in text or text[0] == " " or text[-1] == " ":
                ws = [w if w[0] == " " else " " + w for w in CHUNK.findall(" " + text)]
                ws = [w[1:] if w[0] == " " else w for w in ws]
            else:
                ws = text.split(" ")
            many.append(len(ws))
            found += ws
        code = self.codes.of(found)
        if fresh := self.codes.taken():
            ids, lens = self.words([(" " + w).replace(" ", BLANK) for w in fresh])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.ids = np.concatenate([self.ids, ids])
        lens = self.len[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        cut = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        return self.ids[spread(self.at[code], lens)], ends[cut[1:]] - ends[cut[:-1]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces end to end, one blank at the start dropped, invalid bytes as U+FFFD each."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def model(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str, carry: list[str], ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for): the ids of the library, with its end id.

    Null text is empty: the end id alone. Rows stay where they are; nothing is shuffled; the result is written once. Only
    the columns carry are passed, so names of the new ones clash only if they are among them, which is an error. Repeated
    rows are rows of their own; whole texts are encoded, about BATCH_CHARS characters at a time; an empty table gives none.
    """
    if clash := {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} & set(carry):
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    from pyspark.sql import types as T

    extra = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    extra |= {"ids": T.ArrayType(T.IntegerType())} if ids else {}
    out = T.StructType([*docs.select(*carry).schema.fields, *[T.StructField(n, t) for n, t in extra.items()]])

    def run(batches):
        m = model(path)
        names = np.array([str(i) for i in range(m.size)], object)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for at, texts in texts_of(batch, "_text"):  # a batch of its own for each stretch of texts
                flat, lens = m.encode([x or "" for x in texts])
                flat, lens = np.insert(flat, np.cumsum(lens), m.end), lens + 1
                ends = np.cumsum(lens)
                coded, decoded = [], []
                for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True):
                    own = flat[a:b].tolist()
                    coded.append(sha(" ".join(map(names.__getitem__, own))))
                    decoded.append(sha(m.decode(own)))
                made = [pa.array(lens), pa.array(coded), pa.array(decoded)]
                if ids:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(texts)) for c in carry], *made], names=out.names)
        m.forget()
        released()

    return materialise(docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, out), "pieces")
