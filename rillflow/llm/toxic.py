"""Toxicity: a learned lexicon, matched with misspellings by Levenshtein automata over a trie, read in context."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts_of
from .langid import held_out

#: The lexicon and the weights are fitted on at most this many labelled documents, those of the least hash of their id.
FIT_DOCS = 20_000
#: Most terms of the lexicon; a term's distinct texts must be toxic this often, in so many different contexts at least.
TERMS, PURITY, LEAST = 400, 0.8, 5
#: Terms of this length or more may differ in two edits, those of four or more in one.
LONG = 8
#: Most harmless words that the model keeps.
KNOWN = 50_000
REMEMBER = 300_000
#: Words on each side of a hit that make its context.
WINDOW = 6
#: Words that come with quoting, reporting or naming a term rather than using it (fixed list).
QUOTING = {"said", "says", "quote", "quoted", "quotes", "word", "words", "term", "called", "wrote", "writes", "reported", "slur", "slurs", "insult", "insults", "meaning", "means", "definition", "dijo", "palabra", "mot", "dit", "sagte", "wort"}
MARKS = set("\"'«»“”„‘’")
#: A word, with signs inside it that stand for letters (f**k, id!ot), or a quotation mark.
TOKEN = re.compile(r"[^\W_]+(?:[*@$!#]+[^\W_]+)*|[\"'«»“”„‘’]")
HIDDEN = re.compile(r"[*@$!#]")
#: So many letters on their own, with one sign or blank between each two, are a word spelled out (s.t.u.p.i.d).
SPELLED = 4
APART = re.compile(rf"(?<![^\W_])(?<![*@$!#])[^\W\d_]([.\-_ ])[^\W\d_](?:\1[^\W\d_]){{{SPELLED - 2},}}(?![^\W_])")
#: Digits and signs that stand for letters (fixed table).
LEET = str.maketrans("013457", "oleast")
NAMES = ["bias", "exact", "fuzzy", "quoted", "rate"]


class Trie:
    """Terms as a trie, intersected with the Levenshtein automata of all their edits up to limit.

    A state is the set of (node, edits so far, character that a transposition still owes). A character of the word moves
    it by matching, substituting or inserting; skipping a character of a term is closed over at once. A * matches any
    character. Sets are numbered as words first reach them, so that later words take one table step a character; the empty
    set ends a word at once.
    """

    MOST = 200_000  # remembered moves; beyond, the table starts anew

    def __init__(self, terms, limit: int):
        self.limit, self.kids, self.term = limit, [{}], [None]
        for term in sorted(terms):
            at = 0
            for ch in term:
                if ch not in self.kids[at]:
                    self.kids[at][ch] = len(self.kids)
                    self.kids.append({})
                    self.term.append(None)
                at = self.kids[at][ch]
            self.term[at] = term
        self.restart()

    def restart(self):
        self.states, self.number, self.moves = [], {}, {}
        self.first = self.state({(0, 0, "")})

    def state(self, items: set) -> int:
        """The number of a closed set; of two entries that differ only in edits, the lesser stays."""
        best: dict[tuple[int, str], int] = {}
        stack = list(items)
        while stack:
            node, edits, owed = stack.pop()
            if edits > self.limit or best.get((node, owed), self.limit + 1) <= edits:
                continue
            best[node, owed] = edits
            if not owed:
                stack += [(kid, edits + 1, "") for kid in self.kids[node].values()]
        key = frozenset((n, e, o) for (n, o), e in best.items())
        if key not in self.number:
            ends = [(e, self.term[n]) for n, e, o in key if not o and self.term[n] is not None]
            self.number[key] = len(self.states)
            self.states.append((key, min(ends, default=None)))
        return self.number[key]

    def move(self, at: int, ch: str) -> int:
        items = set()
        for node, edits, owed in self.states[at][0]:
            if owed:
                if ch == owed:
                    items.add((node, edits, ""))
                continue
            items.add((node, edits + 1, ""))
            for c, kid in self.kids[node].items():
                items.add((kid, edits + (c != ch and ch != "*"), ""))
                if c != ch and ch in self.kids[kid]:
                    items.add((self.kids[kid][ch], edits + 1, c))
        return self.state(items)

    def near(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within the limit, a transposition being one edit; ties by term."""
        if len(self.moves) > self.MOST:
            self.restart()
        at, moves = self.first, self.moves
        for ch in word:
            to = moves.get((at, ch))
            if to is None:
                to = moves[at, ch] = self.move(at, ch)
            at = to
            if not self.states[at][0]:
                return None
        found = self.states[at][1]
        return None if found is None else (found[1], found[0])


def squeezed(word: str) -> str:
    """A word with look-alike digits as letters and letters repeated three times or more as one."""
    return re.sub(r"(.)\1{2,}", r"\1", word.translate(LEET))


def tokens(text: str | None) -> list[str]:
    """Words and quotation marks of a text in lower case; signs in words are *, a word spelled out is joined."""
    if not text:
        return []
    text = text.lower()
    out = TOKEN.findall(text)
    sizes = list(map(len, out))
    if sizes.count(1) >= SPELLED and any(sum(sizes[i : i + SPELLED]) == SPELLED for i in range(len(sizes) - SPELLED + 1)):
        out = TOKEN.findall(APART.sub(lambda m: m.group()[::2], text))
        sizes = list(map(len, out))
    if not all(map(str.isalnum, out)):
        for i, w in enumerate(out):
            if sizes[i] > 1 and not w.isalnum():
                apart = sizes[i] % 2 and all(map(HIDDEN.match, w[1::2])) and w[::2].isalpha()
                out[i] = w[::2] if apart and sizes[i] >= 2 * SPELLED - 1 else HIDDEN.sub("*", w)
    return out


class Scorer:
    """Features of texts: each hit of the lexicon counts by its term's weight and its distance; a hit between quotation
    marks or near a word of quoting counts as quoted instead. The score is a logistic function of them."""

    def __init__(self, terms: dict[str, float], known: set[str], weights: list[float] | None = None):
        self.terms, self.known, self.weights = terms, known, weights
        self.tries = [Trie([t for t in terms if 4 <= len(t) < LONG], 1), Trie([t for t in terms if len(t) >= LONG], 2)]
        self.codes: dict[str, tuple[float, bool] | None] = {}

    def hit(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of a word, or None; common harmless words are never misspellings."""
        if word in self.terms:
            return self.terms[word], True
        if word in self.known or len(word) < 4:
            return None
        found = None
        for w in dict.fromkeys((word, squeezed(word))):
            for trie in self.tries:
                found = found or trie.near(w)
        if found is None:
            return None
        return self.terms[found[0]] * (0.8 if found[1] < 2 else 0.6), False

    def features(self, text: str | None) -> list[float]:
        words = tokens(text)
        if len(self.codes) > REMEMBER:
            self.codes.clear()
        codes, hits = self.codes, []
        for i, w in enumerate(words):
            try:
                h = codes[w]
            except KeyError:
                h = codes[w] = self.hit(w)
            if h is not None:
                hits.append((i, h))
        exact = fuzzy = quoted = 0.0
        for i, (weight, is_exact) in hits:
            left, right = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            marks = any(w in MARKS for w in left) and any(w in MARKS for w in right)
            if marks or any(w in QUOTING for w in left):
                quoted += weight
            elif is_exact:
                exact += weight
            else:
                fuzzy += weight
        n = max(1, sum(w not in MARKS for w in words))
        return [1.0, min(exact, 6.0), min(fuzzy, 6.0), min(quoted, 6.0), min(1.0, 50 * (exact + fuzzy) / n)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.features(text), self.weights, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, prior: tuple = (-3.0, 3.0, 1.5, 0.3, 0.5)) -> list[float]:
    """Weights by Newton steps, drawn towards prior; a feature without examples keeps it."""
    w0 = np.array(prior)
    w = w0.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * (w - w0))
        w += np.clip(step, -2, 2)
    return [float(v) for v in w]


def rows_of(batches, *columns: str):
    """(text, values of columns) of the rows of batches, a bounded stretch of texts at a time."""
    for batch in batches:
        for at, texts in texts_of(batch, "text"):
            yield from zip(texts, *(batch.column(c).slice(at, len(texts)).to_pylist() for c in columns), strict=True)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, most_terms: int = TERMS, most_known: int = KNOWN) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, toxic), at most fit_docs rows; null labels teach nothing.

    A lexicon of more than most_terms keeps those that tell most, of more than most_known harmless words the commonest; a
    rarer harmless word may then be taken for the misspelling of a term.

    Frequencies of words by label, over distinct texts, are counted on the executors and added up by key; the lexicon and
    the common harmless words that come to the driver are bounded. A term needs LEAST first contexts, whatever its count.
    """
    pick = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    once = sample.groupBy("text", "toxic").agg(F.count("*").alias("copies"))

    def count(batches):  # of a toxic text, the first context of each word: near copies share it, however many they are
        tally: Counter = Counter()
        copied: Counter = Counter()
        for text, y, copies in rows_of(batches, "toxic", "copies"):
            words = ["", *tokens(text), ""]
            first = {words[i]: f"{words[i - 1]} {words[i + 1]}" if y == 1 else None for i in range(len(words) - 2, 0, -1) if len(words[i]) > 2}
            for key in [*((w, y, c) for w, c in first.items()), ("", y, None)]:
                tally[key] += 1
                copied[key] += copies
        kinds = pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("context", pa.string()), ("n", pa.int64()), ("rows", pa.int64())])
        columns = [*zip(*tally, strict=True)] or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*columns, tally.values(), map(copied.get, tally)], kinds, strict=True)], schema=kinds)

    bad = F.col("toxic") == 1
    sums = {"bad": F.when(bad, F.col("n")), "good": F.when(~bad, F.col("n")), "clean": F.when(~bad, F.col("rows"))}
    df = once.mapInArrow(count, "word string, toxic int, context string, n long, rows long").groupBy("word", "context")
    df = df.agg(*[F.sum(F.coalesce(x, F.lit(0))).alias(name) for name, x in sums.items()])
    df = df.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "clean")], F.count("context").alias("contexts"))
    df = materialise(df, "words")
    total = {r[0]: (r[1], r[2]) for r in df.where("word = ''").select("word", "bad", "good").collect()}
    nb, ng = total.get("", (0, 0))
    lift = (F.col("bad") + 0.5) / (nb + 1) / ((F.col("good") + 0.5) / (ng + 1))
    telling = (F.col("word") != "") & (F.col("contexts") >= LEAST) & (F.col("bad") >= PURITY * (F.col("bad") + F.col("good")))
    rows = df.where(telling).withColumn("lift", lift).where("lift > 20").orderBy(F.desc(F.col("bad") * F.log("lift")), "word").limit(most_terms).collect()
    terms = {r["word"]: min(1.5, math.log(r["lift"]) / 4) for r in rows}
    known = {r[0] for r in df.where((F.col("clean") >= 2) & (F.col("word") != "")).orderBy(F.desc("clean"), "word").limit(most_known).collect()}
    scorer = Scorer(terms, known)
    share = docs.sparkSession.sparkContext.broadcast({"scorer": scorer})

    def featured(batches):
        s = share.value["scorer"]
        for batch in batches:
            x = [s.features(t) for _, texts in texts_of(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in x], pa.float64()) for i in range(5)] + [batch.column("toxic")], names=[*NAMES, "toxic"])

    told = ", ".join(f"{n} double" for n in NAMES) + ", toxic int"
    got = materialise(sample.mapInArrow(featured, told), "features").toPandas().sort_values([*NAMES, "toxic"])  # at most a row a sampled document
    scorer.weights = logistic(got[NAMES].to_numpy(float), (got["toxic"] == 1).to_numpy(float)) if len(got) else [-3.0, 3.0, 1.5, 0.3, 0.5]
    scorer.codes = {}
    for trie in scorer.tries:
        trie.restart()
    return scorer


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs (doc_id, text) as doc_id, score, predicted; empty and null texts score by the bias alone.

    Repeated rows are rows of their own and get the same score; columns other than the two are not read; whole texts are
    scored, about BATCH_CHARS characters at a time, a longer text alone; an empty table gives none. Written once.
    """
    share = docs.sparkSession.sparkContext.broadcast({"scorer": scorer})  # at most TERMS terms and KNOWN words

    def run(batches):
        s = share.value["scorer"]
        for batch in batches:
            x = [s.score(t) for _, texts in texts_of(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.float64()), pa.array([int(v >= 0.5) for v in x], pa.int32())], names=["doc_id", "score", "predicted"])

    return materialise(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int"), "scores")


def toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 5 is 0; such rows teach nothing), score, predicted.

    Null doc_ids are not held out. Without labels all rows score alike. Terms that tell equally much are ordered by name;
    other cases as scored and fit say.
    """
    scorer = fit(docs.where(~held_out(5, 0)), labels.where(~held_out(5, 0)), fit_docs)
    return scored(docs, scorer).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
