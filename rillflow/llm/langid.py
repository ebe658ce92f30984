"""Language identification: known words first, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, materialise, passing, released, texts_of

#: The classifier is fitted on at most this many labelled documents, an even share of each language; more make it slower
#: to fit and know more words.
FIT_DOCS = 20_000
#: Words per language that the model keeps, the most frequent; others are scored by their n-grams.
WORDS = 20_000
#: Longest n-gram of the back-off.
LONGEST = 5
REMEMBER = 300_000
UNKNOWN = "und"
RUNS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return RUNS.findall(text.lower())


class Model:
    """Log probabilities of words and n-grams by language. A word seen in training scores by its smoothed frequency in
    each language; any other by its n-grams, each position by the longest known one that starts there, at a loss of
    log 0.4 for every step down."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: language -> word -> occurrences"""
        self.langs = sorted(counts)
        n = len(self.langs)
        self.rows, self.words, self.grams = np.zeros((1, 0)), {}, {}
        if not n:
            return
        totals = np.array([max(1, sum(counts[x].values())) for x in self.langs], float)
        seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(n)) for _ in range(LONGEST + 1)]
        for k, lang in enumerate(self.langs):
            for word, c in counts[lang].items():
                seen[word][k] += c
                padded = f"^{word}$"
                for size in range(1, LONGEST + 1):
                    for i in range(len(padded) - size + 1):
                        grams[size][padded[i : i + size]][k] += math.sqrt(c)
        rows = [np.full(n, -14.0)]  # row 0 is for a position without a known n-gram
        for w, c in seen.items():
            self.words[w] = len(rows)
            rows.append(np.log((c + 0.1) / totals))
        for size, table in enumerate(grams):
            total = np.maximum(np.sum(list(table.values()) or [np.zeros(n)], axis=0), 1)
            for g, c in table.items():
                self.grams[g] = len(rows)
                rows.append(np.log((c + 0.05) / total) + (LONGEST - size) * math.log(0.4))
        self.rows = np.array(rows, np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of scores, centred so that only differences between languages count."""
        flat, many = [], []
        grams = self.grams
        for word in words:
            known = self.words.get(word)
            if known is not None:
                flat.append(known)
                many.append(1)
                continue
            padded = f"^{word}$"
            many.append(len(padded))
            for i in range(len(padded)):
                for size in range(min(LONGEST, len(padded) - i), 0, -1):
                    found = grams.get(padded[i : i + size])
                    if found is not None:
                        flat.append(found)
                        break
                else:
                    flat.append(0)
        many = np.array(many, np.int64)
        out = np.add.reduceat(self.rows[flat].astype(float), np.cumsum(many) - many, axis=0) / many[:, None]
        return np.clip(out - out.mean(axis=1, keepdims=True), -4, 4).astype(np.float32)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self):
        self.codes, self.rows, self.letter = Codes(), np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, bool)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.codes) > REMEMBER:
            self.forget()
        found, many = [], []
        for text in texts:
            ws = words(text) if text else ()
            many.append(len(ws))
            found += ws
        code = self.codes.of(found)
        if (fresh := self.codes.taken()) and self.model.langs:
            self.rows = np.concatenate([self.rows, self.model.of(fresh)])
            self.letter = np.concatenate([self.letter, [any(map(str.isalpha, w)) for w in fresh]])
        ends = np.cumsum(many, dtype=np.int64)
        starts = ends - many
        names, scores = [], []
        sums = np.zeros((len(texts) + 1, len(self.model.langs)))
        some = np.nonzero(np.array(many))[0]
        letters = np.zeros(len(texts))
        if len(some) and self.model.langs:
            sums[some] = np.add.reduceat(self.rows[code], starts[some], axis=0, dtype=float)
            letters[some] = np.add.reduceat(self.letter[code].astype(int), starts[some])
        for i, n in enumerate(many):
            if not n or not letters[i] or not self.model.langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = sums[i] / n * min(n, 40)
            p = np.exp(z - z.max())
            best = int(np.argmax(z))
            names.append(self.model.langs[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def sampled(rows: DataFrame, fit_docs: int) -> DataFrame:
    """At most fit_docs of rows (lang, _k), those of the least hash, with a share for each language that does not depend
    on how often it occurs, so that a rare one is not missed. Languages' counts (a row each) go to the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    quota, left = {}, fit_docs
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quota[lang] = min(n, max(1, left // (len(counts) - i)))
        left = max(0, left - quota[lang])
    share = rows.sparkSession.createDataFrame([(k, quota[k] / n) for k, n in counts.items()], "lang string, _share double")
    drawn = rows.join(F.broadcast(share), "lang").where(F.pmod("_k", F.lit(1 << 31)) < F.col("_share") * (1 << 31))
    return drawn.select("_k", "lang").orderBy(F.pmod("_k", F.lit(1 << 31)), "_k").limit(fit_docs)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, words_kept: int = WORDS) -> Model:
    """A model of docs (text, lang), from at most about fit_docs rows; rows without lang or text teach nothing.

    Words are counted on the executors; the driver gets the most frequent of each language, words_kept at most: words of
    one count are all in or all out. Rows of one text and doc_id are drawn together.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", "doc_id").alias("_k"))
    keys = sampled(rows.select("lang", "_k"), fit_docs).select("_k").distinct()  # narrow: 8 bytes a row
    sample = rows.join(F.broadcast(keys), "_k", "left_semi")

    def count(batches):
        tally: Counter = Counter()
        for batch in batches:
            for at, texts in texts_of(batch, "text"):
                for lang, text in zip(batch.column("lang").slice(at, len(texts)).to_pylist(), texts, strict=True):
                    tally.update((lang, w) for w in words(text))
        items = list(tally.items())
        tally.clear()
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k, _ in items], "word": [k[1] for k, _ in items], "n": pa.array([n for _, n in items], pa.int64())})
        items = None
        released()

    tally = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    with passing(docs.sparkSession):
        return Model(told(materialise(tally, "words"), words_kept))


def told(tally: DataFrame, words_kept: int) -> dict[str, dict[str, int]]:
    """language -> word -> occurrences, of the words that a model keeps."""
    least: dict[str, int] = {}
    held: Counter = Counter()
    for lang, n, many in sorted(tally.groupBy("lang", "n").count().collect(), key=lambda x: (x[0], -x[1])):  # of the bounded sample
        held[lang] += many
        if held[lang] <= words_kept:
            least[lang] = n
    known = tally.sparkSession.createDataFrame(sorted(least.items()), "lang string, _least long")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, n in tally.join(F.broadcast(known), "lang").where("n >= _least").select("lang", "word", "n").collect():
        counts[lang][word] = n
    return {k: dict(sorted(v.items())) for k, v in sorted(counts.items())}


def predict(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """docs with lang_pred and score: (und, 0.0) for a null text and one without a letter, or if nothing was learned.

    Of equal scores the language that comes first by name wins. Repeated rows are rows of their own and get the same
    answer. The columns carry are passed as they are and none other but text is read, so only the names lang_pred, score and
    _text must not be among them. Whole texts are scored, about BATCH_CHARS characters at a time, a longer text alone. An empty
    table gives none. The result is written once, by small batches of texts.
    """
    from pyspark.sql import types as T

    share = docs.sparkSession.sparkContext.broadcast({"model": model})  # bounded by the words that a model keeps
    out = T.StructType([*docs.select(*carry).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = Scorer(share.value["model"])
        for batch in batches:
            names, scores = [], []
            for _, texts in texts_of(batch, read):
                a, b = scorer(texts)
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])
        scorer = None
        released()

    read = text if text in carry else "_text"
    rows = docs.select(*carry) if text in carry else docs.select(*carry, F.col(text).alias("_text"))
    return materialise(rows.mapInArrow(run, out), "languages")


def held_out(parts: int, which: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == which, F.lit(False))


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; held-out rows (crc32 of the id mod 4 is 2) teach nothing.

    Null doc_ids are not held out; null, empty and letterless texts are und; ties, repeated rows, long texts, other columns
    and empty tables as predict and fit say.
    """
    model = fit(docs.where(~held_out(4, 2)), fit_docs)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
