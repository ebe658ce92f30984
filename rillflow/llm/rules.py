"""Quality rules: text statistics, and a decision list learned over them by sequential covering."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Codes, materialise, texts_of

#: The list is learned from at most this many labelled rows, those of the least hash of their id.
FIT_ROWS = 20_000
#: Most rules of a list, and most conditions of a rule.
RULES, CONDITIONS = 12, 4
SYMBOLS = re.compile(r"[#*$%&|<>]")
CAPS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
#: What rules may test: shares of a text, so that they mean the same at any length.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "caps_share": "n_caps / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words": "cast(n_words as double)",
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_caps", "n_marks", "n_digits"]


def repeats(code: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Per text: its words that lie in a 3-word window which the text has twice or more."""
    n, total = len(many), len(code)
    if total < 3:
        return np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), many)
    order = np.lexsort((code[2:], code[1:-1], code[:-2], doc[:-2]))
    same = lambda x: x[order[1:]] == x[order[:-1]]
    inside = doc[:-2] == doc[2:]
    eq = same(doc[:-2]) & same(code[:-2]) & same(code[1:-1]) & same(code[2:]) & inside[order[1:]] & inside[order[:-1]]
    hit = np.zeros(total, bool)
    for a in (order[1:][eq], order[:-1][eq]):
        for k in range(3):
            hit[a + k] = True
    return np.bincount(doc[hit], minlength=n)


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """docs (text, *carry) with the counts of STATS, over whole texts; a null text has none."""
    from pyspark.sql import types as T

    out = T.StructType([*docs.select(*carry).schema.fields, *[T.StructField(s, T.LongType()) for s in STATS]])

    def some(texts):
        codes, flat, many, rows = Codes(), [], [], []
        for text in texts:
            text = text or ""
            raw = text.encode()
            ws = raw.split()  # bytes split at the six ASCII white spaces alone
            many.append(len(ws))
            flat += ws
            lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
            symbols, caps, marks, digits = len(SYMBOLS.findall(text)), len(CAPS.findall(text)), text.count("!") + text.count("?"), sum(map(raw.count, DIGITS))
            rows.append((len(ws), chars, symbols, len(lines) - len(set(lines)), 0, len(lines), len(set(ws)), caps, marks, digits))
        code = codes.of(flat)
        many = np.array(many, np.int64)
        table = np.array(rows, np.int64).reshape(len(rows), len(STATS))
        table[:, STATS.index("n_repeat_words")] = repeats(code, many)
        return table

    def run(batches):
        for batch in batches:
            parts = [some(texts) for _, texts in texts_of(batch, "_text")]
            table = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *[pa.array(table[:, i]) for i in range(len(STATS))]], names=out.names)

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, out)


DIGITS = [bytes([d]) for d in b"0123456789"]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rule:
    """Reject if all conditions (feature, '>' or '<=', threshold) hold; support and precision on the learning rows."""

    when: list[tuple[str, str, float]]
    rejects: bool
    support: int
    precision: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        ok = np.ones(len(next(iter(data.values()))), bool)
        for f, op, t in self.when:
            ok &= data[f] > t if op == ">" else data[f] <= t
        return ok

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.when:
            c = F.expr(FEATURES[f])
            out = out & (c > F.lit(t) if op == ">" else c <= F.lit(t))
        return out


def learn(data: dict[str, np.ndarray], bad: np.ndarray, rules: int = RULES, least: int = 8, precision: float = 0.9) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows by information gain, prune it on the rest while
    that does not lower its worth, keep it if it is precise enough, take away what it covers, and begin again."""
    n = len(bad)
    out: list[Rule] = []
    if not n or not bad.any():
        return out
    open_rows, grow = np.ones(n, bool), np.arange(n) % 3 != 0
    gain_of = lambda p, q, p0, q0: p * (np.log2((p + 1e-9) / (p + q + 1e-9)) - np.log2((p0 + 1e-9) / (p0 + q0 + 1e-9)))
    worth = lambda rule, rows: (lambda h: ((h & bad[rows]).sum() - (h & ~bad[rows]).sum()) / max(1, h.sum()))(rule.holds({k: v[rows] for k, v in data.items()}))
    while len(out) < rules:
        rows = np.nonzero(open_rows & grow)[0]
        if bad[rows].sum() < least:
            break
        when: list[tuple[str, str, float]] = []
        while len(when) < CONDITIONS and len(rows) and not bad[rows].all():
            p0, q0 = bad[rows].sum(), (~bad[rows]).sum()
            best = (0.0, None)
            for f, v in data.items():
                order = np.argsort(v[rows], kind="stable")
                x, b = v[rows][order], bad[rows][order]
                edge = np.nonzero(x[1:] != x[:-1])[0]
                if not len(edge):
                    continue
                p, q = np.cumsum(b)[edge].astype(float), np.cumsum(~b)[edge].astype(float)
                mid = (x[edge] + x[edge + 1]) / 2
                for op, a, c in (("<=", p, q), (">", p0 - p, q0 - q)):
                    g = np.where(a >= least, gain_of(a, c, p0, q0), -1)
                    k = int(np.argmax(g))
                    if g[k] > best[0] + 1e-9:
                        best = (float(g[k]), (f, op, float(mid[k])))
            if best[1] is None:
                break
            when.append(best[1])
            rows = rows[Rule([best[1]], True, 0, 0).holds({k: v[rows] for k, v in data.items()})]
        if not when:
            break
        rest = np.nonzero(open_rows & ~grow)[0]
        while len(when) > 1 and worth(Rule(when[:-1], True, 0, 0), rest) >= worth(Rule(when, True, 0, 0), rest):
            when = when[:-1]
        rule = Rule(when, True, 0, 0)
        mine = rule.holds(data) & open_rows
        rule.support, rule.precision = int(mine.sum()), float(bad[mine].mean()) if mine.any() else 0.0
        if rule.support < least or rule.precision < precision:
            break
        out.append(rule)
        open_rows &= ~mine
    return out


def verdict(rules: list[Rule]) -> Column:
    """An ordered conditional: the first rule that holds decides; a row that none rejects is kept."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(not rule.rejects)) if out is None else out.when(rule.column(), F.lit(not rule.rejects))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from stats (doc_id, ...) and labels (doc_id, quality): a bounded sample of labelled rows goes to the driver.
    Rows that the base rules reject, and labels that are null, teach nothing."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    pick = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = stats.where(~base_failed()).join(F.broadcast(pick), "doc_id").select("doc_id", "quality", *[F.expr(e).alias(k) for k, e in FEATURES.items()])
    sample = sample.distinct().orderBy(F.xxhash64("doc_id"), *FEATURES, "quality").toPandas()  # equal rows teach once
    return learn({k: sample[k].to_numpy(float) for k in FEATURES}, (sample["quality"] == 0).to_numpy())


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts of STATS, base_failed and kept.

    kept is false for rows that fail the base rules, else the learned list's verdict; without usable labels the list is
    empty and keeps all. Null text has no words. Rows are computed once and written, since learning and judging both need
    them. Extra columns are not read; a label whose doc_id is null is ignored.
    """
    stats = materialise(statistics(docs, ["doc_id"]), "statistics")
    rules = fit(stats, labels)
    return stats.select("doc_id", *STATS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
