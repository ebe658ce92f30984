"""The learned operators against plain versions: the same definitions, a text and a word at a time."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from test_edges import edits, stats_of

from rillflow.llm import langid, rules, toxic
from rillflow.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def counted(rows):
    out = defaultdict(Counter)
    for lang, text in rows:
        if lang is not None and text is not None:
            out[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    return out


def plain_language(counts):
    """A scorer of texts from word counts by language: known words by frequency, others by their longest known n-grams."""
    langs = sorted(counts)
    total = {x: max(1, sum(counts[x].values())) for x in langs}
    grams = [defaultdict(lambda: dict.fromkeys(langs, 0.0)) for _ in range(6)]
    for x in langs:
        for word, n in counts[x].items():
            padded = f"^{word}$"
            for size in range(1, 6):
                for i in range(len(padded) - size + 1):
                    grams[size][padded[i : i + size]][x] += math.sqrt(n)
    mass = [{x: max(1, sum(g[x] for g in table.values())) for x in langs} for table in grams]

    def of_word(word):
        if any(word in counts[x] for x in langs):
            return [math.log((counts[x][word] + 0.1) / total[x]) for x in langs]
        padded, rows = f"^{word}$", []
        for i in range(len(padded)):
            found = next((size for size in range(5, 0, -1) if i + size <= len(padded) and padded[i : i + size] in grams[size]), 0)
            rows.append([math.log((grams[found][padded[i : i + found]][x] + 0.05) / mass[found][x]) + (5 - found) * math.log(0.4) for x in langs] if found else [-14.0] * len(langs))
        return [sum(c) / len(rows) for c in zip(*rows, strict=True)]

    def score(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return {}
        z = [0.0] * len(langs)
        for w in words:
            row = of_word(w)
            mean = sum(row) / len(row)
            z = [a + max(-4, min(4, b - mean)) for a, b in zip(z, row, strict=True)]
        z = [a / len(words) * min(len(words), 40) for a in z]
        p = [math.exp(a - max(z)) for a in z]
        return {x: a / sum(p) for x, a in zip(langs, p, strict=True)}

    return score


def agrees(got, want):
    lang, score = got
    if not want:
        return lang == "und" and score == 0
    return abs(want[lang] - max(want.values())) < 1e-3 and abs(score - want[lang]) < 1e-3


def test_languages(spark, small, documents):
    rows = documents.select("doc_id", "text", "lang").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    score = plain_language(counted((r["lang"], r["text"]) for r in rows if not held(r["doc_id"])))
    texts = {r["doc_id"]: r["text"] for r in rows}
    got = QUERIES["op4_langid"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and agrees((r["lang_pred"], r["score"]), score(texts[r["doc_id"]])), r


def test_the_language_stage_keeps_what_a_plain_scorer_keeps(spark, small, documents):
    import corpus_pipeline

    rows = documents.union(spark.createDataFrame([(-1, None, "en", "web", 0), (-2, "zz zzz", None, "web", 6), (-3, "2024 !!", "en", "web", 7), (-4, "la", None, "web", 2)], documents.schema))
    held = rows.collect()
    score = plain_language(counted((r["lang"], r["text"]) for r in held))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, rows, small).collect()}
    for r in held:
        best = max(score(r["text"]).values(), default=0)
        assert abs(best - 0.4) < 1e-3 or (r["doc_id"] in kept) == (best >= 0.4), r


def test_a_rare_language_is_in_the_sample(spark):
    rows = [(i, f"the common words number {i} of many", "en") for i in range(400)] + [(1000 + i, f"harvinainen kieli sanoo {i} jotain", "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, fit_docs=50).langs == ["en", "fi"]


def plain_tokens(text):
    return toxic.tokens(text)


def test_tokens():
    assert toxic.tokens('You f**k, "s.t.u.p.i.d" id!ot a.b so b*d') == ["you", "f**k", '"', "stupid", '"', "id*ot", "a", "b", "so", "b*d"]
    assert toxic.tokens(None) == toxic.tokens("") == [] and toxic.tokens("e.g. it is 5.5") == ["e", "g", "it", "is", "5", "5"]
    assert toxic.tokens("l-o-s-e-r l*o*s*e*r x y z") == ["loser", "loser", "x", "y", "z"]


def plain_hit(word, terms, known):
    if word in terms:
        return terms[word], True
    if word in known or len(word) < 4:
        return None
    for w in dict.fromkeys((word, toxic.squeezed(word))):
        for low, high, limit in ((4, toxic.LONG, 1), (toxic.LONG, 99, 2)):
            near = min(((edits(w, t), t) for t in terms if low <= len(t) < high), default=(9, ""))
            if near[0] <= limit:
                return terms[near[1]] * (0.8 if near[0] < 2 else 0.6), False
    return None


def test_toxicity(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows, toxics = documents.select("doc_id", "text").collect(), {r["doc_id"]: r["toxic"] for r in labels.collect()}
    learn = Counter((r["text"], toxics[r["doc_id"]]) for r in rows if not held(r["doc_id"]) and toxics.get(r["doc_id"]) is not None and r["text"] is not None)
    bad, good, clean, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    for (text, y), copies in learn.items():
        words = ["", *plain_tokens(text), ""]
        for w in {w for w in words if len(w) > 2}:
            if y == 1:
                i = words.index(w)
                bad[w] += 1
                contexts[w].add((words[i - 1], words[i + 1]))
            else:
                good[w] += 1
                clean[w] += copies
    nb, ng = (sum(y == k for _, y in learn) for k in (1, 0))
    lift = {w: (bad[w] + 0.5) / (nb + 1) / ((good[w] + 0.5) / (ng + 1)) for w in bad}
    terms = {w: min(1.5, math.log(lift[w]) / 4) for w in bad if len(contexts[w]) >= toxic.LEAST and bad[w] >= toxic.PURITY * (bad[w] + good[w]) and lift[w] > 20}
    known = {w for w in clean if clean[w] >= 2}
    scorer = toxic.fit(documents.where("crc32(cast(doc_id as string)) % 5 <> 0"), labels)
    assert scorer.terms.keys() == terms.keys() and all(abs(scorer.terms[t] - terms[t]) < 1e-9 for t in terms) and scorer.known == known

    def score(text):
        words, sums = plain_tokens(text), {"exact": 0.0, "fuzzy": 0.0, "quoted": 0.0}
        for i, w in enumerate(words):
            if hit := plain_hit(w, terms, known):
                left, right = words[max(0, i - 6) : i], words[i + 1 : i + 7]
                quoted = any(x in toxic.MARKS for x in left) and any(x in toxic.MARKS for x in right) or any(x in toxic.QUOTING for x in left)
                sums["quoted" if quoted else "exact" if hit[1] else "fuzzy"] += hit[0]
        n = max(1, sum(w not in toxic.MARKS for w in words))
        x = [1.0, *[min(sums[k], 6.0) for k in ("exact", "fuzzy", "quoted")], min(1.0, 50 * (sums["exact"] + sums["fuzzy"]) / n)]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, scorer.weights, strict=True))))

    texts = {r["doc_id"]: r["text"] for r in rows}
    got = QUERIES["op9_toxicity"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert abs(r["score"] - score(texts[r["doc_id"]])) < 1e-6 and r["held_out"] == held(r["doc_id"]), r


def test_verdicts_of_rules(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    learned = rules.fit(rules.statistics(documents, ["doc_id"]), labels)
    got = {r["doc_id"]: r for r in QUERIES["op7_rules"](spark, small).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n, chars, symbols, dup, repeat = stats_of(t)
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        raw = t.encode()
        share = {
            "mean_word": chars / max(n, 1),
            "symbols_per_word": symbols / max(n, 1),
            "dup_line_share": dup / max(lines, 1),
            "repeat_share": repeat / max(n, 1),
            "distinct_share": len(set(ws)) / max(n, 1),
            "caps_share": len(re.findall("[A-ZÀ-ÖØ-Þ]", t)) / max(chars, 1),
            "marks_per_word": (t.count("!") + t.count("?")) / max(n, 1),
            "digit_share": sum(raw.count(bytes([d])) for d in b"0123456789") / max(chars, 1),
            "words": float(n),
        }
        failed = n < 50 or 100 * repeat > 50 * n
        rejected = any(all(share[f] > t if op == ">" else share[f] <= t for f, op, t in rule.when) for rule in learned)
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed and not rejected), i
