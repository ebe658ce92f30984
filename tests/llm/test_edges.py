"""Every operator on odd tables and on empty ones, against plain versions."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillflow.llm import fingerprint, langid, loglines, mix, neardup, pieces, rules, suffixdedup, tokenfile, toxic
from rillflow.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


def texts(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_tokenfile(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want, start = [], 0
    for i, t in texts(odd):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = tokenfile.read(tokenfile.write(odd, tokenizer("byte_bpe_50k.json"), 2)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfile.read(tokenfile.write(none, tokenizer("byte_bpe_50k.json"), 2)).collect() == []


def test_tokenfile_query_gives_the_library_s_own_ids(odd, tmp_path):
    from tokenizers import Tokenizer

    from rillflow.llm.queries import op1_tokenfile

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for _, t in texts(odd)]
    assert any(50256 in ids for ids in want)
    got = sorted(op1_tokenfile(odd.sparkSession, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) for ids in want]


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenfile_compares_parts_of_one_hash_by_bytes():
    word = "a"
    while len(word) < 4096:  # the Thue-Morse word and its complement have one polynomial hash, whatever the base
        word += word.translate(str.maketrans("ab", "ba"))
    encoder, texts = tokenfile.Encoder(tokenizer("byte_bpe_50k.json"), True), []
    for n in (1024, 2048, 4096):
        one, other = word[:n], word[:n].translate(str.maketrans("ab", "ba"))
        texts += [one, other, f"{other} {one} x {other}", one]
    for given in (texts, texts[::-1], texts):
        ids, lens = encoder(given)
        want = library_ids(given)
        assert ids.tolist() == [i for x in want for i in x] and lens.tolist() == [len(x) for x in want]
    assert encoder.known.odd


def test_tokenfile_of_a_text_of_millions_of_parts(monkeypatch):
    import time

    import numpy as np

    encoder = tokenfile.Encoder(tokenizer("byte_bpe_50k.json"), True)
    monkeypatch.setattr(encoder, "library", lambda parts: (np.fromiter(map(len, parts), np.int64, len(parts)), np.ones(len(parts), np.int64)))
    began = time.time()
    ids, lens = encoder([" ".join(map(str, range(5_000_000)))])
    assert lens.tolist() == [5_000_000] and ids.sum() == sum(len(str(i)) + 1 for i in range(5_000_000)) - 1
    assert time.time() - began < 60 and len(encoder.known) <= tokenfile.REMEMBER + tokenfile.STRETCH


def test_tokenfile_packs_ids_of_any_width():
    import numpy as np

    draw = np.random.default_rng(4)
    for wide in (0, 1, 50):
        ids = np.concatenate([draw.integers(0, 1 << b, 700, dtype=np.uint64) for b in (1, 8, 17, 33, 59)])
        ids[draw.choice(len(ids), wide, replace=False)] = draw.integers(1 << 60, (1 << 64) - 1, wide, dtype=np.uint64)
        offsets, words, escapes = tokenfile.pack(ids)
        assert len(escapes) == wide == (words >> np.uint64(60) == 0).sum() and len(offsets) == -(-len(ids) // tokenfile.BLOCK) + 1
        assert (tokenfile.unpack(offsets, words, escapes, len(ids)) == ids).all()
        b = len(offsets) // 2  # a block alone
        part = words[offsets[b - 1] : offsets[b]]
        assert (tokenfile.unpack(np.array([0, len(part)]), part, escapes, tokenfile.BLOCK) == ids[(b - 1) * tokenfile.BLOCK : b * tokenfile.BLOCK]).all()


def test_pieces(odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = []
    for i, t in texts(odd):
        ids = [*sp.encode(t), sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = pieces.encoded(odd, tokenizer("piece_bpe_32k.model"), ["doc_id"]).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert pieces.encoded(none, tokenizer("piece_bpe_32k.model"), ["doc_id"]).collect() == []


def test_pieces_of_long_words(monkeypatch):
    import random
    import time

    import sentencepiece

    path, draw = tokenizer("piece_bpe_32k.model"), random.Random(1)
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (999, 1001, 3000)] + ["ab" * 2000, "a" * 1500, "é漢字x" * 400, "y z"]
    for limit in (10, 1000, 10**9):
        monkeypatch.setattr(pieces, "LONG_WORD", limit)
        model.forget()
        ids, lens = model.encode(words)
        assert ids.tolist() == [i for w in words for i in sp.encode(w)] and lens.tolist() == [len(sp.encode(w)) for w in words]
    monkeypatch.undo()
    began, long = time.time(), "".join(draw.choices("abcdefghijklmnop", k=200_000))
    assert model.encode([long])[0].tolist() == sp.encode(long) and time.time() - began < 20


def test_pieces_refuse_their_own_names(odd):
    with pytest.raises(ValueError):
        pieces.encoded(odd.withColumn("ids", F.lit(1)), tokenizer("piece_bpe_32k.model"), ["doc_id", "ids"])


def test_mix_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(mix, "RUN", 3)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "hot").otherwise("cold").alias("source"), (F.col("id") % 7).alias("size"))
    rows, sums = mix.plan(docs).collect(), Counter()
    for r in rows:
        sums[r["source"]] += r["taken"]
    assert all(sums[r["source"]] == round(r["target"]) for r in rows)
    monkeypatch.undo()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.plan(docs).collect()))


def test_mix(odd, none):
    sized = mix.sized(odd)
    got = mix.plan(sized.select("doc_id", "source", "size")).collect()
    sizes = Counter()
    for r in odd.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts(odd))
    assert abs(sum(mix.targets(list(sizes.items()), (5.0, 2.0, 1.0), 1.5, 2.0).values()) - 1.5 * sum(sizes.values())) < 1e-6
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= 0.5 + 1e-9
    assert mix.plan(mix.sized(none).select("doc_id", "source", "size")).collect() == []
    full = odd.withColumns({c: F.lit(99) for c in ("size", "_nth", "_taken", "_epoch", "taken", "_d")})
    copies = mix.mixed(full).collect()
    assert sum(len(WORD.findall(r["text"])) for r in copies) == sum(taken.values())
    assert {(r["size"], r["_nth"], r["_taken"], r["_epoch"], r["taken"], r["_d"]) for r in copies} == {(99,) * 6} and all(r["n_chars"] == len(r["text"]) for r in copies)
    assert mix.mixed(none).collect() == []


def canonical(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(t).upper().lower())).strip()


@pytest.mark.parametrize("weak", [False, True])
def test_fingerprint(odd, none, weak):
    hash_of = (lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("string")) if weak else fingerprint.wide_hash
    rows = texts(odd)
    got = fingerprint.compare(odd, hash_of).collect()
    want = Counter()
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(n))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == want
    names = {}
    for i, t in rows:
        names.setdefault(canonical(t), set()).update(r["fingerprint"] for r in got if r["doc_id"] == i and r["n_chars"] == len(t))
    assert len({min(v) for v in names.values()}) >= len(names) - 2  # rows without an id of one length cannot be told apart here
    assert fingerprint.compare(none, hash_of).collect() == []


def test_langid(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[3] == by[4] == by[5] == "und"
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert langid.identify(none).collect() == []
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def removed(rows):
    """Plain version of the removal of repeated strings."""
    first = {}
    low = -(1 << 63)
    coded = [(low if i is None else i, t.encode()) for i, t in rows]
    for i, b in coded:
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, b in coded:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((None if i == low else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffixdedup(odd, none):
    got = suffixdedup.dedup(odd.drop("_k")).collect()
    assert Counter(map(tuple, got)) == Counter(removed(texts(odd)))
    assert suffixdedup.dedup(none).collect() == []


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_suffixdedup_of_hot_anchors(spark, monkeypatch, hot):
    import random

    monkeypatch.setattr(suffixdedup, "HOT", hot)
    draw = random.Random(hot)
    line = " ".join(spelled(i) for i in range(12))
    text = lambda i: " ".join([spelled(i, 3), spelled(i, 4)] * draw.randint(0, 4) + [line] * draw.randint(0, 2) + [spelled(i % 7, 5)] * 8)
    docs = [(i if draw.random() < 0.9 else None, text(i)) for i in range(120)]
    got = suffixdedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(removed(docs))


def test_family_of_suffix_arrays():
    import numpy as np

    draw = np.random.default_rng(3)
    family, least, total = suffixdedup.Family(), {}, 0
    for b in range(40):
        raw = draw.integers(0, 2, 400, dtype=np.uint8)  # zeros too: padding must not count
        lens = draw.integers(3, 9, 60)
        at, docs = draw.integers(0, 390, 60), draw.integers(0, 100, 60)
        strings = suffixdedup.cut_strings(raw, at, lens, 8)
        for a, n, d in zip(at, lens, docs, strict=True):
            s = raw[a : a + n].tobytes()
            least[s] = min(least.get(s, 1000), d)
        family.add(strings, docs, lens)
        sizes = [len(x) for x in family.levels]
        assert sum(sizes) == len(least) and all(x >= 2 * y for x, y in zip(sizes[:-1], sizes[1:], strict=True))
        assert all((x.strings[1:] > x.strings[:-1]).all() for x in family.levels)
    whole = family.whole()
    rows = whole.strings.view(np.uint8).reshape(-1, 9)
    assert {r[: r[8]].tobytes(): int(d) for r, d in zip(rows, whole.docs, strict=True)} == {k: int(v) for k, v in least.items()}
    assert (rows[:, 8] == whole.tags).all()


def stats_of(t):
    ws = WORD.findall(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    many, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rules(odd, none, labels):
    got = rules.judged(odd, labels).collect()
    want = Counter((i, *stats_of(t)) for i, t in texts(odd))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert rules.judged(none, labels.limit(0)).collect() == []


def test_rules_learn_and_prune():
    import numpy as np

    draw = np.random.default_rng(1)
    x, y = draw.random(3000), draw.random(3000)
    bad = (x > 0.8) | ((y < 0.1) & (x < 0.3))
    learned = rules.learn({"x": x, "y": y}, bad)
    said = np.zeros(3000, bool)
    for r in learned:
        said |= r.holds({"x": x, "y": y})
    assert (said == bad).mean() > 0.97


def test_loglines(odd, none):
    got = loglines.dedup(odd).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert {r["n_lines"] for r in got if r["text"] is None} == {0} and set(odd.columns) <= set(got[0].asDict())
    assert loglines.dedup(none).collect() == []


def spelled(i, k=0):
    return "".join("abcdefghij"[int(c)] for c in f"{i * 7919 + k:06d}")


def lines_kept(spark, docs, columns="doc_id long, text string"):
    return {r["doc_id"]: r["text"].split("\n") for r in loglines.dedup(spark.createDataFrame(docs, columns)).collect()}


def test_loglines_drops_templates_but_the_first(spark):
    own = lambda i: f"{spelled(i, 1)} {spelled(i, 2)} wrote {spelled(i, 3)} in {spelled(i, 4)} alone"
    rest = lambda i: f"Copyright 20{i:02d} by the same house\nUser {spelled(i)} logged in from home today\nAccept cookies\nLog in\n\n}}\n{i}"
    got = lines_kept(spark, [(i, f"{own(i)}\n{rest(i)}") for i in range(20)])
    assert got == {i: f"{own(i)}\n{rest(i) if not i else chr(10) + '}' + chr(10) + str(i)}".split("\n") for i in range(20)}


def test_loglines_generalises_leading_words(spark):
    forms = ["By {} on the second page of news", "Dear {} {} welcome back to our little shop", "{} has sent you a new private message", "Posted in {} by our own staff writer {}"]
    for form in forms:
        lines = [form.format(spelled(i, 1), spelled(i, 2)) for i in range(12)]
        got = lines_kept(spark, [(i, f"{spelled(i, 3)} {spelled(i, 4)}\n{x}") for i, x in enumerate(lines)])
        assert [i for i, x in enumerate(lines) if x in got[i]] == [0], form


def test_loglines_counts_documents_not_lines(spark):
    list_of = lambda d: "\n".join(f"Item {spelled(i, d)} costs five gold coins here" for i in range(9))
    docs = [(0, list_of(0)), (1, "another text"), (2, "Same words here\n" * 9)]
    assert lines_kept(spark, docs) == {i: t.split("\n") for i, t in docs}
    got = lines_kept(spark, [(i, list_of(i)) for i in range(5)])
    assert got == {0: [list_of(0).split("\n")[0]], **{i: [""] for i in range(1, 5)}}


def test_loglines_drops_long_lines_of_two_documents(spark):
    long, short = " ".join(spelled(i) for i in range(60)), " ".join(spelled(i, 1) for i in range(40))
    got = lines_kept(spark, [(i, f"{spelled(i, 2)} own\n{long}\n{short}") for i in range(2)])
    assert got == {0: [f"{spelled(0, 2)} own", long, short], 1: [f"{spelled(1, 2)} own", short]}


def test_loglines_of_many_lines_take_time_in_proportion(spark):
    import time

    docs = [(d, "\n".join(f"{spelled(i)} {spelled(i, 1)} recurs in all" for i in range(50_000))) for d in range(6)]
    began = time.time()
    got = loglines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == [(d, 50_000, 0 if not d else 50_000) for d in range(6)]
    assert time.time() - began < 100


def test_loglines_replaces_its_own_columns(spark):
    got = loglines.dedup(spark.createDataFrame([(1, "a line", 7)], "doc_id long, text string, n_lines int"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"] and got.collect()[0]["n_lines"] == 1


def test_loglines_finds_several_templates_of_a_leaf(spark):
    word = lambda i, k: "".join("abcdefghij"[int(c)] for c in f"{i * 7919 + k:06d}")
    templates = ["the article by {} {}", "more about {} today {}", "all news from {} {}", "the poem {} gave {}"]  # the first and last share a token
    lines = [f"Click here to read {x.format(word(i, 0), 'now')}" for x in templates for i in range(12)] + ["Click here to read one hot fixed line again"] * 40
    docs = [(i, f"{word(i, 1)} {word(i, 2)} {word(i, 3)} alone\n{x}") for i, x in enumerate(lines)]
    got = {r["doc_id"]: r["text"].split("\n") for r in loglines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sorted(i for i, t in got.items() if len(t) == 2) == [0, 12, 24, 36, 48]


def test_loglines_keeps_figures_that_differ(spark):
    rows = lambda i: f"{i} {i * i} {7 * i}\n| {i} | {i + 1} | {i + 2} |\nJan {i + 1} 2024 10:{i + 10}\n1 2 3 4 5 6 {i}"
    docs = [(i, f"{rows(i)}\n1 2 3\nPage {i} of 20\nCopyright 20{i:02d} by Houses") for i in range(8)]
    got = {r["doc_id"]: r["text"] for r in loglines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: rows(i) if i else t for i, t in docs}


def test_toxicity(odd, none, labels):
    got = toxic.toxicity(odd.drop("score"), labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxic.toxicity(none, labels.limit(0)).collect() == []


def test_toxicity_keeps_terms_that_copies_of_one_text_use(spark):
    names = [f"{a}{b}" for a in "anna bert carl dora emil fred".split() for b in "son berg ova".split()]
    toxics = [f"this {a} moron met {a} again near {names[i - 1]} town" for i, a in enumerate(names)]
    one = "that gizmo moron said " + " ".join(f"gizmo {x} gadget" for x in "red blue green white black pink".split())
    clean = [f"this {a} met {b} near the town again" for a in names for b in names]
    rows = [(t, 1) for t in [*toxics, *[one] * 200, *[f"{one} {a}" for a in names]]] + [(t, 0) for t in clean]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    assert set(toxic.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).terms) == {"moron"}


def edits(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] not in (b[j - 1], "*")))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_finds_the_nearest_term():
    import random

    draw, terms = random.Random(5), ["loser", "pathetic", "abab", "abba", "moron", "aab"]
    for limit in (1, 2):
        trie = toxic.Trie(terms, limit)
        for _ in range(2000):
            w = list(draw.choice(terms))
            for _ in range(draw.randint(0, 3)):
                k = draw.randrange(len(w) + 1)
                w[k : k + draw.randint(0, 1)] = draw.choice(["", "a", "b", "o", "xs", "*"])
            w = "".join(w)
            best = min((edits(w, t), t) for t in terms)
            assert trie.near(w) == (None if best[0] > limit else (best[1], best[0]))


def test_toxicity_reads_misspellings_and_quotes():
    scorer = toxic.Scorer({"moron": 1.5, "worthless": 1.5}, {"motor"}, [-3.0, 3.0, 1.5, 0.3, 0.5])
    assert scorer.score("you are a moron") > 0.5
    assert scorer.score("you are a m0r0nnnn and worthles") > 0.5
    assert scorer.score("you are a m*r*n") > 0.3 and scorer.hit("m*r*n") == scorer.hit("m*ron") == scorer.hit("morron")
    assert scorer.score("what a m.o.r.o.n") > 0.5
    assert scorer.score('she said the word "moron" is an insult') < 0.5
    assert scorer.score("a motor runs") < 0.1 and scorer.score(None) == scorer.score("") < 0.1


def joined(rows):
    sets = []
    for _, t in rows:
        ws = t.encode().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen]
        out.append((rows[i][0], min((x for x in ids if x is not None), default=None) if sets[i] else rows[i][0], len(links[i])))
    return out


def test_neardup(odd, none):
    got = neardup.join(odd).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(joined(texts(odd)))
    assert neardup.join(none).collect() == []
    kept = neardup.distinct(odd).collect()
    assert {1, 3, 4, 5, 7, 9, 11} <= {r["doc_id"] for r in kept} and 2 not in {r["doc_id"] for r in kept}
    assert set(kept[0].asDict()) == set(odd.columns) and neardup.distinct(none).collect() == []


@pytest.mark.parametrize(("block", "typical"), [(16, 4096), (64, 20)])
def test_neardup_of_a_large_group_in_blocks(spark, monkeypatch, block, typical):
    import random

    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "TYPICAL", typical)
    draw = random.Random(2)
    base = [f"word{i}" for i in range(120)]
    docs = []
    for i in range(60):
        ws = list(base)
        for _ in range(draw.randint(0, 3)):
            ws[draw.randrange(120)] = f"new{draw.random()}"
        docs.append((i, " ".join(ws)))
    docs += [(100 + i, " ".join(f"x{draw.random()}" for _ in range(80))) for i in range(10)]
    got = neardup.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(joined(docs))


def test_pipeline_stages_keep_columns(spark, odd, small):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and docs.count() > 0
    assert all(len(r["ids"]) == r["n_tokens"] for r in docs.collect())


def test_a_query_leaves_the_session_as_it_was(spark, odd):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in keys]
    pieces.encoded(odd, tokenizer("piece_bpe_32k.model"), ["doc_id"]).collect()
    langid.identify(odd).collect()
    assert [spark.conf.get(k) for k in keys] == before
