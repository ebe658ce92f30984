"""Every stage of the pipeline on its predecessor's rows, against SQL or the tokenizer's own library.

The language stage is held against a plain scorer in test_plain; here its rows must be unchanged, have letters, and lack
only very short texts.
"""

import hashlib
import re
from collections import Counter

import duckdb
import sentencepiece

from rillflow.llm import loglines, mix, neardup
from rillflow.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_sql(rows, sql):
    duck = duckdb.connect()
    duck.register("documents", rows)
    return duck.execute(sql).df()


def test_stages_agree_with_plain_versions(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    docs = docs.union(spark.createDataFrame([(-1, None, "en", "web", 0), (-2, "", "en", "web", 0), (-3, "2024 !!", "en", "web", 7)], docs.schema))
    before, seen = docs.toPandas(), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.toPandas()
        was = dict(zip(before.doc_id, before.text, strict=True))
        assert name == "tokens" or list(after.columns) == names
        if name == "language":
            kept, letters = dict(zip(after.doc_id, after.text, strict=True)), {i: t for i, t in was.items() if t and any(c.isalpha() for c in t)}
            assert kept.items() <= letters.items()
            assert all(len(WORD.findall(letters[i])) < 5 for i in letters.keys() - kept.keys())  # too little to be sure of
        elif name == "lines":
            want = in_sql(before, loglines.ORACLE.replace("THEN 2 ELSE 5", "THEN 5 ELSE 5"))
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(after.doc_id, after.text, strict=True)} == dict(zip(want.doc_id, want.kept_sha256, strict=True))
        elif name == "near_copies":
            want = in_sql(before, neardup.ORACLE)
            assert Counter(after.doc_id) == Counter(i for i, c in zip(want.doc_id, want.class_id, strict=True) if i == c)
            assert all(was[i] == t for i, t in zip(after.doc_id, after.text, strict=True))
        elif name == "mixture":
            want, words = in_sql(before, mix.ORACLE), Counter()
            for i, t in zip(after.doc_id, after.text, strict=True):
                assert was[i].startswith(t)
                words[i] += len(WORD.findall(t))
            assert words == Counter({i: n for i, n in zip(want.doc_id, want.taken, strict=True) if n or i in words})
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
            want = Counter()
            for i, t in zip(before.doc_id, before.text, strict=True):
                ids = [*sp.encode(t), sp.eos_id()]
                want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), tuple(ids)] += 1
            assert Counter((*r[:-1], tuple(r[-1])) for r in after.itertuples(index=False, name=None)) == want
        before = after
        seen.append(len(after))
    assert len(seen) == 5 and min(seen) > 0
