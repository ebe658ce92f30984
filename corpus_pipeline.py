"""A corpus pipeline of five stages: language, lines, near copies, mix, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import langid, loglines, mix, neardup, pieces
from rillflow.llm.common import materialise, table
from rillflow.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter go, and those that no language fits at least evenly."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with the prediction's
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    named = langid.predict(plain, langid.fit(docs), names, names[docs.columns.index("text")])
    named = named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.4))
    return named.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; no document goes. Long lines need as many documents
    as others here: documents that are copies as a whole are for the next stage."""
    names = docs.columns
    return loglines.dedup(docs, long_recurs=loglines.RECURS).select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return neardup.distinct(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents repeat by epochs, and the last epoch is cut where its source's budget ends."""
    return mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every row of the mix (ids, with the end id), their count and digests."""
    return pieces.encoded(docs, tokenizer("piece_bpe_32k.model"), ["doc_id"], ids=True)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs


#: Learned languages and tokenizers are past SQL; tests/llm holds the stages against SQL, the tokenizer's library and a plain
#: scorer of languages.
ORACLE_SQL = None
