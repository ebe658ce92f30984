"""Canonical exact fingerprints, by DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, prefilter, residue


def canonical(text: Column) -> Column:
    """NFKC, full case folding (by way of upper case), NFKC again, runs of white space to one blank, ends trimmed.

    Spark has no normalising function of its own; reflect calls the ICU class that it ships, inside the JVM.
    """
    nfkc = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.trim(F.regexp_replace(nfkc(F.lower(F.upper(nfkc(F.coalesce(text, F.lit("")))))), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits: xxhash64 of the text, and of a salt and the text, as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0")))


def ordinals(texts: DataFrame) -> DataFrame:
    """(_oh, canon, _o) of the distinct texts (_h, canon) of hashes that clash: 0, 1, ... by bytes."""
    return texts.distinct().select(F.col("_h").alias("_oh"), "canon", (F.row_number().over(Window.partitionBy("_h").orderBy("canon")) - 1).alias("_o"))


def with_ordinal(h: Column, o: Column) -> Column:
    return F.concat(h, F.when(o > 0, F.concat(F.lit("-"), o.cast("string"))).otherwise(F.lit("")))


def bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n-1 doc_ids that cut docs into ranges of about equal counts."""
    if n < 2:
        return []
    cut = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    return sorted(set(cut or []))


def ranged(cut: list[int]) -> Column:
    """The number of the range that doc_id is in: nulls in the first. Two levels, so that many bounds stay cheap."""
    if not cut:
        return F.lit(0).cast("long")
    step = max(1, math.isqrt(len(cut)))
    coarse = F.array(*[F.lit(x).cast("long") for x in cut[::step]])
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in cut[i : i + step]]) for i in range(0, len(cut), step)])
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col("doc_id"))).cast("long")
    k = below(coarse)
    inner = below(F.element_at(fine, k.cast("int")))
    return F.when(F.col("doc_id").isNull() | (k == 0), F.lit(0).cast("long")).otherwise((k - 1) * step + inner)


def with_next(docs: DataFrame, cut: list[int], carry: list[str]) -> DataFrame:
    """docs (doc_id, text, *carry) with next_<c> of the next row by doc_id (nulls first, ties by text), after the last of
    the first. One shuffle of the texts; a range's last row gets the first row of the next range that has rows, from a
    table of one row a range."""
    rows = docs.withColumn("_r", ranged(cut))
    names = ["doc_id", "text", *carry]
    inside = Window.partitionBy("_r").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select("_r", *names, *[F.lead(c).over(inside).alias(f"_n_{c}") for c in names], F.lead(F.lit(1)).over(inside).isNull().alias("_end"))
    least = docs.select("doc_id", ranged(cut).alias("_r")).groupBy("_r").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m"))
    least = least.select(F.col("m.doc_id").alias("_first"))
    first = docs.join(F.broadcast(least), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")  # at most a row a range
    first = first.withColumn("_r", ranged(cut)).groupBy("_r").agg(F.min(F.struct("text", "doc_id", *carry)).alias("_f"))
    order = Window.orderBy("_r")
    first = first.select("_r", F.coalesce(F.lead("_f").over(order), F.first("_f").over(order)).alias("_f"))
    joined = rows.join(first, "_r")
    return joined.select(*names, *[F.when(F.col("_end"), F.col(f"_f.{c}")).otherwise(F.col(f"_n_{c}")).alias(f"next_{c}") for c in names])


def edited(docs: DataFrame, cut: list[int], hash_of=wide_hash) -> DataFrame:
    """docs (doc_id, text) with n_chars, canon, edited text and the hashes of the text, its edited form and the next text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", hash_of(canonical(F.col("text"))))
    rows = with_next(docs, cut, ["h"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    return rows.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("eh", hash_of(F.col("edited_canon")))


def compare(docs: DataFrame, hash_of=wide_hash) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1.0 equal, else 0.0).

    The edited text is the text whose last floor(n_chars/2) code points are replaced by as many first ones of the next
    row's text. Null text is empty; a table of one row is its own next; an empty table gives no rows; other columns are
    not read. An exact digest has no degrees: its likeness is 1 for equal fingerprints and 0 otherwise.

    Texts are shuffled once. The hashes that two or more texts share are then verified: only their documents, found
    through a semi-join filter of bounded size, are read again, and the texts of a hash are compared as bytes.
    """
    docs = docs.select("doc_id", "text")
    n = partitions(docs.sparkSession)
    cut = bounds(docs, 4 * n)
    rows = edited(docs, cut, hash_of)
    facts = materialise(rows.select("doc_id", "next_doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "h", "eh", F.col("next_h").alias("nh")), "fingerprints")
    roles = facts.select(F.col("h").alias("_h"), "doc_id", F.col("doc_id").alias("also")).union(facts.select("eh", "doc_id", "next_doc_id"))
    shared = roles.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h")
    members = roles.join(shared, "_h", "left_semi").select(F.explode(F.array(F.col("doc_id"), F.col("also"))).alias("doc_id"))
    members = materialise(members.select(residue("doc_id").alias("_res")).distinct(), "shared")  # at most RESIDUES rows
    again = docs.withColumn("_res", residue("doc_id")).join(F.broadcast(members), "_res", "left_semi").drop("_res")
    again = edited(again, cut, hash_of)
    own = F.struct(F.col("h").alias("_h"), canonical(F.col("text")).alias("canon"))
    changed = F.struct(F.col("eh").alias("_h"), F.col("edited_canon").alias("canon"))
    texts = again.select(F.explode(F.array(own, changed)).alias("x")).select("x.*")
    texts = texts.join(shared, "_h", "left_semi")
    clash = materialise(texts.groupBy("_h").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("_h"), "clashes")
    if clash.isEmpty():
        named = facts.withColumns({"fingerprint": F.col("h"), "edited_fingerprint": F.col("eh"), "_nf": F.col("nh")})
    else:  # different texts of one hash: all that have it are numbered, and every row looks its own text up
        known = materialise(ordinals(texts.join(clash, "_h", "left_semi")), "numbered")
        full = edited(docs, cut, hash_of).select("*", canonical(F.col("text")).alias("canon"), canonical(F.col("next_text")).alias("next_canon"))
        for h, c, o in (("h", "canon", "_o1"), ("eh", "edited_canon", "_o2"), ("next_h", "next_canon", "_o3")):
            k = known.select(F.col("_oh").alias(f"_k{o}"), F.col("canon").alias(f"_c{o}"), F.col("_o").alias(o))
            full = full.join(k, (F.col(h) == F.col(f"_k{o}")) & (F.col(c) == F.col(f"_c{o}")), "left")
        roles = {"fingerprint": ("h", "_o1"), "edited_fingerprint": ("eh", "_o2"), "_nf": ("next_h", "_o3")}
        names = [with_ordinal(F.col(h), F.col(o)).alias(name) for name, (h, o) in roles.items()]
        named = full.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *names)
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    near = [same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "_nf").alias("near_next")]
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
