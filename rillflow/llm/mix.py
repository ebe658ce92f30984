"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Documents of a source that one ordered run holds, about, and runs of a stretch.
RUN = 1_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, repeat: float) -> dict:
    """source -> target: weights repeat over the sources by code point (null last); what passes repeat times a source's
    size is reshared by weight among the rest, until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    left, open_weight, out = share * sum(n for _, n in sizes), sum(weight.values()), {}
    for s, n in sorted(order, key=lambda x: (repeat * x[1] / weight[x[0]], x[0] is None, x[0] or "")):
        if repeat * n <= left / open_weight * weight[s]:
            out[s], left, open_weight = repeat * n, left - repeat * n, open_weight - weight[s]
        else:
            break
    return {s: float(out[s]) if s in out else left / open_weight * weight[s] for s, _ in sizes}


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words (0 for null)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def plan(rows: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, repeat=2.0, seed="mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """rows (doc_id, source, size, *carry) with source_size, target and taken, the words of the row that the mix takes.

    Within a source, rows are ordered by the md5 of seed and doc_id; taken is whole epochs of the row plus its part of
    the last, cut where the source's budget (its target, rounded) ends. Equal keys are ordered by doc_id, size and carry. Null
    source is a source of its own; a source without words takes none. A source's order is cut into runs by ranges of the
    uniform hash, so a hot source spreads over many tasks: runs are summed, the sums are added up in two levels (a task sees
    RUN runs, or a row for each RUN runs), and each run is ordered by itself. Sources' totals (one row a source) go to the
    driver. Reruns agree.
    """
    spark = rows.sparkSession
    keyed = rows.select("doc_id", "source", "size", *carry, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key"))
    keyed = materialise(keyed, "mix")
    totals = [tuple(r) for r in keyed.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    goal = targets([(s, n) for s, n, _ in totals], tuple(weights), share, repeat)
    known = spark.createDataFrame([(s, n, goal[s], max(1, -(-m // RUN))) for s, n, m in totals], "_source string, source_size long, target double, _runs long")
    run = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_runs") / F.lit(1 << 32))
    rows = keyed.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_run", run)
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s")
    # sums of runs, added up within stretches of RUN runs; sums of stretches, added up over one row a stretch
    runs = rows.groupBy(source, F.floor(F.col("_run") / RUN).alias("_far"), "_run").agg(F.sum("size").alias("_n"))
    far = runs.groupBy("_s", "_far").agg(F.sum("_n").alias("_m"))
    far = far.select("_s", "_far", (F.sum("_m").over(Window.partitionBy("_s").orderBy("_far")) - F.col("_m")).alias("_base"))
    near = F.sum("_n").over(Window.partitionBy("_s", "_far").orderBy("_run")) - F.col("_n")
    runs = runs.select("_s", "_far", "_run", near.alias("_in")).join(far, ["_s", "_far"]).select("_s", "_run", (F.col("_base") + F.col("_in")).alias("_before"))
    rows = rows.withColumn("_s", source).join(runs, ["_s", "_run"])
    inside = Window.partitionBy("_s", "_run").orderBy("_key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_before") + F.sum("size").over(inside) - F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "source", "size", *carry, "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of a document, the last cut to its first words
    where a budget ends inside it. Documents without words (null and empty texts too) have nothing to take. Rows that are
    equal in doc_id, source and text share what is taken of them. Columns other than text and n_chars pass through,
    whatever their names; n_chars follows the text. An empty table gives none. Texts are shuffled once.
    """
    names = docs.columns
    hashed = F.xxhash64("text").alias("_t")
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_d")
    packed = sized(docs.select(rest, "doc_id", "source", "text", hashed))
    share = plan(sized(docs.select("doc_id", "source", "text", hashed)).select("doc_id", "source", "size", "_t"), carry=("_t",), **how)
    same = ["doc_id", "source", "size", "_t"]
    number = lambda order: F.row_number().over(Window.partitionBy("_id", *same).orderBy(order))
    own = F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "size", "_t")
    # both sides are dealt by _id alone, so that the numbering and the join need no other shuffle
    packed = packed.withColumn("_id", own).repartition("_id").withColumn("_nth", number(F.lit(1)))
    share = share.withColumn("_id", own).repartition("_id").withColumn("_nth", number(F.desc("taken"))).where("taken > 0")
    met = F.col("d._id") == F.col("s._id")
    for k in ("doc_id", "source"):
        met = met & F.col(f"d.{k}").isNotNull().eqNullSafe(F.col(f"s.{k}").isNotNull()) & ((F.col(f"d.{k}") == F.col(f"s.{k}")) | F.col(f"d.{k}").isNull())
    met = met & (F.col("d._nth") - F.col("s._nth") == 0)
    rows = packed.alias("d").join(share.select("_id", "doc_id", "source", "_nth", "taken").alias("s"), met)
    rows = rows.select("d._d", "d.text", "d.size", F.col("s.taken").alias("_taken"))
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("_taken") - 1) / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("_taken") - F.col("_epoch") * F.col("size"))
    first = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("text", F.when(words == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(first, F.lit(1), words.cast("int")), "")))
    extra = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return rows.select(*[extra.get(c, F.col(f"_d.`{c}`")).alias(c) for c in names])


#: The same in DuckDB's SQL, with the same defaults.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS cap_before,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM s WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, cap <= (budget - cap_before) / w_left * w AS full_up FROM r),
l AS (SELECT (any_value(budget) - coalesce(sum(cap) FILTER (full_up), 0)) / nullif(sum(w) FILTER (NOT full_up), 0) AS per FROM o),
t AS (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE per * w END AS target FROM o, l),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS b,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN b // source_size ELSE 0 END AS ep FROM p)
SELECT doc_id, size, source_size, target,
       CAST(ep * size + greatest(0, least(size, b - ep * source_size - before)) AS BIGINT) AS taken
FROM e
"""
