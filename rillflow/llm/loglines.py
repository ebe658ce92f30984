"""Line dedup by a log-template tree, by DataFrame functions alone."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, passing, prefilter, residue

#: Levels of the tree below the token count: blocks of a line's tokens, the leading ones first.
BLOCKS = 4
#: Lines of so many tokens may differ in two positions or more, and so in two blocks.
WIDE = 7
#: A template recurs if this many documents have it; one of LONG tokens or more if LONG_RECURS have it.
RECURS, LONG, LONG_RECURS = 5, 50, 2
#: Share of positions that must be constant for a template to stand for its lines.
CONSTANT = 0.7
#: Lines of fewer tokens need a letter to be templates: what is left is figures and layout.
LEAST_TOKENS = 3
#: What makes a token variable by its look (fixed pattern): a digit, an address, a URL.
VARIABLE = r"\S*(?:[0-9@]|://)\S*"
LOOKS = "[0-9@]|://"
#: A variable token once masked, and a token with a letter in a masked line: what makes a line figures, or text.
MASK, LETTERED = r"<\*>", r"[^ ]*\p{L}[^ ]*"
BLANKS = r"[\x20\x09-\x0D]+"
#: White space that makes a line need squeezing before it is cut at single blanks.
ODD_BLANKS = ("  ", "\t", "\r", "\x0b", "\x0c")


def masked(lines: DataFrame) -> DataFrame:
    """lines (line, ...) with m in place of line: variable tokens as <*>, white space as single blanks. A line of more
    variable tokens than words is figures, a table's row or a date: it stays as it is, so that it equals its own copies
    alone; figures tells so."""
    odd = F.lit(False)
    for b in ODD_BLANKS:
        odd = odd | F.col("line").contains(b)
    plain = lines.withColumn("_p", F.trim(F.when(odd, F.regexp_replace("line", BLANKS, " ")).otherwise(F.col("line")))).drop("line")
    hidden = plain.withColumn("_h", F.when(F.col("_p").rlike(LOOKS), F.regexp_replace("_p", VARIABLE, "<*>")))
    figures = F.regexp_count("_h", F.lit(MASK)) > F.regexp_count("_h", F.lit(LETTERED))
    told = hidden.withColumn("figures", F.coalesce(figures, F.lit(False)))
    return told.withColumn("m", F.when(F.col("figures"), F.col("_p")).otherwise(F.coalesce("_h", "_p"))).drop("_p", "_h")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _k, a hash of doc_id and text: with doc_id it names a row, up to rows that are equal in both."""
    return docs.withColumn("_k", F.xxhash64("doc_id", "text"))


def whole() -> list[Column]:
    """Two hashes of a masked line, full and also: its kind."""
    return [F.xxhash64("m").alias("full"), F.xxhash64(F.lit("second"), "m").alias("also")]


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line of keyed docs: doc_id, _k, nth, usable (whether it may be a template), full, also, n (its
    tokens), and b0, ..., hashes of the blocks of its tokens, null where no position may vary.

    There is no filter in it: the planner would move it below the projections and mask every line several times.
    """
    rows = masked(docs.select("doc_id", "_k", F.posexplode(F.split("text", "\n")).alias("nth", "line"))).withColumn("t", F.split("m", " "))
    n = F.size("t")
    usable = (F.length("m") > 0) & ((n >= LEAST_TOKENS) | F.col("m").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "_k", "nth", usable.alias("usable"), *whole(), n.alias("n"), "t", (~F.col("figures") & (variables(n) > 0)).alias("_tree"))
    cut = [F.floor(F.col("n") * q / BLOCKS).cast("int") for q in range(BLOCKS + 1)]
    blocks = [F.when(F.col("_tree"), F.xxhash64(F.slice("t", cut[q] + 1, cut[q + 1] - cut[q]))).alias(f"b{q}") for q in range(BLOCKS)]
    return rows.select("doc_id", "_k", "nth", "usable", "full", "also", "n", *blocks)


def variables(n: Column) -> Column:
    """How many of n positions may vary."""
    return F.floor((1 - CONSTANT) * n + 1e-9)


def leaves_of(n: str = "n") -> Column:
    """The leaves that a kind (n, b0, ...) reaches: at each level it goes into the child of its block and into the wildcard
    child; one wildcard on a path where one position may vary, two where more may."""
    paths = {}
    for wild in (1, 2):
        kept = [[i for i in range(BLOCKS) if i not in w] for w in combinations(range(BLOCKS), wild)]
        paths[wild] = F.array(*[F.xxhash64(F.lit(sum(1 << i for i in k)), n, *[f"b{i}" for i in k]) for k in kept])
    return F.explode(F.when(F.col(n) < WIDE, paths[1]).otherwise(paths[2]))


def recurring(docs: DataFrame, long_recurs: int = LONG_RECURS) -> tuple[DataFrame, DataFrame]:
    """((full, also, template) of every kind of line that a template covers which may recur, the lines of docs as hashes).

    docs is keyed. Lines are first reduced to hashes and counted by kind (equal masked lines), so a line that a third of
    all documents have is one row. A kind of several lines is a template of its own.

    The tree: token count, then BLOCKS levels of tokens, the leading ones first, each a child of its own or the wildcard
    child; a leaf has half of the tokens or more in common. Leaves of fewer than RECURS lines, or of a single kind, go; so
    only kinds that resemble others are looked at by token. There a token is constant in a position if RECURS lines of the
    leaf have it there, other positions are variable, and kinds of the same constants are one template, of which a leaf may
    have many, if CONSTANT of the positions are constant. A kind in several templates goes to the one of most lines.
    """
    narrow = materialise(lines_of(docs), "lines").where("usable")
    parts = [f"b{i}" for i in range(BLOCKS)]
    kinds = narrow.groupBy("full", "also").agg(F.count("*").alias("many"), F.min("_k").alias("_k"), *[F.first(c).alias(c) for c in ("n", *parts)])
    kinds = materialise(kinds, "kinds")
    least = F.when(F.col("n") >= LONG, long_recurs).otherwise(RECURS)
    own = kinds.where(F.col("many") >= least).select("full", "also", "n")
    tree = kinds.where("b0 is not null").select("full", "also", "_k", "many", "n", leaves_of().alias("leaf"))
    live = F.sum("many") >= RECURS
    ripe = tree.groupBy("leaf").agg(F.count("*").alias("_kinds"), live.alias("_live"), F.bit_xor("full").alias("_who"), F.bit_xor("also").alias("_too")).where("_live and _kinds > 1")
    ripe = ripe.groupBy("_who", "_too", "_kinds").agg(F.min("leaf").alias("leaf")).select("leaf")  # leaves of the same kinds are one
    leaves = materialise(tree.join(ripe.hint("shuffle_hash"), "leaf", "left_semi"), "leaves")
    tokens = tokens_of(docs, leaves.select("full", "also", "_k").distinct())
    cells = leaves.select("leaf", "full", "also", "many", "n").join(tokens, ["full", "also"])
    cells = materialise(cells.select("leaf", "full", "also", "line", "many", "n", F.posexplode("t").alias("pos", "t")), "cells")
    const = cells.groupBy("leaf", "pos", "t").agg(live.alias("_live")).where("_live").select("leaf", "pos", "t")
    same = F.bit_xor(F.xxhash64("pos", "t")).alias("sig")
    found = cells.join(const, ["leaf", "pos", "t"]).groupBy("leaf", "full", "also").agg(F.count("*").alias("c"), same, *[F.first(x).alias(x) for x in ("n", "many", "line")])
    found = found.where(F.col("n") - F.col("c") <= variables(F.col("n")))
    found = materialise(found.select("full", "also", "n", "line", "many", F.xxhash64("n", "sig").alias("template")).distinct(), "found")
    reach = found.groupBy("template").agg(F.sum("many").alias("reach"), F.count("*").alias("_kinds"), F.bit_xor("line").alias("who"))
    reach = reach.where((F.col("reach") >= RECURS) & (F.col("_kinds") > 1))
    best = found.join(reach, "template").groupBy("full", "also", "n").agg(F.max(F.struct("reach", "who", "template"))["template"].alias("template"))
    both = own.join(best, ["full", "also", "n"], "full")
    return both.select("full", "also", "n", F.coalesce("template", F.xxhash64(F.lit("own"), "full")).alias("template")), narrow


def tokens_of(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(full, also, line, t) of kinds (full, also, _k), from the document _k: 60 bits of the line's md5, its tokens' hashes."""
    texts = prefilter(docs.select("_k", "text"), kinds, "_k")
    lines = masked(texts.select("_k", F.explode(F.split("text", "\n")).alias("line"))).select("_k", "m", *whole())
    lines = lines.join(kinds, ["full", "also", "_k"], "left_semi")
    md5 = F.conv(F.substring(F.md5("m"), 1, 15), 16, 10).cast("long")
    return lines.groupBy("full", "also").agg(F.first("m").alias("m")).select("full", "also", md5.alias("line"), F.transform(F.split("m", " "), lambda x: F.xxhash64(x)).alias("t"))


def dropped(docs: DataFrame, long_recurs: int = LONG_RECURS) -> DataFrame:
    """(_k, doc_id, drop) of keyed docs that lose lines: drop has their numbers, ascending.

    A template that too few documents have after all (a line may repeat within one) is none. The first line of the others,
    by (doc_id, row, line), stays.
    """
    templates, narrow = recurring(docs, long_recurs)
    lines = narrow.select("doc_id", "_k", "nth", "full", "also").join(templates, ["full", "also"])
    lines = materialise(lines.select("template", "n", "doc_id", "_k", "nth"), "covered")
    each = lines.groupBy("template", "n", "doc_id", "_k").agg(F.min("nth").alias("nth"))
    good = each.groupBy("template", "n").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "_k", "nth")).alias("first"))
    good = good.where(F.col("docs") >= F.when(F.col("n") >= LONG, long_recurs).otherwise(RECURS)).select("template", "n", "first")
    good = materialise(good, "templates")  # so that the planner may split the lines of a hot template in the join
    gone = lines.join(good, ["template", "n"]).where(~F.struct("doc_id", "_k", "nth").eqNullSafe(F.col("first")))
    return gone.groupBy("_k", F.col("doc_id").alias("_i")).agg(F.sort_array(F.collect_set("nth")).alias("_drop"))


def dedup(docs: DataFrame, long_recurs: int = LONG_RECURS) -> DataFrame:
    """docs with text without the lines of recurring templates, and n_lines, n_dropped (long).

    A template that RECURS documents or more have (one of LONG tokens or more, long_recurs) is kept at its first
    line by doc_id (nulls first) and dropped elsewhere. Null text stays null with no lines; an empty text has one; empty
    lines, and lines of under LEAST_TOKENS tokens without a letter, always stay; rows of equal doc_id and text are treated
    alike; other columns pass through, n_chars follows the text; columns named n_lines or n_dropped are replaced. An empty
    table gives no rows. Only texts that may lose a line are shuffled, and the work is in proportion to lines and tokens.
    """
    names = docs.columns
    flat = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_d"), "doc_id", "text"))
    with passing(docs.sparkSession) as keep:
        drop = keep(dropped(flat.select("doc_id", "text", "_k"), long_recurs), "drop")
    # a flag for each line up to the last that goes, put together from the gaps between them
    gap = lambda x, i: F.concat(F.array_repeat(F.lit(False), (x - F.coalesce(F.get(F.col("_drop"), i - 1), F.lit(-1)) - 1).cast("int")), F.array(F.lit(True)))
    flags = drop.select("_k", "_i", F.size("_drop").alias("_n"), F.flatten(F.transform("_drop", gap)).alias("_flags"))
    small = F.broadcast(materialise(drop.select(residue("_k").alias("_res")).distinct(), "residues"))  # at most RESIDUES rows
    flat = flat.select("_d", "doc_id", "text", "_k", residue("_k").alias("_res"))
    same = (F.col("f._k") == F.col("x._k")) & F.col("doc_id").eqNullSafe(F.col("_i"))
    may = flat.join(small, "_res", "left_semi").alias("f").join(flags.alias("x"), same, "left").select("_d", "text", "_n", "_flags")
    out = may.unionByName(flat.join(small, "_res", "left_anti").select("_d", "text", F.lit(None).cast("int").alias("_n"), F.lit(None).cast("array<boolean>").alias("_flags")))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get(F.col("_flags"), i), F.lit(False)))
    text = F.when(F.col("_n").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    extra = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    passed = [extra.get(c, F.col(f"_d.`{c}`")).alias(c) for c in names if c not in ("n_lines", "n_dropped")]
    return out.select(*passed, F.greatest(F.lit(0), n).cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"))


#: op8's rows in DuckDB's SQL, on the lines themselves instead of hashes, for tables whose doc_ids differ.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth
  FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, nth, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain FROM l),
h AS (SELECT *, regexp_replace(plain, '[^ ]*([0-9@]|://)[^ ]*', '<*>', 'g') AS hidden FROM b),
f AS (
  SELECT *, regexp_matches(plain, '[0-9@]|://')
            AND len(regexp_extract_all(hidden, '<\*>')) > len(regexp_extract_all(hidden, '[^ ]*\p{L}[^ ]*')) AS figures
  FROM h),
m AS (
  SELECT doc_id, nth, figures, m, string_split(m, ' ') AS tok
  FROM (SELECT *, CASE WHEN figures THEN plain ELSE hidden END AS m FROM f)
  WHERE m <> '' AND (len(string_split(m, ' ')) >= 3 OR regexp_matches(m, '\p{L}'))),
k AS (
  SELECT m, any_value(tok) AS tok, any_value(len(tok)) AS n, bool_or(figures) AS figures, count(*) AS many,
         ('0x' || substr(md5(m), 1, 15))::BIGINT AS line, floor(0.3::DOUBLE * any_value(len(tok)) + 1e-9) AS free
  FROM m GROUP BY m),
wild(w) AS (VALUES ([0]), ([1]), ([2]), ([3]), ([0, 1]), ([0, 2]), ([0, 3]), ([1, 2]), ([1, 3]), ([2, 3])),
q AS (
  SELECT m, many, n, tok,
         [n::VARCHAR, w::VARCHAR] || flatten([CASE WHEN list_contains(w, i) THEN [] ELSE tok[1 + i * n // 4:(i + 1) * n // 4] END for i in range(4)]) AS leaf
  FROM k, wild WHERE free > 0 AND NOT figures AND len(w) = CASE WHEN n < 7 THEN 1 ELSE 2 END),
qr AS (SELECT leaf FROM q GROUP BY leaf HAVING sum(many) >= 5 AND count(*) > 1),
c AS (
  SELECT leaf, m, many, n, unnest(tok) AS t, generate_subscripts(tok, 1) AS pos FROM q SEMI JOIN qr USING (leaf)),
s AS (SELECT leaf, pos, t FROM c GROUP BY leaf, pos, t HAVING sum(many) >= 5),
found AS (
  SELECT DISTINCT m, k.many, line, template
  FROM (SELECT leaf, m, n || ' ' || string_agg(pos || ' ' || t, ' ' ORDER BY pos) AS template, count(*) AS constant
        FROM c JOIN s USING (leaf, pos, t) GROUP BY leaf, m, n) JOIN k USING (m) WHERE n - constant <= free),
r AS (
  SELECT template, sum(many) AS reach, bit_xor(line) AS who FROM found GROUP BY template HAVING sum(many) >= 5 AND count(*) > 1),
best AS (
  SELECT m, arg_max(template, {'reach': reach, 'who': who, 'template': template}) AS template
  FROM found JOIN r USING (template) GROUP BY m),
own AS (SELECT m FROM k WHERE many >= CASE WHEN n >= 50 THEN 2 ELSE 5 END),
marked AS (SELECT m, coalesce(template, m) AS template FROM own FULL JOIN best USING (m)),
lines AS (SELECT doc_id, nth, len(tok) AS n, template FROM m JOIN marked USING (m)),
good AS (
  SELECT template, n, min({'d': doc_id, 'n': nth}) AS first_at FROM lines GROUP BY template, n
  HAVING count(DISTINCT doc_id) >= CASE WHEN n >= 50 THEN 2 ELSE 5 END),
x AS (SELECT doc_id, nth FROM lines JOIN good USING (template, n) WHERE {'d': doc_id, 'n': nth} <> first_at),
o AS (
  SELECT l.doc_id, count(*) AS n_lines, count(x.nth) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.nth) FILTER (x.nth IS NULL), '') AS kept
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.nth = x.nth GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
