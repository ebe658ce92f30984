"""The queries of the stream operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, keys, statistics
from ..operators import elementwise, limits, mixing, monitoring, shuffling, windows
from ..operators.position import scratch, with_group_position, with_position
from ..sources.drivers import CsvDriver, DirectoryDriver, FeatherDriver, JsonlDriver, MessagepackDriver, SourceCombiner, ZarrDriver, combined, list_driver_names, write_array
from ..sources.files import FilesystemStore, file_paths
from ..sources.iterables import DummyShardedDriver, iterable_source
from ..sources.serializers import JsonSerializer
from ..sources.shards import ShardStore, put_bytes
from ..stream import Stream
from . import artifacts, catalog

QUERIES: dict = {}
ORACLES: dict = {}
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark, d, *columns) -> DataFrame:
    return with_position(table(spark, d, "events").select("event_id", *columns), ["event_id"])


def text(c) -> F.Column:
    """An array as text, so that results compare plainly."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "null")


EV = "WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) "


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_project(spark, d):
    df = table(spark, d, "lineitem")
    return elementwise.mapped(df, revenue=F.col("l_extendedprice") * (1 - F.col("l_discount"))).select(*LINE, "revenue")


@query("SELECT o_orderkey, 3 * o_custkey + 7 AS v, upper(o_orderpriority) AS p FROM orders")
def map_kwargs(spark, d):
    def line(c, a, b):
        return a * c + b

    return elementwise.mapped(table(spark, d, "orders"), v=line(F.col("o_custkey"), a=3, b=7), p=F.upper("o_orderpriority")).select("o_orderkey", "v", "p")


@query("SELECT c_custkey, upper(trim(c_name)) || '!' AS name FROM customer")
def map_callable(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return elementwise.map_rows(df, lambda r, end: {"c_custkey": r["c_custkey"], "name": r["c_name"].strip().upper() + end}, "c_custkey long, name string", end="!")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def filter_pred(spark, d):
    return elementwise.filtered(table(spark, d, "events"), "event_type = 'purchase' and value > 10").select("event_id", "value")


@query("SELECT doc_id AS pos, i - 1 AS inner_pos, w[i] AS value FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)")
def flatten_tokens(spark, d):
    df = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.split("text", " ").alias("w"))
    return elementwise.flattened(df, "w")


@query("SELECT vec_id AS pos, i - 1 AS inner_pos, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
def flatten_embedding(spark, d):
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    return elementwise.flattened(df, "embedding").withColumn("value", F.col("value").cast("double"))


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def zip_index(spark, d):
    return with_position(table(spark, d, "lineitem").select(*LINE), LINE)


@query("SELECT printf('%03d', row_number() OVER (ORDER BY o_orderkey) - 1) AS idx, o_orderkey FROM orders")
def zip_index_padded(spark, d):
    return limits.numbered(with_position(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]), 3).select("idx", "o_orderkey")


@query(EV + "SELECT pos, event_id FROM e WHERE pos < 137")
def take_n(spark, d):
    return limits.take(events(spark, d), 137).select("pos", "event_id")


@query(EV + "SELECT epoch * (SELECT count(*) FROM events) + pos AS pos, CAST(epoch AS INTEGER) AS epoch, event_id FROM e, range(3) t(epoch)")
def loop_n(spark, d):
    return limits.loop(events(spark, d), 3).select("pos", "epoch", "event_id")


@query("WITH r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS p FROM region) SELECT * FROM (SELECT epoch * 5 + p AS pos, CAST(epoch AS INTEGER) AS epoch, r_regionkey FROM r, range(4) t(epoch)) WHERE pos < 17")
def loop_take(spark, d):
    df = with_position(table(spark, d, "region").select("r_regionkey"), ["r_regionkey"])
    return limits.loop_take(df, 17).select("pos", "epoch", "r_regionkey")


@query(EV + "SELECT pos // 4 AS pos, event_id FROM e WHERE pos % 4 = 1")
def split_rank(spark, d):
    return limits.split(events(spark, d), 1, 4).select("pos", "event_id")


@query(EV + "SELECT pos // 3 AS pos, event_id FROM e WHERE pos % 3 = 2")
def split_worker(spark, d):
    return limits.split(events(spark, d), 2, 3).select("pos", "event_id")


@query(EV + "SELECT pos // 4 // 2 AS pos, event_id FROM e WHERE pos % 4 = 1 AND (pos // 4) % 2 = 0")
def split_rank_worker(spark, d):
    return limits.split(limits.split(events(spark, d), 1, 4), 0, 2).select("pos", "event_id")


def lines(spark, d) -> DataFrame:
    return with_position(table(spark, d, "lineitem").select(*LINE, "l_quantity"), LINE)


LI = "WITH l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem) "


@query(LI + "SELECT pos // 32 AS batch_id, count(*) AS n, sum(l_quantity) AS qty, min(l_orderkey) AS first_order FROM l GROUP BY 1")
def batched_collate(spark, d):
    return windows.batched(lines(spark, d), 32, [F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.min("l_orderkey").alias("first_order")], drop_last=False)


@query(EV + "SELECT pos // 7 AS batch_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) AS items FROM e GROUP BY 1 HAVING count(*) = 7")
def batched_drop(spark, d):
    return windows.batched(events(spark, d), 7).withColumn("items", text("items"))


@query(EV + "SELECT pos // 7 AS batch_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) AS items FROM e GROUP BY 1")
def batched_keep(spark, d):
    return windows.batched(events(spark, d), 7, drop_last=False).withColumn("items", text("items"))


def _slide(w, s, having, pad=False):
    items = "string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos)" + (f" || repeat(',null', CAST({w} - count(*) AS INTEGER))" if pad else "")
    return EV + f"SELECT w.s AS win_start, {items} AS items FROM (SELECT pos AS s FROM e WHERE pos % {s} = 0) w JOIN e ON e.pos BETWEEN w.s AND w.s + {w - 1} GROUP BY w.s HAVING {having}"


@query(_slide(5, 1, "count(*) = 5"))
def sliding_full(spark, d):
    return windows.sliding(events(spark, d), 5).withColumn("items", text("items"))


@query(_slide(16, 4, "count(*) = 16"))
def sliding_stride(spark, d):
    return windows.sliding(events(spark, d), 16, 4).withColumn("items", text("items"))


@query(_slide(6, 2, "count(*) >= 3"))
def sliding_partial(spark, d):
    return windows.sliding(events(spark, d), 6, 2, drop_last=False, least=3).withColumn("items", text("items"))


@query(_slide(6, 2, "count(*) >= 1", pad=True))
def sliding_filled(spark, d):
    return windows.sliding(events(spark, d), 6, 2, drop_last=False, fill=True).withColumn("items", text("items"))


MON = EV + "SELECT pos, {} FROM (SELECT pos, (epoch_us(ts) - lag(epoch_us(ts), 4) OVER (ORDER BY pos)) / 1e6 AS dt, sum(octet_length(encode(props))) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS b FROM e) WHERE pos >= 4"


@query(MON.format("round(5 / dt, 2) AS iops, 0.0::DOUBLE AS throughput"))
def monitor_iops(spark, d):
    return monitoring.monitor(events(spark, d, "ts", "props"), "ts", F.octet_length("props"), 5, monitoring.MetricsConf(throughput=False))


@query(MON.format("0.0::DOUBLE AS iops, round(b::DOUBLE / 1024.0::DOUBLE / dt, 2) AS throughput"))
def monitor_throughput(spark, d):
    return monitoring.monitor(events(spark, d, "ts", "props"), "ts", F.octet_length("props"), 5, monitoring.MetricsConf(iops=False, throughput_unit="KB"))


@query(EV + "SELECT row_number() OVER (ORDER BY md5('42:' || pos), pos) - 1 AS pos, pos AS in_pos, event_id FROM e")
def hash_shuffle(spark, d):
    return shuffling.hash_shuffle(events(spark, d), 42).select("pos", "in_pos", "event_id")


@query(EV + "SELECT pos // 100 * 100 + row_number() OVER (PARTITION BY pos // 100 ORDER BY md5('42:' || pos), pos) - 1 AS pos, pos AS in_pos, event_id FROM e")
def block_shuffle(spark, d):
    return shuffling.block_shuffle(events(spark, d), 100, 42).select("pos", "in_pos", "event_id")


@query(None)
def buffer_shuffle(spark, d):
    """Seeded draws are past SQL; the tests hold it against a plain simulation."""
    return shuffling.buffer_shuffle(events(spark, d), 1000, 100, 42).select("pos", "in_pos", "event_id")


def by_lang(spark, d) -> DataFrame:
    return with_group_position(table(spark, d, "documents").select("lang", "doc_id"), "lang", ["doc_id"])


BYLANG = "WITH RECURSIVE d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_idx, dense_rank() OVER (ORDER BY lang) - 1 AS ord FROM documents) "


@query(BYLANG + "SELECT row_number() OVER (ORDER BY row_idx, ord) - 1 AS pos, lang, row_idx, doc_id FROM d")
def interleave_longest(spark, d):
    return mixing.interleaved(by_lang(spark, d), "lang").select("pos", "lang", "row_idx", "doc_id")


@query(
    BYLANG
    + """, s AS (SELECT list(n ORDER BY ord) AS n FROM (SELECT ord, count(*) AS n FROM d GROUP BY ord)),
m(step, n, alive, cur, i, src, row) AS (
  SELECT 0, n, range(len(n)), list_transform(n, lambda x: 0::BIGINT), 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM s
  UNION ALL
  SELECT step + 1, n,
         CASE WHEN more THEN alive ELSE list_filter(alive, lambda x: x <> a) END,
         CASE WHEN more THEN list_transform(cur, lambda x, k: CASE WHEN k = a + 1 THEN x + 1 ELSE x END) ELSE cur END,
         CASE WHEN more THEN (i + 1) % len(alive) ELSE 0 END,
         CASE WHEN more THEN a END, CASE WHEN more THEN cur[a + 1] END
  FROM (SELECT *, alive[i + 1] AS a, cur[alive[i + 1] + 1] < n[alive[i + 1] + 1] AS more FROM m WHERE len(alive) > 0))
SELECT row_number() OVER (ORDER BY step) - 1 AS pos, lang, row_idx, doc_id FROM m JOIN d ON d.ord = m.src AND d.row_idx = m.row WHERE src IS NOT NULL"""
)
def round_robin(spark, d):
    return mixing.round_robin(by_lang(spark, d), "lang").select("pos", "lang", "row_idx", "doc_id")


@query(None)
def mux_sampling(spark, d):
    """Seeded draws are past SQL; the tests hold counts and restarts against known values."""
    return mixing.sampled(by_lang(spark, d), "lang", {"de": 0.3, "en": 0.4, "es": 0.1, "fr": 0.2}, 42, 4).select("pos", "lang", "epoch", "row_idx", "doc_id")


@query(None)
def mux_uniform(spark, d):
    return mixing.sampled(by_lang(spark, d), "lang", None, 42).select("pos", "lang", "epoch", "row_idx", "doc_id")


@query("SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_idx, doc_id FROM documents")
def sampler_union(spark, d):
    return mixing.sampled_once(by_lang(spark, d), "lang", None, 42).select("lang", "row_idx", "doc_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS in_pos, true AS within FROM events")
def buffer_shuffle_bounds(spark, d):
    """What holds for any seed: every row once, none earlier by the buffer's size."""
    df = shuffling.buffer_shuffle(events(spark, d), 1000, 100, 42)
    return df.select("event_id", "in_pos", (F.col("in_pos") - F.col("pos") < 1000).alias("within"))


def epochs_seen(mix: DataFrame, by: DataFrame) -> DataFrame:
    """How often a mix has each row, by what holds for any seed: a source's rows come in order, epoch by epoch."""
    n = mix.groupBy("lang", "row_idx").agg(F.count("*").alias("n"))
    most = n.groupBy("lang").agg(F.max("n").alias("most"), F.max(F.when(F.col("row_idx") == 0, F.col("n"))).alias("first"))
    rows = by.join(n, ["lang", "row_idx"], "left").join(most, "lang", "left")
    fair = (F.coalesce("n", F.lit(0)) >= F.col("most") - 1) & (F.col("first") == F.col("most"))
    return rows.select("lang", "row_idx", fair.alias("fair"))


@query("SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_idx, true AS fair FROM documents")
def mux_uniform_epochs(spark, d):
    df = by_lang(spark, d)
    return epochs_seen(mixing.sampled(df, "lang", None, 42), df)


@query("SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_idx, true AS fair FROM documents")
def mux_sampling_epochs(spark, d):
    df = by_lang(spark, d)
    return epochs_seen(mixing.sampled(df, "lang", {"de": 0.3, "en": 0.4, "es": 0.1, "fr": 0.2}, 42, 4), df)


@query("SELECT lang, true AS told FROM (SELECT DISTINCT lang FROM documents)")
def mux_counts(spark, d):
    """Samples and restarts that the sampler tells are those of its rows: whole epochs are its restarts."""
    mix, told = mixing.sampled_with_counts(by_lang(spark, d), "lang", None, 42)
    rows = spark.createDataFrame([(k, n, r) for k, (n, r) in told.items()], "lang string, samples long, restarts long")
    seen = mix.groupBy("lang").agg(F.count("*").alias("n"), F.max("epoch").alias("last"))
    same = (F.col("n") == F.col("samples")) & F.col("last").between(F.col("restarts") - 1, F.col("restarts"))
    return rows.join(seen, "lang").select("lang", same.alias("told"))


@query("SELECT lang, count(*) AS n_samples, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS ratio, count(*) AS size, 1.0::DOUBLE AS epochs FROM documents GROUP BY lang")
def mux_statistics(spark, d):
    df = mixing.round_robin(by_lang(spark, d), "lang")
    return mixing.statistics(df, "lang", by_lang(spark, d).groupBy("lang").agg(F.count("*").alias("size")))


def order_shards(spark, d, format="jsonl") -> ShardStore:
    df = with_position(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), ["o_orderkey"])
    store = ShardStore(spark, scratch(spark), format)
    store.write(df.withColumn("shard", F.floor(F.col("pos") / 1000)), "shard", "pos")
    return store


ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string"
SHARDS = "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) "
READ = SHARDS + "SELECT CAST(pos // 1000 AS VARCHAR) AS shard_key, pos % 1000 AS row_in_shard, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM o"


@query(READ)
def shard_roundtrip(spark, d):
    return JsonlDriver(spark, order_shards(spark, d).url, ORDERS).get_df()


@query(READ)
def shard_roundtrip_messagepack(spark, d):
    return MessagepackDriver(spark, order_shards(spark, d, "messagepack").url, ORDERS).get_df()


@query(SHARDS + "SELECT DISTINCT CAST(pos // 1000 AS VARCHAR) AS shard_key FROM o")
def keys_listing(spark, d):
    return order_shards(spark, d).keys_df()


@query(READ + " WHERE pos // 1000 = 1")
def key_lookup(spark, d):
    return JsonlDriver(spark, order_shards(spark, d).url, ORDERS).get_df(["1"])


@query(SHARDS + ", k AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT CAST(pos // 1000 AS VARCHAR) AS k FROM o)) SELECT CAST(pos // 1000 AS VARCHAR) AS shard_key, pos % 1000 AS row_in_shard, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM o WHERE CAST(pos // 1000 AS VARCHAR) IN (SELECT k FROM k WHERE i % 4 = 1)")
def shard_pruning(spark, d):
    driver = JsonlDriver(spark, order_shards(spark, d).url, ORDERS)
    stream = driver.get_stream(key_hooks=[lambda k: k.split_by_rank(1, 4)])
    return stream.df.select("shard_key", "row_in_shard", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query(SHARDS + "SELECT DISTINCT CAST(pos // 1000 AS VARCHAR) AS shard_key FROM o WHERE CAST(pos // 1000 AS VARCHAR) IN (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT CAST(pos // 1000 AS VARCHAR) AS k FROM o)) WHERE i % 4 = 1)")
def skip_k_keys(spark, d):
    keyed = with_position(order_shards(spark, d).keys_df(), ["shard_key"])
    return limits.split(keyed, 1, 4).select("shard_key")


def catalogs(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")

    def entry(version):
        keys = docs.select(F.col("source").alias("identifier"), F.expr(version).cast("int").alias("version")).distinct()
        return keys.select("*", F.lit("csv").alias("driver_name"), F.lit("{}").alias("driver_kwargs"), F.lit("{}").alias("metadata"))

    return entry("doc_id % 3 + 1"), entry("doc_id % 4 + 2")


CAT = (
    "WITH a AS (SELECT DISTINCT source AS identifier, CAST(doc_id % 3 + 1 AS INTEGER) AS version FROM documents), "
    "b AS (SELECT DISTINCT source AS identifier, CAST(doc_id % 4 + 2 AS INTEGER) AS version FROM documents) "
)


@query(CAT + "SELECT * FROM a UNION SELECT * FROM b")
def catalog_union(spark, d):
    return catalog.union_df(*catalogs(spark, d)).select("identifier", "version")


@query(CAT + "SELECT * FROM a INTERSECT SELECT * FROM b")
def catalog_intersection(spark, d):
    return catalog.intersection_df(*catalogs(spark, d)).select("identifier", "version")


@query(CAT + "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def catalog_difference(spark, d):
    return catalog.difference_df(*catalogs(spark, d)).select("identifier", "version")


@query(CAT + "SELECT identifier, max(version) AS version FROM a GROUP BY identifier")
def catalog_latest(spark, d):
    return catalog.latest_df(catalogs(spark, d)[0]).select("identifier", "version")


@query(CAT + "SELECT * FROM a WHERE identifier IN ('src1', 'src2', 'src3', 'src4', 'src5') AND version > 1")
def catalog_slice_filter(spark, d):
    return catalogs(spark, d)[0].where(F.col("identifier").isin("src1", "src2", "src3", "src4", "src5") & (F.col("version") > 1)).select("identifier", "version")


@query(CAT + "SELECT * FROM a UNION ALL SELECT x.identifier, CAST(coalesce(v, 0) + 1 AS INTEGER) FROM (SELECT DISTINCT identifier FROM b) x LEFT JOIN (SELECT identifier, max(version) AS v FROM a GROUP BY 1) USING (identifier)")
def catalog_new_versions(spark, d):
    a, b = catalogs(spark, d)
    return catalog.with_new_versions(a, b.dropDuplicates(["identifier"])).select("identifier", "version")


@query("SELECT 'region' AS subset, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def combine_subsets(spark, d):
    return combined({"region": table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "nation": table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))})


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_roundtrip(spark, d):
    path = scratch(spark)
    table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", True).csv(path)
    df = CsvDriver(spark, path).get_df()
    return df.select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def feather_roundtrip(spark, d):
    """Feather is a file format of one machine: the small table is written by the driver, read by tasks."""
    import pyarrow as pa
    from pyarrow import feather

    sink = pa.BufferOutputStream()
    feather.write_feather(table(spark, d, "nation").toArrow(), sink, compression="uncompressed")
    path = scratch(spark) + "/nation.feather"
    put_bytes(spark, path, sink.getvalue().to_pybytes())
    return FeatherDriver(spark, path).get_df()


@query("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def df_hooks(spark, d):
    from ..sources.drivers import ParquetDriver

    hooks = [lambda df: df.where("s_acctbal > 0"), lambda df: df.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("bal"))]
    return ParquetDriver(spark, f"{d}/supplier.parquet", df_hooks=hooks).get_df()


@query("SELECT page_id, CASE WHEN regexp_matches(e, '^(\\d+\\.)+\\d+') OR e LIKE '%.zip' OR e IN ('.zarray', '.zgroup', '.zattrs') THEN b ELSE b || '/' END AS key, e AS last FROM (SELECT page_id, b, split_part(b, '/', -1) AS e FROM (SELECT page_id, trim(url, '/') AS b FROM pages))")
def normalize_key(spark, d):
    df = table(spark, d, "pages")
    key = keys.normalize_key(F.col("url"))
    return df.select("page_id", key.alias("key"), keys.key_end(F.regexp_replace("url", "^/+|/+$", "")).alias("last"))


@query("SELECT o_orderkey, printf('%04d', o_orderkey) AS padded, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS key, regexp_matches(o_orderkey || '.' || o_custkey, '^(\\d+\\.)+\\d+') AS chunk FROM orders")
def key_functions(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", keys.zero_padded(k, 4).alias("padded"), keys.key_of(k).alias("key"), keys.is_chunk(F.concat_ws(".", k, F.col("o_custkey"))).alias("chunk"))


@query("SELECT vec_id, 'float32' AS type, '8,8' AS shape, len(embedding) AS n, CAST(embedding[9] AS DOUBLE) AS second_row FROM embeddings")
def ndarray_encode(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", arrays.from_json(arrays.to_json(F.col("embedding").cast("array<double>"), "float32", [8, 8])).alias("a"))
    return df.select("vec_id", "a.type", text("a.shape").alias("shape"), F.size("a.data").cast("long").alias("n"), F.element_at(F.element_at(arrays.rows_of(F.col("a.data"), 8), 2), 1).alias("second_row"))


@query("SELECT round(avg(sign(b.p_retailprice - a.p_retailprice)), 9) AS tau FROM part a JOIN part b ON a.p_partkey < b.p_partkey")
def kendall_tau(spark, d):
    return statistics.kendall_tau(table(spark, d, "part"), "p_partkey", "p_retailprice").select(F.round("tau", 9).alias("tau"))


@query("SELECT DISTINCT lang AS collection, source AS artifact, CAST(doc_id % 12 AS INTEGER) AS version, CAST(max(doc_id % 12) OVER (PARTITION BY lang, source) AS INTEGER) AS latest FROM documents")
def artifact_versions(spark, d):
    paths = table(spark, d, "documents").select(F.concat_ws("/", F.lit("root"), "lang", "source", F.concat(F.lit("v"), F.col("doc_id") % 12), F.lit("files/x.txt")).alias("path"))
    return artifacts.versions_of(paths)


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS row, CAST(j - 1 AS INTEGER) AS col, CAST(embedding[(i - 1) * 8 + j] AS DOUBLE) AS value FROM embeddings, range(1, 9) a(i), range(1, 9) b(j)")
def ndarray_values(spark, d):
    """Every value of every array, encoded, decoded and cut into rows."""
    df = table(spark, d, "embeddings").select("vec_id", arrays.from_json(arrays.to_json(F.col("embedding").cast("array<double>"), "float32", [8, 8])).alias("a"))
    rows = df.select("vec_id", F.posexplode(arrays.rows_of(F.col("a.data"), 8)).alias("row", "r"))
    return rows.select("vec_id", "row", F.posexplode("r").alias("col", "value"))


NULLS = "CASE WHEN o_orderkey % 3 <> 0 THEN 9007199254740993 + o_orderkey END"


@query(f"SELECT o_orderkey, {NULLS} AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders")
def map_nulls(spark, d):
    """Integers past the doubles beside nulls, through a Python function."""
    df = table(spark, d, "orders").select("o_orderkey", F.expr(NULLS).alias("v"), "o_orderstatus")
    return elementwise.map_rows(df, lambda r: {**r, "s": r["o_orderstatus"] if r["o_orderkey"] % 2 == 0 else None}, "o_orderkey long, v long, s string")


@query(SHARDS + f"SELECT CAST(pos // 1000 AS VARCHAR) AS shard_key, pos % 1000 AS row_in_shard, o_orderkey, {NULLS} AS v, o_orderkey % 7 = 0 AS flag FROM o")
def shard_nulls_messagepack(spark, d):
    df = with_position(table(spark, d, "orders").select("o_orderkey", F.expr(NULLS).alias("v"), (F.col("o_orderkey") % 7 == 0).alias("flag")), ["o_orderkey"])
    store = ShardStore(spark, scratch(spark), "messagepack")
    store.write(df.withColumn("shard", F.floor(F.col("pos") / 1000)), "shard", "pos")
    return store.read("o_orderkey long, v long, flag boolean")


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation")
def async_map(spark, d):
    s = Stream(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return s.async_map(lambda r: {"name": r["n_name"].upper()}, "name string", buffer=10, max_workers=4).df.select("n_nationkey", "name")


@query("SELECT i AS pos, i * i AS item FROM range(1000) t(i)")
def iterable_items(spark, d):
    return iterable_source(spark, lambda: (i * i for i in range(1000))).df.select("pos", "item")


@query("SELECT CAST(i // 25 AS VARCHAR) AS shard_key, i % 25 AS row_in_shard, i AS item FROM range(100) t(i)")
def dummy_shards(spark, d):
    return DummyShardedDriver(spark, 4, 25).get_df()


@query("SELECT n_nationkey AS k, 2 * n_nationkey AS twice FROM nation WHERE n_nationkey > 1 ORDER BY k LIMIT 7")
def source_rebound(spark, d):
    """Operators that were put on one source, on another."""
    region = Stream(table(spark, d, "region").select(F.col("r_regionkey").alias("k")), ["k"])
    nation = Stream(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), ["k"])
    return region.filter("k > 1").map(twice=2 * F.col("k")).take(7).source_(nation).df.select("k", "twice")


@query(EV + "SELECT pos, event_id, true AS told FROM e")
def monitor_identity(spark, d):
    """Rows pass; the callback is told once for each row from the window's length on."""
    seen = []
    s = Stream(events(spark, d, "ts", "props"), ["pos"], True).monitor(seen.append, "ts", F.octet_length("props"), window=5)
    s.join()
    n = s.df.count()
    return s.df.select("pos", "event_id", F.lit(len(seen) == max(0, n - 4)).alias("told"))


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) WHERE pos % 2 = 1")
def loader_rows(spark, d):
    """What one of two ranks gets from a loader's iterable."""
    s = Stream(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    rows = list(s.split_by_rank(1, 2).to_torch_iterable(columns=["n_nationkey", "n_name"]))
    return spark.createDataFrame(rows, "n_nationkey int, n_name string") if rows else s.df.limit(0)


def two_sources(spark, d) -> SourceCombiner:
    stores = {}
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        rows = with_position(table(spark, d, name).select(F.col(key).cast("long").alias("k"), F.col(f"{name[0]}_name").alias("name")), ["k"])
        store = ShardStore(spark, scratch(spark))
        store.write(rows.withColumn("shard", F.floor(F.col("pos") / 10)), "shard", "pos")
        stores[name] = catalog.Source("jsonl", {"url": store.url, "schema": "k long, name string"})
    return SourceCombiner(spark, {n: (n, 1) for n in stores}, catalog.Catalog({n: {1: s} for n, s in stores.items()}))


BOTH = (
    "WITH b AS (SELECT 'nation' AS source, 0 AS ord, n_nationkey AS k, n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_idx FROM nation "
    "UNION ALL SELECT 'region', 1, r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) - 1 FROM region) "
)


@query(BOTH + "SELECT row_number() OVER (ORDER BY row_idx, ord) - 1 AS pos, source, CAST(k AS BIGINT) AS k, name FROM b")
def combined_interleaved(spark, d):
    return two_sources(spark, d).get_stream().df.select("pos", "source", "k", "name")


@query(BOTH + "SELECT source, row_idx, CAST(k AS BIGINT) AS k, name FROM b")
def combined_sampled(spark, d):
    return two_sources(spark, d).get_sampled({"nation": 0.7, "region": 0.3}, 5).df.select("source", "row_idx", "k", "name")


@query(
    SHARDS
    + """, k AS (SELECT s, row_number() OVER (ORDER BY md5('7:' || i), i) - 1 AS sp FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT DISTINCT CAST(pos // 1000 AS VARCHAR) AS s FROM o))),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sp, pos) - 1 AS p FROM o JOIN k ON k.s = CAST(o.pos // 1000 AS VARCHAR))
SELECT p // 100 * 100 + row_number() OVER (PARTITION BY p // 100 ORDER BY md5('9:' || p), p) - 1 AS pos, o_orderkey FROM r"""
)
def two_level_shuffle(spark, d):
    """Shards in random order, then rows in random order within blocks."""
    driver = JsonlDriver(spark, order_shards(spark, d).url, ORDERS)
    return driver.get_stream(key_seed=7, item_seed=9, item_buffer=100).df.select("pos", "o_orderkey")


@query("SELECT r_name AS key, r_regionkey AS value FROM region")
def whole_objects(spark, d):
    store = FilesystemStore(spark, scratch(spark), JsonSerializer())
    for r in table(spark, d, "region").select("r_name", "r_regionkey").toLocalIterator():
        store.set({"value": r["r_regionkey"]}, f"regions/{r['r_name']}")
    rows = [(k.removeprefix("regions/"), store.get(k)["value"]) for k in store.keys()]
    return spark.createDataFrame(rows, "key string, value int")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS key, i - 1 AS at, s[i] AS value FROM (SELECT s_nationkey, list(s_acctbal ORDER BY s_suppkey) AS s FROM supplier GROUP BY 1), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def array_roundtrip(spark, d):
    """An array a nation, written in chunks of seven by the driver, decoded by tasks."""
    url = scratch(spark)
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_acctbal").cast("double").alias("b")))).alias("s"))
    for r in rows.toLocalIterator():
        write_array(spark, url, str(r["s_nationkey"]), [x["b"] for x in r["s"]], [7])
    return ZarrDriver(spark, url).get_df().select("key", F.posexplode("data").alias("at", "value")).withColumn("at", F.col("at").cast("long"))


def regions_store(spark, d) -> FilesystemStore:
    store = FilesystemStore(spark, scratch(spark), JsonSerializer())
    for r in table(spark, d, "region").select("r_name", "r_regionkey").toLocalIterator():
        store.set({"value": r["r_regionkey"]}, f"regions/{r['r_name'].replace(' ', '_')}.json")
    return store


FILES = "SELECT 'regions/' || replace(r_name, ' ', '_') || '.json' AS key"


@query(FILES + ", CAST(length('{\"value\": ' || r_regionkey || '}') AS INTEGER) AS bytes FROM region")
def directory_files(spark, d):
    return DirectoryDriver(spark, regions_store(spark, d).url).get_df().select("key", F.length("content").alias("bytes"))


@query(FILES + " FROM region")
def file_listing(spark, d):
    store = regions_store(spark, d)
    return file_paths(spark, store.url, nested=True).select(F.expr("substring(path, instr(path, 'regions/'))").alias("key"))


@query("SELECT pos, c_custkey + 1 AS k FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)")
def deserialising_hook(spark, d):
    rows = with_position(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    store = ShardStore(spark, scratch(spark))
    store.write(rows.withColumn("shard", F.lit("all")).withColumn("at", F.col("pos")), "shard", "at")
    return JsonlDriver(spark, store.url, "pos long, c_custkey long", deser_hook=lambda x: {**x, "c_custkey": x["c_custkey"] + 1}).get_df().select("pos", F.col("c_custkey").alias("k"))


@query("SELECT unnest(['csv', 'directory', 'dummy_sharded', 'excel', 'feather', 'file', 'jsonl', 'messagepack', 'parquet', 'source_combiner', 'zarr']) AS name")
def driver_names(spark, d):
    return spark.createDataFrame([(n,) for n in list_driver_names()], "name string")


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def driver_options(spark, d):
    """A catalogue's driver: its own storage options and those of the call, merged."""
    path = scratch(spark)
    table(spark, d, "region").select("r_regionkey", "r_name").write.option("sep", "|").option("header", True).csv(path)
    source = catalog.Source("csv", {"url": path, "storage_options": {"header": True, "sep": ","}})
    return source.get_driver(spark, storage_options={"sep": "|"}).get_df().select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))


def collected(spark, d) -> catalog.Catalog:
    """The first catalogue as a Python object: its entries are a few a source."""
    out = catalog.Catalog()
    for r in catalogs(spark, d)[0].toLocalIterator():
        out[r["identifier"], r["version"]] = catalog.Source(r["driver_name"], {"url": r["identifier"]}, {"n": r["version"]})
    return out


@query(CAT + "SELECT identifier, version, '{\"url\": \"' || identifier || '\"}' AS driver_kwargs FROM a")
def catalog_yaml(spark, d):
    """Written as YAML and read back, and equal to what was written."""
    was = collected(spark, d)
    again = catalog.Catalog.from_str(was.to_str())
    return again.to_df(spark).where(F.lit(again == was and was.copy() == was)).select("identifier", "version", "driver_kwargs")


@query(CAT + "SELECT identifier, version FROM a WHERE version < (SELECT max(version) FROM a x WHERE x.identifier = a.identifier) UNION ALL SELECT DISTINCT identifier, 9 FROM a")
def catalog_edits(spark, d):
    """The latest version of each identifier goes, version 9 is set."""
    c = collected(spark, d)
    for k in c.keys():
        source = c[k, catalog.LATEST]
        if len(c[k]) > 1:
            del c[k, catalog.LATEST]
        else:
            c = c.difference(c.slice([k]))
        c[k][9] = source
    return c.to_df(spark).select("identifier", "version")


@query(CAT + "SELECT * FROM a UNION ALL SELECT identifier || '-b', version FROM b")
def catalog_join(spark, d):
    mine = collected(spark, d)
    other = catalog.Catalog.of({(f"{r['identifier']}-b", r["version"]): catalog.Source("csv") for r in catalogs(spark, d)[1].toLocalIterator()})
    return mine.join(other).to_df(spark).select("identifier", "version")


@query("SELECT 'notes/' || r_name AS identifier, v AS version, v - 1 AS logged, 'directory' AS driver_name FROM region, (VALUES (1), (2)) t(v)")
def artifact_catalog(spark, d):
    """Two versions of an artifact a region, logged as files and listed as a catalogue."""
    import tempfile
    from pathlib import Path

    manager = artifacts.ArtifactManager(spark, scratch(spark), "notes")
    with tempfile.TemporaryDirectory() as local:
        for r in table(spark, d, "region").select("r_name").toLocalIterator():
            for text in ("first", "second"):
                (Path(local) / "note.txt").write_text(text)
                manager.log_files(r["r_name"], f"{local}/note.txt")
    found = manager.to_catalog().to_df(spark).where(F.lit(manager.collections() == ["notes"] and not manager.exists("none")))
    return found.select("identifier", "version", F.get_json_object("metadata", "$.version").cast("int").alias("logged"), "driver_name")


@query("SELECT n_name AS key, 1 AS version, n_nationkey AS value FROM nation")
def artifact_objects(spark, d):
    store = artifacts.ArtifactFileStore(artifacts.ArtifactManager(spark, scratch(spark), "objects"), JsonSerializer())
    names = {}
    for r in table(spark, d, "nation").select("n_name", "n_nationkey").toLocalIterator():
        names[r["n_name"]] = [store.set({"v": v}, r["n_name"]) for v in (-1, r["n_nationkey"])]
    rows = [(k, int(keys[1].rsplit("/v", 1)[-1]), store.get(k)["v"]) for k, keys in names.items() if store.key_exists(keys[0])]
    return spark.createDataFrame(rows, "key string, version int, value int")


@query("SELECT event_id, value FROM events WHERE value > 10")
def partition_function(spark, d):
    """A function of the iterator of a partition's rows."""
    s = Stream(table(spark, d, "events").select("event_id", "value"), ["event_id"])
    return s.map_partition(lambda rows: (r for r in rows if r["value"] is not None and r["value"] > 10), "event_id long, value double").df


@query("SELECT count(*) AS seen FROM events")
def progress_count(spark, d):
    s, seen = Stream(table(spark, d, "events").select("event_id"), ["event_id"]).tqdm()
    s.join()
    return spark.createDataFrame([(seen.get["rows"],)], "seen long")


@query("SELECT o_orderkey, o_orderkey || '/part.0' AS name, CAST(o_custkey AS VARCHAR) AS customer, 'b' AS high, 'k' AS low, CAST(o_orderkey % 5 + 2 AS INTEGER) AS n FROM orders")
def key_and_map_functions(spark, d):
    """Endings and roots of keys off, fields of JSON, maps merged with the second winning, nested arrays flattened."""
    k = F.col("o_orderkey")
    df = table(spark, d, "orders")
    path = F.concat(F.lit("root/"), k, F.lit("/part.0.gz"))
    both = keys.merged(F.create_map(F.lit("a"), F.lit("k"), F.lit("b"), F.lit("x")), F.create_map(F.lit("b"), F.lit("b")))
    nested = F.array(F.sequence(F.lit(0), k % 5), F.array(F.lit(7).cast("long")))
    customer = F.get_json_object(F.to_json(F.struct(F.struct("o_custkey").alias("meta"))), "$.meta.o_custkey")
    return df.select("o_orderkey", keys.without_gz(keys.relative(path, "root/")).alias("name"), customer.alias("customer"), both["b"].alias("high"), both["a"].alias("low"), F.size(arrays.flat(nested)).alias("n"))


@query("SELECT 's3' AS a, '' AS b, 'gs' AS c, o_orderkey FROM orders")
def protocols(spark, d):
    from_url = [keys.protocol(F.concat(F.lit(p), F.col("o_orderkey"))) for p in ("s3://x/", "/local/")]
    given = F.lit(keys.protocol_of("s3://x", {"protocol": "gs"}))
    return table(spark, d, "orders").select(from_url[0].alias("a"), from_url[1].alias("b"), given.alias("c"), "o_orderkey")
