"""Stores, drivers, catalogue, artifacts, keys and streaming windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import keys
from rillflow.operators.position import scratch
from rillflow.plans.artifacts import ArtifactManager
from rillflow.plans.catalog import Catalog, Source
from rillflow.sources.drivers import DRIVERS, DirectoryDriver, JsonlDriver, ZarrDriver, list_driver_names
from rillflow.sources.serializers import JsonSerializer, MessagepackSerializer
from rillflow.sources.shards import ShardStore, listing
from rillflow.streaming.windows import CountWindows

SAMPLE = {"key": "s", "label": 3, "nested": {"a": [1, 2.5, None, True]}, "big": 1 << 40, "neg": -5, "text": "é" * 300}


@pytest.mark.parametrize("serializer", [JsonSerializer(), MessagepackSerializer()])
def test_serializers(serializer):
    listed = lambda x: {k: listed(v) for k, v in x.items()} if isinstance(x, dict) else [listed(v) for v in x] if isinstance(x, (list, tuple)) else x
    assert [listed(x) for x in serializer.load_shard(serializer.dump_shard([SAMPLE, {}]))] == [SAMPLE, {}]
    assert serializer.loads(serializer.dumps(np.int32(7))) == 7
    assert listed(serializer.loads(serializer.dumps(np.zeros((2, 2)))))["shape"] == [2, 2]


@pytest.mark.parametrize("format", ["jsonl", "messagepack"])
def test_store(spark, format):
    store = ShardStore(spark, scratch(spark), format)
    assert store.keys() == []
    assert store.set({"a": 1, "b": "x"}, "one") == "one" and len(store.set([{"a": 2, "b": "y"}, {"a": 3, "b": None}])) == 16
    assert "one" in store.keys() and len(store.keys()) == 2
    assert [dict(x) for x in store.get("one")] == [{"a": 1, "b": "x"}]
    rows = store.read("a long, b string").orderBy("a").collect()
    assert [(r["row_in_shard"], r["a"], r["b"]) for r in rows] == [(0, 1, "x"), (0, 2, "y"), (1, 3, None)]
    assert ShardStore(spark, store.url, format, clean=True).keys() == []


def test_store_writes_shards_in_order(spark):
    for format in ("jsonl", "messagepack"):
        store = ShardStore(spark, scratch(spark), format)
        store.write(spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 4).alias("shard"), (F.col("id") * 2).alias("v")), "shard", "pos")
        assert store.keys() == ["0", "1", "2", "3"]
        assert [r["v"] for r in store.get("1")] == [2 * i for i in range(1, 100, 4)]
        hooked = JsonlDriver(spark, store.url, "v long", deser_hook=lambda x: {"v": x["v"] + 1}) if format == "jsonl" else None
        assert hooked is None or {r["v"] % 2 for r in hooked.get_df().collect()} == {1}


@pytest.mark.parametrize("format", ["jsonl", "messagepack"])
def test_store_keeps_integers_beside_nulls_and_odd_keys(spark, format):
    store = ShardStore(spark, scratch(spark), format)
    keys = ["a*b", "{x}", "[1]", "50%", "_under", ".dot", "c d+e", "x/y", "é"]
    rows = [(i, k, v) for k in keys for i, v in enumerate([(1 << 53) + 1, None, 3])]
    df = spark.createDataFrame(rows, "pos long, shard string, v long")
    store.write(df, "shard", "pos")
    store.write(df, "shard", "pos")  # over the first
    assert store.keys() == sorted(keys) and [x["v"] for x in store.get("a*b")] == [(1 << 53) + 1, None, 3]
    got = store.read("v long")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, i, v) for i, k, v in rows), key=str)
    assert {r["shard_key"] for r in store.read("v long", ["a*b", "_under"]).collect()} == {"a*b", "_under"}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {p.rsplit("/", 1)[-1][0] for p, _ in listing(spark, store.url)} & {"_", "."} == set()


def test_whole_objects_and_files(spark):
    from rillflow.sources.files import FilesystemStore, file_paths, read_from_file, write_to_file

    store = FilesystemStore(spark, scratch(spark) + "/", JsonSerializer())
    assert store.keys() == [] and store.set({"a": 1}, "one") == "one"
    store.set([1, 2], "deep/er/two")
    assert store.keys() == ["deep/er/two", "one"] and store.keys(nested=False) == ["one"] and store.get("deep/er/two") == [1, 2]
    with pytest.raises(KeyError):
        store.get("none")
    with pytest.raises(ValueError):
        store.set(1, "../out")
    paths = lambda **how: [r[0].rsplit("/", 1)[-1] for r in file_paths(spark, store.url, **how).orderBy("path").collect()]
    assert paths() == ["deep", "one"] and paths(nested=True, max_keys=1, max_dirs=1) == ["two", "one"]
    assert file_paths(spark, store.url + "/none").count() == 0
    write_to_file(spark, store.url + "/raw", "text")
    assert read_from_file(spark, store.url + "/raw") == b"text" and read_from_file(spark, store.url + "/raw", len) == 4
    assert FilesystemStore(spark, store.url, clean=True).keys() == []


def test_file_driver_opens_files_anywhere(spark):
    from rillflow.sources.drivers import FileDriver

    driver = FileDriver(spark, scratch(spark) + "/deep/file.txt")
    with pytest.raises(FileNotFoundError):
        driver.open("w")
    with driver.open("w", create_if_not_exists=True) as f:
        f.write("one\n")
    with driver.open("a") as f:
        f.write("two\n")
    assert driver.open().read() == "one\ntwo\n" and driver.open("rb").read() == b"one\ntwo\n"


def test_iterables(spark, monkeypatch):
    from rillflow.sources import iterables

    monkeypatch.setattr(iterables, "CHUNK", 4)
    s = iterables.iterable_source(spark, lambda: range(10))
    assert [r["item"] for r in s.collect()] == [*range(10)] and iterables.iterable_source(spark).collect() == []
    assert [r["a"] for r in iterables.iterable_source(spark, [{"a": 1}, {"a": None}], "a long").collect()] == [1, None]
    d = iterables.DummyShardedDriver(spark, 3, 4)
    assert d.keys() == ["0", "1", "2"] and d.get("1") == [4, 5, 6, 7]
    assert sorted(tuple(r) for r in d.get_df().collect()) == [(str(i // 4), i % 4, i) for i in range(12)]


def test_combined_sources(spark):
    from collections import Counter

    from rillflow.sources.drivers import SourceCombiner

    catalog = Catalog()
    for name, n in (("a", 3), ("b", 1), ("c", 2)):
        store = ShardStore(spark, scratch(spark))
        store.set([{"v": f"{name}{i}"} for i in range(n)], "k")
        catalog[name] = Source("jsonl", {"url": store.url, "schema": "v string"})
    c = SourceCombiner(spark, {s: (s, 1) for s in "abc"}, catalog)
    assert [r["v"] for r in c.get_iter()] == ["a0", "b0", "c0", "a1", "c1", "a2"]
    assert [r["v"] for r in c.get_iter("a")] == ["a0", "a1", "a2"] and c.keys("b") == ["k"] and len(list(c.get("c", "k"))) == 2
    drawn = [r["v"] for r in c.get_iter_sampler({"a": 0.5, "b": 0.25, "c": 0.25}, 7)]
    assert Counter(drawn) == Counter(["a0", "a1", "a2", "b0", "c0", "c1"]) and [x for x in drawn if x[0] == "a"] == ["a0", "a1", "a2"]
    assert c.get_df().count() == 6 and [len(x) for x in JsonlDriver(spark, c.get_store("a").url).get_iter(flatten=False)] == [3]


def test_catalogue_tables_must_agree_where_they_meet(spark):
    from rillflow.plans.catalog import intersection_df

    one = Catalog({"a": {1: Source("csv", {"url": "x"})}, "b": {1: Source("csv", {"url": "y"})}})
    other = Catalog({"a": {1: Source("parquet", {"url": "x"})}})
    assert [r["identifier"] for r in intersection_df(one.to_df(spark), other.to_df(spark)).collect()] == ["a"]
    other["b", 1] = Source("csv", {"url": "z"})
    with pytest.raises(Exception, match="differs"):
        intersection_df(one.to_df(spark), other.to_df(spark)).collect()
    assert repr(one["a", 1]) == '{"driver_name": "csv", "driver_kwargs": {"url": "x"}, "metadata": {}}'


def test_artifact_file_store(spark, tmp_path):
    from rillflow.plans.artifacts import ArtifactFileStore

    manager = ArtifactManager(spark, scratch(spark))
    store = ArtifactFileStore(manager, JsonSerializer())
    assert not store.key_exists("m") and store.set({"w": 1}, "m") == "default/m/v0" and store.set({"w": 2}, "m") == "default/m/v1"
    assert store.get("m") == {"w": 2} and store.get("m/v0") == store.get("default/m/v0") == {"w": 1} and store.keys() == ["default/m/v0", "default/m/v1"]
    (tmp_path / "f.txt").write_text("x")
    raw = ArtifactFileStore(manager)
    assert raw.set(str(tmp_path / "f.txt"), "other/n") == "other/n/v0" and raw.get("other/n") == {"f.txt": b"x"}
    with manager.downloaded("n", collection="other") as d:
        assert [p.name for p in d.rglob("*.txt")] == ["f.txt"]
    assert (manager.download_collection(str(tmp_path / "all"), "default") / "m").is_dir()


def test_arrays_are_written_read_and_fetched(spark):
    from rillflow.sources.drivers import write_array

    url = scratch(spark)
    write_array(spark, url, "g/x", np.arange(12).reshape(3, 4), [2, 3], {"unit": "m"})
    write_array(spark, url, "y", np.ones(3, "<f4"))
    driver = ZarrDriver(spark, url)
    assert [(r["key"], list(r["data"]), list(r["shape"])) for r in driver.get_iter()] == [("g/x", [*map(float, range(12))], [3, 4]), ("y", [1.0] * 3, [3])]
    assert list(driver.get_iter(lambda r: [r["key"]] * 2, flatten=True)) == ["g/x", "g/x", "y", "y"]
    assert sorted(tuple(r) for r in driver.fetched(lambda r: {"key": r["key"], "n": len(r["data"])}, "key string, n long").collect()) == [("g/x", 12), ("y", 3)]


def test_driver_with_a_store_is_an_error(spark):
    with pytest.raises(ValueError):
        JsonlDriver(spark, "x", store=object())
    assert {"csv", "parquet", "feather", "excel", "file", "jsonl", "messagepack", "zarr", "directory", "source_combiner"} <= set(list_driver_names())


def test_listing_and_directory(spark, tmp_path):
    for p in ("a/x.txt", "a/y.txt", "b/x.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(p)
    assert len(listing(spark, f"file://{tmp_path}")) == 2 and len(listing(spark, f"file://{tmp_path}", nested=True)) == 3
    assert listing(spark, f"file://{tmp_path}/none") == []
    assert DirectoryDriver(spark, f"file://{tmp_path}").keys() == ["a/x.txt", "a/y.txt", "b/x.txt"]


def test_zarr(spark, tmp_path):
    import json

    data = np.arange(12, dtype="<i2").reshape(3, 4)
    for k in ("one", "two"):
        (tmp_path / k).mkdir()
        (tmp_path / k / ".zarray").write_text(json.dumps({"shape": [3, 4], "chunks": [2, 4], "dtype": "<i2", "compressor": None, "order": "C", "fill_value": 0}))
        (tmp_path / k / ".zattrs").write_text(json.dumps({"name": k}))
        (tmp_path / k / "0.0").write_bytes(data[:2].tobytes())
        (tmp_path / k / "1.0").write_bytes(np.vstack([data[2:], data[:1]]).tobytes())
    driver = ZarrDriver(spark, f"file://{tmp_path}")
    assert driver.keys() == ["one", "two"]
    got = driver.get_df().orderBy("key").collect()
    assert [r["key"] for r in got] == ["one", "two"] and got[0]["data"] == data.ravel().tolist() and got[1]["attrs"] == {"name": '"two"'}


def test_keys(spark):
    cases = {"a": "a/", "/a/": "a/", "a/ab/0.0/": "a/ab/0.0", "/a/ab/0.0": "a/ab/0.0", "a/.zarray": "a/.zarray", "s/file.ext": "s/file.ext/", " a ": "a/", "": ""}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert df.where(keys.normalize_key(F.col("raw")) != F.col("want")).count() == 0
    row = spark.range(1).select(keys.zero_padded(F.lit(100), 2), keys.without_gz(F.lit("a.gz")), keys.protocol(F.lit("gs://x/y")), keys.protocol(F.lit("/x")), keys.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)))).first()
    assert list(row) == ["100", "a", "gs", "", {"a": 1, "b": 2}]


def sources():
    s = lambda x: Source("csv", {"url": x})
    a, b = Catalog(), Catalog()
    for k in ("s0", "s1", "s2"):
        a[k] = s(k)
    for k in ("s0", "s1", "s3"):
        b[k] = s(k)
    b["s1"] = s("s1")
    return a, b


def test_catalog_algebra():
    a, b = sources()
    both, one = a.intersection(b), a.difference(b)
    assert set(both.all()) == {("s0", 1), ("s1", 1)} and set(one.all()) == {("s2", 1), ("s3", 1), ("s1", 2)}
    assert both.join(one) == a.union(b) and len(a.union(b)) == 4
    with pytest.raises(ValueError):
        a.join(b)
    assert a.slice(["s1"]).keys() == ["s1"] and a.filter(lambda s: s.driver_kwargs["url"] == "s2").keys() == ["s2"]
    with pytest.raises(KeyError):
        a.slice(["none"])
    assert b["s1", -1] == b["s1", 2] and ("s1", -1) in b and ("s1", 3) not in b
    del b["s1", 2], b["s1", 1]
    assert "s1" not in b and a.copy() == a and repr(Catalog({"B": a.entries["s0"], "a": a.entries["s0"]})) == "['a', 'B']"
    with pytest.raises(TypeError):
        a[3]


def test_catalog_yaml_and_drivers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    text = f"!Catalog\nversion: 0.4.0\nsources:\n- !Source\n  identifier: cs\n  driver_name: csv\n  driver_kwargs:\n    url: {tmp_path}/t.csv\n"
    cat = Catalog.from_str(text)
    assert cat["cs", -1].get_driver(spark).get_df().first()["a"] == 1
    source = Source("csv", {"url": "x", "storage_options": {"pays": True, "cache": {"dir": "a", "n": 1}}})
    assert source.get_driver(spark, storage_options={"cache": {"dir": "b"}}).storage_options == {"pays": True, "cache": {"dir": "b", "n": 1}}
    with pytest.raises(ValueError):
        Source("none").get_driver(spark)
    combiner = DRIVERS["source_combiner"](spark, {"x": ("cs", -1), "y": ("cs", 1)}, catalog=cat)
    assert {r["subset"] for r in combiner.get_df().collect()} == {"x", "y"}
    assert cat.to_df(spark).count() == 1


def test_artifacts(spark, tmp_path):
    store = ArtifactManager(spark, scratch(spark))
    store.active_collection = "exp-1"
    with pytest.raises(ValueError):
        store.active_collection = "no/name"
    (tmp_path / "baz.txt").write_text("one")
    assert store.log_files("foo", str(tmp_path / "baz.txt")).metadata["version"] == 0
    with store.log_folder("foo") as d:
        (d / "new.txt").write_text("two")
    with store.log_folder("empty"):
        pass
    assert store.versions("foo") == [0, 1] and not store.exists("empty") and store.collections() == ["exp-1"]
    assert set(store.to_catalog().all()) == {("exp-1/foo", 1), ("exp-1/foo", 2)}
    assert (store.download("foo", str(tmp_path / "out"), 0) / "baz.txt").read_text() == "one"


def test_count_windows_over_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    for i, rows in enumerate(([3, 4, 5], [0, 1, 2], [6, 7, 8, 9])):  # the second file fills the gap before the first
        (source / f"{i}.json").write_text("\n".join(f'{{"pos": {r}, "v": {r}}}' for r in rows))
    windows = CountWindows(scratch(spark), lambda df, e: out.extend((r["win_start"], list(r["items"])) for r in df.orderBy("win_start").collect()), 4, 2)
    stream = spark.readStream.schema("pos long, v long").option("maxFilesPerTrigger", 1).json(f"file://{source}")
    query = stream.writeStream.foreachBatch(windows).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert out == [(s, list(range(s, s + 4))) for s in (0, 2, 4, 6)]
