"""Stream operators against known values and plain simulations."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow import stream as streams
from rillflow.functions.statistics import randomness
from rillflow.operators import limits, mixing, monitoring, shuffling, windows
from rillflow.operators.elementwise import flattened, map_partition, truthy
from rillflow.operators.position import with_position
from rillflow.stream import SplittingError, Stream


@pytest.fixture(scope="module")
def ten(spark):
    return spark.range(10).select(F.col("id").alias("pos"), F.col("id").alias("v"))


def items(df, key):
    return [list(r["items"]) for r in df.orderBy(key).collect()]


def plain_windows(n, w, s, drop, least, fill):
    if n < w:
        return [] if drop or not n else [list(range(n)) + [None] * (w - n) * fill]
    out = []
    for a in range(0, n, s):
        got = list(range(a, min(a + w, n)))
        if len(got) == w or not drop and (fill or len(got) >= least):
            out.append(got + [None] * ((w - len(got)) * fill))
    return out


@pytest.mark.parametrize("n", [0, 3, 10])
@pytest.mark.parametrize("how", [(5, 1, True, 1, False), (5, 5, True, 1, False), (5, 2, False, 2, False), (4, 3, False, 1, True), (4, 3, False, 3, False), (3, 2, False, 1, False)])
def test_sliding(spark, n, how):
    w, s, drop, least, fill = how
    df = spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    assert items(windows.sliding(df, w, s, drop, least, fill), "win_start") == plain_windows(n, w, s, drop, least, fill)


@pytest.mark.parametrize("bad", [(1, 1, 1), (5, 6, 1), (5, 0, 1), (5, 1, 5), (5, 1, 0)])
def test_sliding_rejects(ten, bad):
    with pytest.raises(ValueError):
        windows.sliding(ten, bad[0], bad[1], least=bad[2])


def test_batched(ten):
    assert items(windows.batched(ten, 3), "batch_id") == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert items(windows.batched(ten, 3, drop_last=False), "batch_id")[-1] == [9]
    assert items(windows.batched(ten, 5), "batch_id") == items(windows.sliding(ten, 5, 5), "win_start")
    assert windows.batched(ten, 0).count() == 0


def test_take_loop_and_numbers(ten):
    assert limits.take(ten, 4).count() == 4 and limits.take(ten, 40).count() == 10 and limits.take(ten, None).count() == 10 and limits.take(ten, 0).count() == 0
    with pytest.raises(ValueError):
        limits.take(ten, -1)
    assert [r["v"] for r in limits.loop(ten, 2).orderBy("pos").collect()] == [*range(10)] * 2 and limits.loop(ten, 0).count() == 0
    assert [r["v"] for r in limits.loop_take(ten, 13).orderBy("pos").collect()] == [*range(10), 0, 1, 2]
    assert limits.loop_take(ten.limit(0), 13).count() == 0
    wide = ten.sparkSession.range(101).select(F.col("id").alias("pos"))
    assert [r["idx"] for r in limits.numbered(wide, 2).orderBy("pos").collect()][-2:] == ["99", "100"]


@pytest.mark.parametrize("rank", range(4))
def test_split(spark, rank):
    df = spark.range(100).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    assert [r["v"] for r in limits.split(df, rank, 4).orderBy("pos").collect()] == [*range(100)][rank::4]


def test_positions_are_dense_over_unordered_rows(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k")).repartition(7)
    got = with_position(df, ["k"]).orderBy("k").collect()
    assert [r["pos"] for r in got] == [*range(5000)]
    assert "SinglePartition" not in with_position(df, ["k"]).select("k", "pos")._jdf.queryExecution().executedPlan().toString().split("_off")[0]


def test_flatten_and_truth(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, []), (2, None), (3, [3])], "pos long, a array<int>")
    assert [tuple(r) for r in flattened(df, "a").orderBy("pos", "inner_pos").collect()] == [(0, 0, 1), (0, 1, 2), (3, 0, 3)]
    odd = spark.createDataFrame([(0,), (None,), (2,)], "x int")
    assert [r[0] for r in odd.select(truthy(F.col("x"), "int")).collect()] == [False, False, True]


def simulated_buffer(n, size, initial, seed):
    rng, out, buf, source = random.Random(seed), [], [], iter(range(n))
    for x in source:
        buf.append(x)
        if len(buf) < size:
            buf += [y for y in [next(source, None)] if y is not None]
        if len(buf) >= min(size, initial):
            k = rng.randint(0, len(buf) - 1)
            buf[k], buf[-1] = buf[-1], buf[k]
            out.append(buf.pop())
    while buf:
        k = rng.randint(0, len(buf) - 1)
        buf[k], buf[-1] = buf[-1], buf[k]
        out.append(buf.pop())
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.integers(2, 60), st.integers(0, 80), st.integers(0, 9))
def test_buffer_order(n, size, initial, seed):
    got = shuffling.buffer_order(n, size, initial, seed)
    assert got == simulated_buffer(n, size, initial, seed) and sorted(got) == [*range(n)]
    assert all(i - o <= size - 1 for o, i in enumerate(got))


def test_shuffles_are_permutations(ten):
    for df in (shuffling.hash_shuffle(ten, 1), shuffling.block_shuffle(ten, 4, 1), shuffling.buffer_shuffle(ten, 4, 2, 1)):
        rows = df.orderBy("pos").collect()
        assert [r["pos"] for r in rows] == [*range(10)] and sorted(r["v"] for r in rows) == [*range(10)]
    assert all(abs(r["pos"] - r["in_pos"]) < 4 for r in shuffling.block_shuffle(ten, 4, 1).collect())


def simulated_turns(sizes):
    alive, at, out, i = list(range(len(sizes))), [0] * len(sizes), [], 0
    while alive:
        s = alive[i]
        if at[s] < sizes[s]:
            out.append((s, at[s]))
            at[s] += 1
            i = (i + 1) % len(alive)
        else:
            alive.remove(s)
            i = 0
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 25), max_size=6))
def test_round_robin_segments(sizes):
    out = {}
    for s, lo, hi, base, alive, rank in mixing.round_robin_segments(sizes):
        for i in range(lo, hi):
            assert out.setdefault(base + (i - lo) * alive + rank, (s, i)) == (s, i)
    assert [out[k] for k in sorted(out)] == simulated_turns(sizes) and sorted(out) == [*range(sum(sizes))]


def drawn(plan):
    return [tuple(r) for chunk in plan for r in chunk.tolist()]


@pytest.mark.parametrize("chunk", [500_000, 50])
def test_schedules_have_the_known_counts(monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    plan = mixing.Sampling([100, 26, 200], None, 42)
    assert len(drawn(plan)) == 579 and plan.restarts == [1, 7, 1] and sum(plan.samples) == 579
    draw = random.Random(42)
    sizes = [sum(draw.randint(32, 64) for _ in range(n)) for n in (5, 3, 10)]
    assert sizes == [214, 115, 453]
    plan = mixing.Sampling(sizes, [0.35, 0.6, 0.05], 42, 4)
    rows = drawn(plan)
    assert plan.restarts == [1, 4, 0] and plan.samples == [sum(s == k for s, _, _ in rows) for k in range(3)] == [268, 460, 40]


def test_sampling_without_oversampling(monkeypatch):
    for chunk in (500_000, 3):
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        got = [(s, i) for s, _, i in drawn(mixing.without_oversampling([4, 3], [0.4, 0.6], 1))]
        assert sorted(got) == [(0, i) for i in range(4)] + [(1, i) for i in range(3)]
        assert [i for s, i in got if s == 0] == [*range(4)]
    with pytest.raises(ValueError):
        drawn(mixing.without_oversampling([1, 1], [0.5, 0.6]))


def test_sampled_streams_tell_their_counts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 60)
    df = spark.range(326).select(F.when(F.col("id") < 100, "a").when(F.col("id") < 126, "b").otherwise("c").alias("s"), (F.col("id") - F.when(F.col("id") < 100, 0).when(F.col("id") < 126, 100).otherwise(126)).alias("row_idx"))
    mix, counts = mixing.sampled_with_counts(df, "s", None, 42)
    assert {k: r for k, (_, r) in counts.items()} == {"a": 1, "b": 7, "c": 1} and mix.count() == 579
    assert sorted(r["pos"] for r in mix.collect()) == [*range(579)]
    assert {r["s"]: r["n"] for r in mix.groupBy("s").agg(F.count("*").alias("n")).collect()} == {k: n for k, (n, _) in counts.items()}


def test_monitor_crosses_blocks(spark):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, at + datetime.timedelta(seconds=i * i)) for i in range(20)], "pos long, t timestamp")
    for block in (3, 7, 1000):
        got = monitoring.monitor(df, "t", F.lit(1024), 4, monitoring.MetricsConf(throughput_unit="KB"), block=block).orderBy("pos").collect()
        assert [tuple(r) for r in got] == [(i, round(4 / (i * i - (i - 3) ** 2), 2), round(3 / (i * i - (i - 3) ** 2), 2)) for i in range(3, 20)]


def test_stream_is_lazy_and_fluent(spark):
    s = Stream(spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), ["k"])
    got = s.filter("v > 2").map(w=F.col("v") * 2).take(10).zip_index(3).collect()
    assert [r["idx"] for r in got] == [f"{i:03d}" for i in range(10)] and all(r["w"] > 4 for r in got)
    assert [r["k"] for r in s.split_by_rank(1, 4).split_by_worker(0, 2).collect()] == [*range(100)][1::4][::2]
    assert len(s.loop().take(250).collect()) == 250
    with pytest.raises(ValueError):
        s.loop().collect()
    with pytest.raises(SplittingError):
        s.check_split(ranks=2)
    assert s.split_by_rank(0, 2).check_split(ranks=2)
    assert sorted(r["k"] for r in s.shuffle(size=10, seed=3, exact=True).collect()) == [*range(100)]
    mixed = streams.round_robin({"a": s.take(3), "b": s.take(1)}).collect()
    assert [r["source"] for r in mixed] == ["a", "b", "a", "a"]
    s.join()


def test_map_partition(spark):
    df = spark.range(20).repartition(3)
    assert sum(r["x"] for r in map_partition(df, lambda rows: ({"x": r["id"] * 2} for r in rows), "x long").collect()) == 380


def test_functions_keep_integers_beside_nulls(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(0, big, "a", [1, None]), (1, None, None, None)], "pos long, v long, t string, l array<int>")
    got = map_partition(df, lambda rows: ({"pos": r["pos"], "v": r["v"], "l": r["l"]} for r in rows), "pos long, v long, l array<int>")
    assert sorted(map(tuple, got.collect())) == [(0, big, [1, None]), (1, None, None)]
    s = Stream(df, ["pos"], True).map(lambda r, by: {"w": r["v"] and r["v"] + by}, "w long", by=1)
    assert [tuple(r) for r in s.collect()] == [(0, big + 1), (1, None)]
    assert [r["pos"] for r in Stream(df, ["pos"], True).filter(lambda r: r["v"]).collect()] == [0]


def test_functions_that_wait_keep_the_order(spark):
    import time

    s = Stream(spark.range(40).select(F.col("id").alias("pos")).coalesce(1), ["pos"], True)
    began = time.time()
    slow = s.async_map(lambda r: (time.sleep(0.1), {"v": 1})[1], "v long", buffer=40, max_workers=40)
    assert [r["pos"] for r in slow.df.collect()] == [*range(40)] and time.time() - began < 4
    with pytest.raises(ValueError):
        s.async_map(lambda r: r, "v long", executor="unheard of")


def test_source_is_bound_again(spark):
    ten, five = (Stream(spark.range(n).select(F.col("id").alias("k")), ["k"]) for n in (10, 5))
    s = ten.filter("k % 2 = 0").map(v=F.col("k") * 3).take(4)
    assert [r["v"] for r in s.collect()] == [0, 6, 12, 18] and [r["v"] for r in s.source_(five).collect()] == [0, 6, 12]
    assert [r["v"] for r in s.source_(five).source_(ten).collect()] == [0, 6, 12, 18]


def test_monitor_changes_nothing_and_calls_back(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i), i) for i in range(8)]
    seen = []
    s = Stream(spark.createDataFrame(rows, "pos long, t timestamp, v long"), ["pos"], True).monitor(seen.append, "t", F.lit(1 << 20), window=5).map(w=F.col("v") + 1)
    assert [r["w"] for r in s.collect()] == [*range(1, 9)]
    assert seen == [{"IOPS number/s": 1.25, "throughput MB/s": 1.0}] * 4
    assert len(list(s)) == 8 and len(seen) == 8


def test_nodes(spark):
    class Doubled:
        def __init__(self, by):
            self.by = by

        def __call__(self, df):
            return df.withColumn("v", F.col("k") * self.by)

    class Bad:
        def __init__(self, source):
            pass

    s = Stream(spark.range(3).select(F.col("id").alias("k")), ["k"])
    assert [r["v"] for r in s.compose(Doubled, 2).collect()] == [0, 2, 4] and s.compose(lambda df: df.limit(1)).collect()
    with pytest.raises(ValueError):
        s.compose(Bad)


def test_loader_reads_in_order_and_checks_splits(spark, monkeypatch):
    import pickle

    from rillflow import loading

    s = Stream(spark.range(100).repartition(7).select(F.col("id").alias("k")), ["k"])
    whole = pickle.loads(pickle.dumps(s.to_torch_iterable()))
    assert [r["k"] for r in whole] == [*range(100)] == [r["k"] for r in whole]

    class Info:
        id, num_workers = 1, 3

    monkeypatch.setattr(loading, "get_worker_info", Info)
    with pytest.raises(SplittingError):
        next(iter(whole))
    assert [r["k"] for r in s.split_by_worker().to_loader()] == [*range(100)][1::3]
    monkeypatch.setenv("WORLD_SIZE", "2")
    with pytest.raises(SplittingError):
        next(iter(s.split_by_worker().to_loader()))
    assert len(list(s.split_by_rank(0, 2).split_by_worker().to_loader())) == 17
    assert len(list(s.to_loader(False, False))) == 100


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_kendall_counts_every_pair(spark, ranges):
    from rillflow.functions.statistics import balance, kendall_tau

    draw = random.Random(3)
    for n, values in ((0, 5), (1, 5), (60, 8), (150, 1000)):
        rows = [(draw.randrange(values), draw.randrange(values)) for _ in range(n)]
        signs = [(y2 > y1) - (y2 < y1) for x1, y1 in rows for x2, y2 in rows if x1 < x2]
        df = spark.createDataFrame([*rows, (None, 1), (1, None)], "x int, y int")
        got = kendall_tau(df, "x", "y", ranges).first()[0]
        assert got is None and not signs or abs(got - sum(signs) / len(signs)) < 1e-12
        import numpy as np

        assert balance(np.array([x for x, _ in rows], int), np.array([y for _, y in rows], int)) == sum(signs)


def test_randomness_falls_with_the_buffer():
    fixed, mixed = randomness(5, 10, 1, 0, 15), randomness(5, 10, 50, 50, 15)
    assert 1 > fixed > mixed > 0


def test_intermediates_go_when_asked(spark, ten):
    from rillflow.operators.position import cleaned, scratch, settled
    from rillflow.sources.shards import hadoop

    settled(ten)
    root = scratch(spark).rsplit("/", 1)[0]
    fs, path = hadoop(spark, root)
    assert fs.exists(path) and f"rillflow-{spark.sparkContext.applicationId}" in root
    cleaned(spark)
    assert not fs.exists(path)
    assert settled(ten).count() == 10


def test_a_seed_is_drawn_where_none_is_given(ten):
    assert shuffling.seeded(3) == 3 and shuffling.seeded(None) != shuffling.seeded(None)
    assert sorted(r["v"] for r in shuffling.hash_shuffle(ten, None).collect()) == [*range(10)]


def test_sizes_of_items():
    import numpy as np

    assert monitoring.getsize(np.zeros(3)) == 24 and monitoring.getsize("abc") > 3
