"""Stream: a DataFrame with a total order, and the operators as methods."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import wraps

from pyspark.sql import Column, DataFrame

from .operators import elementwise, limits, mixing, monitoring, shuffling, windows
from .operators.position import with_position


class SplittingError(RuntimeError):
    """A stream goes to several ranks or workers, but nothing in it splits it among them."""


def _step(method):
    """Record the call, so that source_ can make it again on another stream."""

    @wraps(method)
    def call(self, *args, **kwargs):
        out = method(self, *args, **kwargs)
        return replace(out, steps=(*self.steps, lambda s: call(s, *args, **kwargs)))

    return call


@dataclass(frozen=True)
class Stream:
    """Each method gives a new stream, and rows are computed when the result is used. But a dense position (indexed, and
    what needs it: batches, windows, take, loop, splits, shuffles) is computed and written to the shared folder when it is
    asked for. order is unique; dense tells whether it is the dense column pos."""

    df: DataFrame
    order: list[str]
    dense: bool = False
    lineage: tuple[str, ...] = ()
    steps: tuple[Callable[[Stream], Stream], ...] = field(default=(), compare=False, repr=False)
    watchers: tuple[Callable[[], object], ...] = field(default=(), compare=False, repr=False)

    def _with(self, df: DataFrame, op: str, order: list[str] | None = None, dense: bool = True) -> Stream:
        return Stream(df, order or ["pos"], dense, (*self.lineage, op), self.steps, self.watchers)

    def source_(self, source: Stream) -> Stream:
        """The same operators on another source."""
        for step in self.steps:
            source = step(source)
        return source

    def indexed(self) -> Stream:
        """The stream with a dense pos; only computed where an operator needs it."""
        if self.dense:
            return self
        df = self.df.drop("pos") if "pos" in self.df.columns and self.order != ["pos"] else self.df
        if self.order == ["pos"]:
            df = with_position(df.withColumnRenamed("pos", "_was"), ["_was"]).drop("_was")
        else:
            df = with_position(df, self.order)
        return replace(self, df=df, order=["pos"], dense=True)

    @_step
    def map(self, function: Callable[..., dict] | None = None, schema: str | None = None, /, **columns) -> Stream:
        """Columns added or replaced by expressions; or a function of rows as dictionaries, with the schema of what it
        gives and keyword arguments for it."""
        if function is None:
            return self._with(elementwise.mapped(self.df, **columns), "map", self.order, self.dense)
        return self._by_rows("map", elementwise.map_rows, function, schema, **columns)

    def _by_rows(self, op: str, how: Callable, function: Callable, schema: str | None, **kwargs) -> Stream:
        """A function over rows; the order columns pass by it."""
        if schema is None:
            raise ValueError("a function needs the schema of what it gives")
        from pyspark.sql.types import StructType

        order, inner = self.order, elementwise.schema_of(schema)
        both = StructType([*[self.df.schema[c] for c in order], *[f for f in inner.fields if f.name not in order]])

        def run(row, **given):
            return {**function({k: v for k, v in row.items() if k not in hidden}, **given), **{c: row[c] for c in order}}

        hidden = {"pos"} if self.dense else set()
        return self._with(how(self.df, run, both, **kwargs), op, order, self.dense)

    def async_map(self, function: Callable[..., dict], schema: str, buffer: int = 100, max_workers: int = 8, executor: str | None = None, **kwargs) -> Stream:
        """map for a function that waits: every task runs max_workers calls at once; the order stays. Executors are Spark's,
        so executor is None or "thread"."""
        if executor not in (None, "thread"):
            raise ValueError(f"unknown executor {executor!r}")
        waiting = lambda df, f, s, **kw: elementwise.map_waiting(df, f, s, max_workers, buffer, **kw)
        return _step(lambda s: s._by_rows("async_map", waiting, function, schema, **kwargs))(self)

    dask_map = numba_map = map

    @_step
    def materialize(self) -> Stream:
        """The stream as it is, computed now and written to the shared folder."""
        from .operators.position import settled

        return self._with(settled(self.df), "materialize", self.order, self.dense)

    materialize_dask = materialize

    @_step
    def filter(self, predicate: Column | str | Callable[[dict], object]) -> Stream:
        """Rows for which a condition holds, or for which a function of the row as a dictionary is true."""
        if callable(predicate) and not isinstance(predicate, Column):
            return self._with(elementwise.filter_rows(self.df, predicate), "filter", self.order, False)
        return self._with(elementwise.filtered(self.df, predicate), "filter", self.order, False)

    @_step
    def flatten(self, items: str, value: str = "value") -> Stream:
        s = self.indexed()
        return s._with(elementwise.flattened(s.df, items, value), "flatten", ["pos", "inner_pos"], False)

    @_step
    def to(self, function: Callable[..., DataFrame], *args, **kwargs) -> Stream:
        """Any function of the DataFrame that keeps the order columns."""
        return self._with(function(self.df, *args, **kwargs), f"to:{getattr(function, '__name__', 'function')}", self.order, False)

    @_step
    def map_partition(self, function: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> Stream:
        """A function over the rows of each partition; what it gives has the order columns."""
        return self._with(elementwise.map_partition(self.df, function, schema), "map_partition", self.order, False)

    def compose(self, node: Callable, *args, **kwargs) -> Stream:
        """to, or a class that is made with the arguments and then called with the DataFrame; its __init__ must not take a
        source, which it is given later."""
        if inspect.isclass(node):
            if "__init__" in vars(node) and "source" in inspect.signature(node).parameters:
                raise ValueError("a node must not take its source when it is made")
            return self.to(node(*args, **kwargs))
        return self.to(node, *args, **kwargs)

    @_step
    def batched(self, size: int, collation: list[Column] | None = None, drop_last: bool = True) -> Stream:
        s = self.indexed()
        return s._with(windows.batched(s.df, size, collation, drop_last), "batched", ["batch_id"], False)

    @_step
    def sliding(self, window: int, deepcopy: bool = True, **how) -> Stream:
        """deepcopy is accepted and has no meaning: rows cannot change."""
        s = self.indexed()
        return s._with(windows.sliding(s.df, window, **how), "sliding", ["win_start"], False)

    @_step
    def take(self, n: int | None) -> Stream:
        s = self.indexed()
        return s._with(limits.take(s.df, n), "take")

    @_step
    def loop(self, n: int | None = None) -> Stream:
        s = self.indexed()
        if n is None:
            return _Endless(s.df, s.order, True, (*s.lineage, "loop"), s.steps, s.watchers)
        return s._with(limits.loop(s.df, n), "loop")

    @_step
    def zip_index(self, pad: int | None = None) -> Stream:
        s = self.indexed()
        return s._with(limits.numbered(s.df, pad), "zip_index")

    @_step
    def split_by_rank(self, rank: int, size: int) -> Stream:
        s = self.indexed()
        return s._with(limits.split(s.df, rank, size), "split_rank")

    @_step
    def split_by_worker(self, worker: int | None = None, workers: int = 1) -> Stream:
        """Every workers-th row; without a worker the loader that iterates the stream takes its own rows by its own number."""
        if worker is None:
            return self._with(self.df, "split_worker_late", self.order, self.dense)
        s = self.indexed()
        return s._with(limits.split(s.df, worker, workers), "split_worker")

    @_step
    def shuffle(self, size: int | None = None, seed: object = 0, initial: int = 100, exact: bool = False) -> Stream:
        """Without size all rows by hash; with size in blocks of it; exact: the seeded buffer, one sequence of draws."""
        s = self.indexed()
        if exact:
            return s._with(shuffling.buffer_shuffle(s.df, size, initial, seed).drop("in_pos"), "shuffle")
        df = shuffling.hash_shuffle(s.df, seed) if size is None else shuffling.block_shuffle(s.df, size, seed)
        return s._with(df.drop("in_pos"), "shuffle")

    @_step
    def metrics(self, time: str, size: Column, **how) -> Stream:
        """The metrics of monitor as a stream of their own."""
        s = self.indexed()
        return s._with(monitoring.monitor(s.df, time, size, **how), "metrics", ["pos"], False)

    def monitor(self, callback: Callable[[dict], None], time: str, size: Column, **how) -> Stream:
        """The stream unchanged. Each time it runs in the driver (iteration, collect), callback gets the metrics of every row
        from the window's length on, as a dictionary."""
        report = lambda: [callback(r) for r in monitoring.reports(self.metrics(time, size, **how).df, how.get("conf"), how.get("prefix", ""))]
        again = lambda s: s.monitor(callback, time, size, **how)
        return replace(self, lineage=(*self.lineage, "monitor"), steps=(*self.steps, again), watchers=(*self.watchers, report))

    def tqdm(self, name: str = "rows") -> tuple[Stream, object]:
        """The stream unchanged and an Observation that has its count after an action."""
        from pyspark.sql import Observation
        from pyspark.sql import functions as F

        seen = Observation(name)
        return replace(self, df=self.df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen

    def check_split(self, ranks: int = 1, workers: int = 1) -> Stream:
        """Raise unless the lineage splits the stream where there are several ranks or workers."""
        by_worker = {"split_worker", "split_worker_late"} & set(self.lineage)
        if ranks > 1 and "split_rank" not in self.lineage or workers > 1 and not by_worker:
            raise SplittingError("split the stream by rank and worker first")
        return self

    def to_loader(self, enforce_rank_check: bool = True, enforce_worker_check: bool = True, columns: list[str] | None = None):
        """The stream for a data loader: an iterable that may go to other processes, which need no Spark. See loading."""
        from .loading import loader

        return loader(self, enforce_rank_check, enforce_worker_check, columns)

    to_torch_iterable = to_loader

    def _told(self) -> None:
        for report in self.watchers:
            report()

    def collect(self) -> list:
        rows = self.df.orderBy(*self.order).collect()
        self._told()
        return rows

    def join(self) -> None:
        """Run the stream and keep nothing."""
        self.df.write.format("noop").mode("overwrite").save()
        self._told()

    def __iter__(self) -> Iterator:
        yield from self.df.orderBy(*self.order).toLocalIterator(prefetchPartitions=True)
        self._told()


class _Endless(Stream):
    """A loop without end; only a take can follow."""

    @_step
    def take(self, n: int) -> Stream:
        return Stream(limits.loop_take(self.df, n), ["pos"], True, (*self.lineage, "take"), self.steps, self.watchers)

    def collect(self):
        raise ValueError("an endless loop needs a take")

    join = __iter__ = collect


def round_robin(streams: dict[str, Stream]) -> Stream:
    """One row of each live stream in turn, the streams in the order given; source names a row's stream."""
    df = _stacked(streams)
    return Stream(mixing.round_robin(df, "source", sources=list(streams)), ["pos"], True, ("round_robin",))


def interleaved(streams: dict[str, Stream]) -> Stream:
    """The first rows of all streams in the order given, then the second ones, passing over streams that have ended."""
    from pyspark.sql import functions as F

    order = F.element_at(F.create_map(*[x for i, s in enumerate(streams) for x in (F.lit(s), F.lit(i))]), F.col("source"))
    df = mixing.interleaved(_stacked(streams).withColumn("_ordinal", order), "_ordinal").drop("_ordinal")
    return Stream(df, ["pos"], True, ("interleaved",))


def sampled(streams: dict[str, Stream], probas: dict[str, float] | None = None, **how) -> Stream:
    """Streams drawn by weight, with oversampling of those that end early."""
    return Stream(mixing.sampled(_stacked(streams), "source", probas, sources=list(streams), **how), ["pos"], True, ("sampled",))


def sampled_once(streams: dict[str, Stream], probas: dict[str, float] | None = None, seed: object = 42) -> Stream:
    """Streams drawn by weight, each row once."""
    return Stream(mixing.sampled_once(_stacked(streams), "source", probas, seed, sources=list(streams)), ["pos"], True, ("sampled_once",))


def _stacked(streams: dict[str, Stream]) -> DataFrame:
    from pyspark.sql import functions as F

    out = None
    for name, s in streams.items():
        part = s.indexed().df.withColumnRenamed("pos", "row_idx").withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
