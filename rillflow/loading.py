"""Streams for data loaders: files in order, and an iterable over them that other processes can use."""

from __future__ import annotations

import os
from collections.abc import Iterator

from .operators.position import scratch

try:  # optional: without it the iterable is a plain one
    from torch.utils.data import IterableDataset, get_worker_info
except ImportError:
    IterableDataset, get_worker_info = object, lambda: None


class Loaded(IterableDataset):
    """Rows as dictionaries, in order, from the Parquet files of a folder; it can be pickled and iterated many times.

    A worker of a loader takes every workers-th row where the stream was split late. A rank or worker that the stream is
    not split for is an error.
    """

    def __init__(self, path: str, lineage: tuple[str, ...], ranks: bool, workers: bool):
        self.path, self.lineage, self.ranks, self.workers = path, lineage, ranks, workers

    def __iter__(self) -> Iterator[dict]:
        from pyarrow import dataset, fs

        from .stream import SplittingError

        info = get_worker_info()
        worker, workers = (info.id, info.num_workers) if info else (0, 1)
        late = "split_worker_late" in self.lineage
        if self.ranks and int(os.environ.get("WORLD_SIZE", "1")) > 1 and "split_rank" not in self.lineage:
            raise SplittingError("split the stream by rank first")
        if self.workers and workers > 1 and not late and "split_worker" not in self.lineage:
            raise SplittingError("split the stream by worker first")
        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        at = 0
        for file in files:
            for batch in dataset.dataset(file, filesystem=system).to_batches(batch_size=1000):
                first = (worker - at) % workers if late else 0
                at += batch.num_rows
                yield from batch.take(list(range(first, batch.num_rows, workers))).to_pylist() if late else batch.to_pylist()


def loader(stream, ranks: bool = True, workers: bool = True, columns: list[str] | None = None) -> Loaded:
    """The stream, written in order to the shared folder: a file a partition, numbered in order."""
    path = scratch(stream.df.sparkSession)
    rows = stream.df.orderBy(*stream.order)
    (rows.select(*columns) if columns else rows).write.parquet(path)
    return Loaded(path, stream.lineage, ranks, workers)
