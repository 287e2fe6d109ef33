"""Recorded datasets read page by page: a data source of its own (SRC13, SRC14).

A dataset is a folder ``batch=<id>`` of page files ``<number>.jsonl`` under a path that every executor reaches through
Arrow's file systems. Each dataset is a partition; its pages are read in order, and reading stops where an item
says that the source blocked the reader, or after ``most`` items. Filters on ``batch`` choose the folders before
anything is read.

    paged.register(spark)
    spark.read.format("paged_dataset").option("path", path).load().filter("batch = '7'")
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..shipping import ship

SCHEMA = "batch string, page int, at int, item string, blocked boolean"
ARROW = pa.schema([("batch", pa.string()), ("page", pa.int32()), ("at", pa.int32()), ("item", pa.string()), ("blocked", pa.bool_())])


@dataclass
class Dataset(InputPartition):
    batch: str
    pages: list[tuple[int, str]]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most, self.size = options["path"], int(options.get("most", 1000)), int(options.get("size", 500))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what chooses datasets; gives the rest back."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("batch",):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == ("batch",):
                found = set(f.value)
            else:
                yield f
                continue
            self.wanted = found if self.wanted is None else self.wanted & found

    def partitions(self) -> list[Dataset]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        held: dict[str, list[tuple[int, str]]] = {}
        for folder in store.get_file_info(fs.FileSelector(root)):
            batch = folder.base_name.removeprefix("batch=")
            if folder.type == fs.FileType.Directory and folder.base_name.startswith("batch=") and (self.wanted is None or batch in self.wanted):
                for f in store.get_file_info(fs.FileSelector(folder.path)):
                    if f.base_name.endswith(".jsonl"):
                        held.setdefault(batch, []).append((int(f.base_name.split(".")[0]), f.path))
        return [Dataset(b, sorted(p)) for b, p in sorted(held.items())] or [Dataset("", [])]

    def read(self, partition: Dataset) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        at, rows, stop = 0, [], False
        for page, path in partition.pages:
            with store.open_input_stream(path) as f:
                lines = f.read().decode("utf-8").splitlines()
            for line in lines:
                if at >= self.most or not line.strip():
                    continue
                try:
                    item = json.loads(line)
                except ValueError:
                    item = None
                blocked = isinstance(item, dict) and item.get("blocked") is True
                rows.append((partition.batch, page, at, line, blocked))
                at += 1
                if blocked:
                    stop = True
                    break
            if len(rows) >= self.size:
                yield self._batch(rows)
                rows = []
            if stop or at >= self.most:
                break
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class PagedDataset(DataSource):
    """``paged_dataset``: options path, most (items of a dataset, 1000) and size (items of an Arrow batch, 500)."""

    @classmethod
    def name(cls) -> str:
        return "paged_dataset"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed into it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedDataset)


def record(df, path: str, batch: str, page: str, order: str, item: str) -> None:
    """Write rows as a recorded dataset: one file for each (batch, page), its items in order. A page is bounded."""
    import pandas as pd
    from pyarrow import fs

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        store, root = fs.FileSystem.from_uri(path)
        b, p = frame[batch].iloc[0], int(frame[page].iloc[0])
        store.create_dir(f"{root}/batch={b}", recursive=True)
        # the name is the page's alone, so that a repeated task writes the same file
        with store.open_output_stream(f"{root}/batch={b}/{p}.jsonl") as f:
            f.write("".join(x + "\n" for x in frame.sort_values(order)[item]).encode())
        return pd.DataFrame({"n": [len(frame)]})

    ship(df.sparkSession)
    df.groupBy(batch, page).applyInPandas(write, "n long").agg({"n": "sum"}).collect()
