"""A data source for recorded matches (.dem files), with a pluggable decoder.

spark.dataSource.register(DemoSource); spark.read.format("demo").option("decoder", "module:function")
.load(path) for one file, or .option("paths", a JSON list of paths).load(); decoded() for a table of files. The decoder takes a file's path and yields (event_type, tick, JSON of the other columns);
none is bundled, as the format has no public decoder here. Events are handed on as they are decoded; a file that
is missing or that the decoder rejects ends with an event decode_error that says why.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DECODE_ERROR = "decode_error"
SCHEMA = "match_id string, seq long, event_type string, tick long, props string"
#: Events that are handed on at once; tasks at most that decode a table of files.
BATCH, MOST_TASKS = 10_000, 10_000


def events_of_file(path: str, decoder: str) -> Iterator[tuple]:
    """The events of one file, as rows of SCHEMA; none without a path or a decoder."""
    module, _, function = decoder.partition(":")
    if not path or not function:
        return
    decode = getattr(import_module(module), function)
    match_id = path.rpartition("/")[2].partition(".")[0]
    seq = 0
    try:
        for kind, tick, props in decode(path):
            yield match_id, seq, kind, tick, props
            seq += 1
    except Exception as e:  # whatever a decoder raises is told, and ends this file alone
        yield match_id, seq, DECODE_ERROR, None, json.dumps({"error": f"{type(e).__name__}: {e}"})


def decoded(files: DataFrame, decoder: str) -> DataFrame:
    """The events of a table of files (path), decoded in tasks of their own; no path comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["match_id", "seq", "event_type", "tick", "props"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in events_of_file(path, decoder):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    tasks = min(max(1, files.count()), MOST_TASKS)
    return files.select("path").repartition(tasks, "path").mapInArrow(run, SCHEMA)


class DemoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "demo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DemoReader:
        return DemoReader(self.options)


class DemoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if options.get("paths") else [p for p in (options.get("path"),) if p]
        self.decoder = options.get("decoder", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from events_of_file(partition.value, self.decoder)
