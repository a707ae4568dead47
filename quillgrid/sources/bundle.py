"""Several tables written as one: all of them appear, or none.

The tables go through one job as one frame, with a struct column for each table. A task writes a
Parquet file for each table that it has rows of, under a name of its own, and
reports it; nothing reads such a file yet. Only when all tasks have reported does
the driver write a *version*, one small file that names the files of all tables
and appears under its name whole. A task that fails is run again and writes other
files; a job that fails writes no version and removes the files it knows of.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillgrid.sources import paths

FORMAT = "quillgrid_bundle"
_TABLE = "_table"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (table, file, rows)."""

    files: list[tuple[str, str, int]]


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.tables = folder.rstrip("/"), [f.name for f in schema if f.name != _TABLE]
        self.schemas = {f.name: f.dataType.json() for f in schema if f.name != _TABLE}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        writers: dict[str, tuple[pq.ParquetWriter, str]] = {}
        rows = dict.fromkeys(self.tables, 0)
        try:
            for batch in iterator:
                which = batch.column(batch.schema.get_field_index(_TABLE))
                for name in which.unique().to_pylist():
                    column = batch.column(batch.schema.get_field_index(name)).filter(pc.equal(which, name))
                    own = pa.RecordBatch.from_arrays(column.flatten(), names=[f.name for f in column.type])
                    if name not in writers:
                        file = f"data/{name}/{uuid.uuid4().hex}.parquet"
                        system, path = paths.opened(f"{self.folder}/{file}")
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        writers[name] = (pq.ParquetWriter(path, own.schema, filesystem=system), file)
                    writers[name][0].write_batch(own)
                    rows[name] += own.num_rows
        finally:
            for w, _ in writers.values():
                w.close()
        return Written([(name, file, rows[name]) for name, (_, file) in writers.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files: dict[str, list] = {n: [] for n in self.tables}
        for m in messages:
            for name, file, n in m.files if m else []:
                files[name].append([file, n])
        known = paths.names(f"{self.folder}/versions")
        number = int(known[-1].split(".")[0]) + 1 if known else 0
        version = {"schemas": self.schemas, "files": {k: sorted(v) for k, v in files.items()}}
        paths.put(f"{self.folder}/versions/{number:09d}.json", json.dumps(version, ensure_ascii=False).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for _, file, _ in m.files if m else []:
                paths.remove(f"{self.folder}/{file}")


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["folder"], schema)


def write(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write all tables as the folder's next version. Names are those of columns; columns of one table have different names."""
    frames = list(tables.items())
    spark = frames[0][1].sparkSession
    spark.dataSource.register(BundleSource)
    kinds = {n: T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]) for n, df in frames}
    wide = None
    for name, df in frames:
        own = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        one = df.select(F.lit(name).alias(_TABLE), *((own if n == name else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))
        wide = one if wide is None else wide.union(one)
    wide.write.format(FORMAT).option("folder", folder).mode("append").save()


def versions(folder: str) -> list[int]:
    return [int(n.split(".")[0]) for n in paths.names(f"{folder.rstrip('/')}/versions")]


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the last one by default. Files of writes that failed are in none."""
    known = versions(folder)
    if not known:
        raise FileNotFoundError(f"nothing has been written to {folder}")
    v = json.loads(paths.get(f"{folder.rstrip('/')}/versions/{known[-1] if version is None else version:09d}.json"))
    out = {}
    for name, raw in v["schemas"].items():
        schema = T.StructType.fromJson(json.loads(raw))
        files = [f"{folder.rstrip('/')}/{f}" for f, _ in v["files"][name]]
        out[name] = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return out
