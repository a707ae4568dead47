"""Operator 8: token ids in Parquet list columns, for selective reads of tokens and metadata."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm import arrays, bpe, files, storage


@dataclass(frozen=True)
class Layout:
    """How the files are laid out.

    A file is closed after ``file_ids`` ids; a task is given about ``task_bytes``
    of input, so tasks and files don't grow with the table.

    ``encoding``: DELTA_BINARY_PACKED packs the ids of each miniblock in as few
    bits as their differences need; None lets the writer choose a dictionary.
    A row group is closed after ``group_rows`` texts or ``group_ids`` ids,
    whichever comes first; pages of ``page_bytes`` with a page index let a
    reader fetch the pages of some texts alone.
    """

    encoding: str | None = "DELTA_BINARY_PACKED"
    group_rows: int = 4096
    group_ids: int = 1 << 20
    page_bytes: int = 64 << 10
    file_ids: int = 1 << 27
    task_bytes: int = 256 << 20
    compression: str = "zstd"


MANIFEST = "file string, task int, number int, texts long, tokens long"
IDS = pa.list_(pa.field("element", pa.int32(), False))


def file_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("id", kind), ("start_in_file", pa.int64()), ("n_tokens", pa.int32()), ("ids", IDS)])


def write(docs: DataFrame, folder: str, path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", layout: Layout = Layout()) -> DataFrame:
    """Tokenise every text, append ``end_id``, and write files in ascending order of the id.

    Texts are dealt by ranges of the id and a hash of the text and sorted within
    each range, so files are in order by task and number (rows of one id lie
    together, in an order of their own that is the same in every attempt; an id
    that many rows have is dealt to many tasks). Ids of any type that sorts.
    Returns the manifest, a row for each file; it is written beside the files,
    and a file that isn't on it is a dead attempt's. A null text counts as empty
    (one id: the end id). Null ids come first. An empty table gives no files.
    """
    spark = docs.sparkSession

    def put(batches):
        task, attempt, k = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        out, writer, name, done, texts = None, None, "", 0, 0
        held, held_rows, held_ids = [], 0, 0

        def flush():
            nonlocal held, held_rows, held_ids
            if held:
                writer.write_table(pa.concat_tables(held).combine_chunks(), row_group_size=max(1, held_rows))
            held, held_rows, held_ids = [], 0, 0

        def close():
            nonlocal out, k
            flush()
            writer.close()
            out.close()
            out, k = None, k + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([task], pa.int32()), pa.array([k], pa.int32()), pa.array([texts], pa.int64()), pa.array([done], pa.int64())], ["file", "task", "number", "texts", "tokens"])

        for batch in batches:
            for part, data, offs in arrays.chunks(batch, "text"):
                schema = file_schema(part.column(0).type)
                if out is None:
                    name, done, texts = f"tokens-{task:06d}-{attempt}-{k:05d}.parquet", 0, 0
                    out = files.Atomic(folder, name)
                    packed = {c: "DELTA_BINARY_PACKED" for c in ("id", "start_in_file", "n_tokens") if pa.types.is_integer(schema.field(c).type)}
                    writer = pq.ParquetWriter(
                        out.out, schema, compression=layout.compression, use_dictionary=layout.encoding is None and ["ids.list.element"], column_encoding=layout.encoding and {"ids.list.element": layout.encoding, **packed},
                        write_page_index=True, data_page_size=layout.page_bytes, write_statistics=["id", "start_in_file", "n_tokens"],
                    )
                ids, places = bpe.encode_chunk(path, data, offs)
                lengths = np.diff(places)
                n = len(lengths)
                ends = np.cumsum(lengths + 1)
                body = np.empty(len(ids) + n, np.int32)
                mark = np.zeros(len(body), bool)
                mark[ends - 1] = True
                body[mark], body[~mark] = end_id, ids
                rows = pa.Table.from_arrays(
                    [part.column(0), pa.array(done + ends - lengths - 1), pa.array((lengths + 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(body), type=IDS)], schema=schema
                )
                done, texts = done + len(body), texts + n
                held.append(rows)
                held_rows, held_ids = held_rows + n, held_ids + len(body)
                if held_rows >= layout.group_rows or held_ids >= layout.group_ids:
                    flush()
                if done >= layout.file_ids:
                    yield close()
        if out is not None:
            yield close()

    src = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-storage.size_of(docs) // layout.task_bytes))
    src = src.repartitionByRange(parts, "id", "hash").sortWithinPartitions("id", "hash", "text").drop("hash")
    src.mapInArrow(put, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read(manifest: DataFrame, folder: str, *, with_ids: bool = True, id_type: str = "long") -> DataFrame:
    """The texts of written files: id, start (ids of all texts before it), n_tokens and, if asked for, ids.

    Without ids only the metadata columns' pages are read. The manifest has a
    row for each file; its running sum is the one step that isn't dealt out.
    ``id_type``: the type of the ids.
    """
    spark = manifest.sparkSession
    order = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    schema = f"id {id_type}, start_in_file long, n_tokens int" + (", ids array<int>" if with_ids else "")
    rows = spark.read.schema(schema).option("pathGlobFilter", "tokens-*.parquet").parquet(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return rows.join(F.broadcast(base) if _small(manifest) else base, "file").select("id", (F.col("before") + F.col("start_in_file")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *(["ids"] if with_ids else []))


def _small(manifest: DataFrame, most: int = 200_000) -> bool:
    """A manifest of so many files (about 100 bytes each) is safe to broadcast."""
    return manifest.limit(most + 1).count() <= most


def checksums(tokens: DataFrame, id_col: str) -> DataFrame:
    """A digest row for each text read: crc32 of its ids as little-endian unsigned 32-bit integers."""

    def digest(batches):
        for b in batches:
            lists = b.column(3)
            offs, body = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
            crc = [zlib.crc32(body[4 * i : 4 * j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "start", "n_tokens", "ids").mapInArrow(digest, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, layout: Layout = Layout()) -> DataFrame:
    """Write the token files of ``docs`` and return a digest row for each text, from the files."""
    folder = folder or storage.new_dir(docs.sparkSession, "token-files")
    manifest = write(docs, folder, path, end_id=end_id, id_col=id_col, text_col=text_col, layout=layout)
    return checksums(read(manifest, folder, id_type=docs.schema[id_col].dataType.simpleString()), id_col)
