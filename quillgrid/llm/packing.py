"""Operator 5: bulk-synchronous best-fit packing of token sequences.

Documents of one length are interchangeable, and so are open sequences with one
gap. Both tables are therefore kept as *runs* (size, first rank, count), sorted
by size: at most ``capacity`` sizes, however many documents there are. Rows get
their rank within their length from a scan (a task's own count plus the counts
of the tasks before it), never from a global sort, so a length that holds a
third of all rows is dealt out like any other.

A superstep takes the run of the longest unplaced length. A successor sweep
over the sorted gap runs finds the smallest gap that holds it; where more
documents want a gap run than it has room for, ranks decide: the first ranks
take it, the rest sweep on to the next larger gap, and what is left opens new
sequences. Then the gaps are updated and the next superstep begins. Since each
superstep is exact, the outcome is that of best-fit decreasing.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm import arrays, bpe, storage


@dataclass(frozen=True)
class Placement:
    """Ranks ``rank`` and on of a length: ``each`` of them to a sequence, beginning at ``offset`` in sequence ``first``."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """(placements by length and rank, number of sequences) for so many pieces of each length.

    Work and result are bounded by the number of distinct lengths and of gap
    runs, both bounded by ``capacity``, not by the number of pieces.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("every piece must have from 1 to `capacity` tokens")
    out: list[Placement] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: [(first sequence, count)]
    sizes: list[int] = []  # the gaps that are there, ascending
    made = 0

    def put_back(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        rank, left = 0, histogram[length]

        def fill(gap: int, first: int, count: int) -> None:
            nonlocal rank, left
            each = gap // length
            whole = min(count, left // each)
            offset = capacity - gap
            if whole:
                out.append(Placement(length, rank, whole * each, first, each, offset))
                put_back(gap - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < count:
                if left:  # fewer than `each`: one sequence takes the last ranks
                    out.append(Placement(length, rank, left, first + whole, each, offset))
                    put_back(gap - left * length, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                put_back(gap, first + whole, count - whole)

        while left and (k := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes.pop(k)
            for first, count in (runs := gaps.pop(gap)):
                fill(gap, first, count) if left else put_back(gap, first, count)
            del runs
        if left:
            new = -(-left // (capacity // length))
            first, made = made, made + new
            fill(capacity, first, new)
    return sorted(out, key=lambda p: (p.length, p.rank)), made


PIECES = "piece int, start long, length int, ids_crc32 long, task int, local long"


def pieces(docs: DataFrame, path: str, capacity: int, *, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Each text's token ids, ended by ``end_id``, cut into pieces of at most ``capacity``.

    Only a text of more ids is cut; its first piece is the shorter one. ``task``
    and ``local`` say which task counted the piece and how many pieces of its
    length that task had counted before.
    """
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def cut(batches):
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part, data, offs in arrays.chunks(batch, "text"):
                ids, places = bpe.encode_chunk(path, data, offs)
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(len(offs) - 1):
                    own = np.concatenate([ids[places[i] : places[i + 1]], tail]).astype("<u4")
                    a, b, k = 0, len(own) % capacity or min(len(own), capacity), 0
                    while a < len(own):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].view(np.uint8)))
                        a, b, k = b, b + capacity, k + 1
                n = np.array(length, np.int64)
                order = np.argsort(n, kind="stable")
                local = np.empty(len(n), np.int64)
                kinds, first, counts = np.unique(n[order], return_index=True, return_counts=True)
                local[order] = np.arange(len(n)) - np.repeat(first, counts) + np.repeat(seen[kinds], counts)
                seen[kinds] += counts
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(np.full(len(n), task, np.int32)), pa.array(local)],
                    ["id", "piece", "start", "length", "ids_crc32", "task", "local"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(cut, f"id {kind}, {PIECES}")


def place(cut: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Sequence and offset of each piece (columns length, task and local are needed; others are kept)."""
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, made = best_fit(histogram, capacity)
    keys = np.array([(p.length << 45) + p.rank for p in plan], np.int64)
    first, rank, each, offset = (np.array([getattr(p, k) for p in plan], np.int64) for k in ("first", "rank", "each", "offset"))

    def look_up(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy().astype(np.int64)
            own = b.column(b.schema.get_field_index("rank")).to_numpy()
            k = np.searchsorted(keys, (length << 45) + own, "right") - 1
            nth = own - rank[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * length)], [*b.schema.names, "sequence_id", "offset"])

    kept = [c for c in cut.columns if c not in ("task", "local")]
    ranked = cut.join(ranks, ["task", "length"]).select(*kept, (F.col("before") + F.col("local")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(look_up, schema).drop("rank"), made


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into as few sequences of at most ``capacity`` tokens as best-fit decreasing does.

    Returns per piece: ``id_col``, piece (from 0), start (the text's ids before
    it), length, ids_crc32, sequence_id and offset (gapless from 0). A null text
    counts as empty (its end id alone; no row without an end id). Repeated and
    null ids are packed row by row. The pieces are written once to the shared
    folder, so ranks don't change if a task runs again.
    """
    cut = storage.materialise(pieces(docs, path, capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    placed, _ = place(cut, capacity)
    return placed.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
