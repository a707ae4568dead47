"""Long runs that can be stopped after any batch and go on where they were.

A run reads its input as a stream, some files at a time. A batch's result is
written under a name of its own, and then *entered*: a small file named by the
batch's number says where it lies. If a run is killed between the two, the batch
is processed again and entered once; if it is killed after entering, the stream
replays the batch and finds it entered. So a result has every row once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgrid.sources import tables as S


def interval(rows: int, given: int | str | None = None) -> int:
    """Rows of a batch: what is asked for, or else by the number of rows (fixed values)."""
    try:
        return max(1, int(given)) if given not in (None, "") else 1000 if rows >= 5000 else 100 if rows >= 1000 else 10
    except (TypeError, ValueError):
        return interval(rows)


def stage(df: DataFrame, folder: str, rows: int) -> str:
    """The input as files of ``rows`` rows at most."""
    df.write.option("maxRecordsPerFile", rows).parquet(folder)
    return folder


class Stopped(RuntimeError):
    """A run was asked to stop."""


def run(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], folder: str, *, files: int = 1, stop: Callable[[int, str], bool] | None = None) -> None:
    """Apply ``work`` to the files of ``source``, ``files`` at a time, until all are done.

    ``work`` must treat batches alike: rows don't see those of others. ``stop``
    is asked, with a batch's number, at "write" and at "enter"; true ends the run there (for tests).
    """

    def each(batch: DataFrame, number: int) -> None:
        entry = f"{folder}/entered/{number:09d}.json"
        if S.read_json(spark, entry) is not None:
            return
        place = f"{folder}/data/{number:09d}-{uuid.uuid4().hex}"
        work(batch).write.parquet(place)
        if stop and stop(number, "write"):
            raise Stopped(f"after writing batch {number}")
        S.write_json(spark, entry, {"place": place.removeprefix(f"{folder}/")})
        if stop and stop(number, "enter"):
            raise Stopped(f"after entering batch {number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def result(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all batches entered so far; None if there are none."""
    names = [n for n in S.listing(spark, f"{folder}/entered") if n.endswith(".json")]
    if not names:
        return None
    entries = spark.read.option("multiLine", "true").schema("place string").json([f"{folder}/entered/{n}" for n in names])
    return spark.read.parquet(*(f"{folder}/{r['place']}" for r in entries.collect()))
