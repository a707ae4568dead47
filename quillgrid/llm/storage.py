"""Shared scratch space: where operators write tables that cut lineage.

The folder is the one that ``spark.checkpoint.dir`` names; every executor can
read it, so a table written there survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: list[str] = []
#: Scratch tables that ``materialise`` has written and ``free`` hasn't removed, by application and thread, so that calls in two threads don't free each other's.
_made: dict[tuple[str, int], list[str]] = {}


def _own(spark: SparkSession) -> tuple[str, int]:
    return spark.sparkContext.applicationId, threading.get_ident()


def base_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is made only where none is set (local tests)."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="quillgrid-"))
        found = _own[0]
    return found.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{base_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = new_dir(df.sparkSession, label)
    _made.setdefault(_own(df.sparkSession), []).append(path)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """The bytes that the planner estimates for a table, from its files' sizes; 0 if it has no estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark(spark: SparkSession) -> int:
    """A place in the list of scratch tables, for ``free``."""
    return len(_made.get(_own(spark), []))


def free(spark: SparkSession, since: int, keep: tuple[str, ...]) -> None:
    """Remove the scratch tables written since a mark, but for those with the labels ``keep``, which results still read."""
    made = _made.get(_own(spark), [])
    kept = [p for p in made[since:] if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] in keep]
    for p in set(made[since:]) - set(kept):
        delete(spark, p)
    made[since:] = kept
