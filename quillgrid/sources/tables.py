"""Reading and writing: typed tables with stable row ids, header inference, discovery, sidecars, reports."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import cells, text
from quillgrid.operators.align import ROW, require

#: Columns of an input record, and those that may be missing.
RECORD = ("title", "abstract", "author_keywords", "keywords_plus", "keywords", "wos_categories", "research_areas")
OPTIONAL = RECORD[2:]
POSITIONAL = ("title", "abstract", "is_target", "is_spatial", "spatial_level", "spatial_desc")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task: how many rows it has."""
    yield pa.RecordBatch.from_pydict({"n": pa.array([sum(b.num_rows for b in batches)], pa.int64())})


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores if they come in fewer tasks than there are cores, or if one task has far more than its share; else as they are.

    A large file of few row groups comes in many tasks too, but only as many as it has
    row groups get rows. Rows are counted without their columns, which for a table of files reads footers only.
    """
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks >= cores:
        counts = [r["n"] for r in df.select(F.lit(1).alias("n")).mapInArrow(_counted, "n bigint").collect()]
        if 2 * max(counts, default=0) * cores <= 3 * sum(counts):
            return df
    return df.repartition(max(cores, tasks))


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Adds ``_row_id``: a natural key as it is, else the row's place by file and by place within the file.

    The second form reads the files' order (a file's rows are numbered in the
    order of its splits), so it is the same however the rows are dealt out later.
    """
    if key:
        return df.withColumn(ROW, F.col(key).cast("long"))
    return df.withColumn(ROW, F.monotonically_increasing_id())


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A Parquet, ORC, JSON, CSV or text table, or an xlsx sheet; the kind is the path's ending unless given.

    xlsx needs an optional package and is read on the driver: it is for sheets
    of a workbook's size, not for large tables.
    """
    kind = kind or PurePosixPath(path.rstrip("/")).suffix.lstrip(".") or "parquet"
    if kind == "xlsx":
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise RuntimeError("reading xlsx needs openpyxl") from e
        import pandas as pd

        sheet = pd.read_excel(path, engine="openpyxl", dtype=str, **options)
        return spark.createDataFrame(sheet.where(sheet.notna(), None), T.StructType([T.StructField(str(c), T.StringType()) for c in sheet.columns]))
    if kind == "csv":
        options = {"header": True, "multiLine": True, "escape": '"'} | options
    return spark.read.options(**options).format(kind).load(path)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one aggregate finds them."""
    n = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns))).first()
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[str(i)]))


def header_names(width: int) -> list[str]:
    """Names by position for a sheet without a header."""
    return [*POSITIONAL[:width], *(f"extra_{i}" for i in range(1, width - len(POSITIONAL) + 1))]


def records(df: DataFrame, has_header: bool = True, keep_all: bool = False) -> DataFrame:
    """Input records: positional names if there is no header, missing optional columns as empty text, projected to ``RECORD``."""
    if not has_header or not {"title", "abstract"} <= set(df.columns):
        df = drop_empty_columns(df)
        df = df.toDF(*header_names(len(df.columns)))
    require(df, ["title", "abstract"], "input")
    df = df.withColumns({c: F.lit("") for c in OPTIONAL if c not in df.columns})
    return df if keep_all else df.select(*RECORD, *([ROW] if ROW in df.columns else []))


def normalised(df: DataFrame) -> DataFrame:
    """Records with normalised texts; keywords default to both keyword fields."""
    out = df.withColumns({c: text.normalize(c) for c in RECORD if c in df.columns})
    return out.withColumn("keywords", F.when(F.col("keywords") == "", text.keywords("author_keywords", "keywords_plus")).otherwise(F.col("keywords")))


def head(df: DataFrame, n: int | None, order: str = ROW) -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


# --- discovery ---


def listing(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any file system that Spark reads, sorted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def in_scope(name: str, scope: str) -> bool:
    """Is a file a prediction of this scope (all, or its prefix)? Reports and lock files never are."""
    low = name.lower()
    return not low.startswith(("eval_", "~$")) and (scope == "all" or low.startswith(f"{scope}_") or scope not in ("urban_renewal", "spatial", "merged"))


def prediction_files(names: Sequence[str], scope: str = "urban_renewal") -> list[str]:
    found = sorted(n for n in names if in_scope(n, scope))
    if not found:
        raise FileNotFoundError(f"no prediction files of scope {scope}")
    return found


STRICT_TRACKS = ("stable_release", "research_matrix")


def truth_files(names: Sequence[str], track: str = "stable_release") -> list[str]:
    """Truth files; strict tracks need exactly one."""
    if not names:
        raise FileNotFoundError("no truth files")
    if track in STRICT_TRACKS and len(names) != 1:
        raise ValueError(f"{track} needs exactly one truth file, there are {len(names)}")
    return sorted(names)


def _stem(name: str) -> str:
    return PurePosixPath(name).stem.lower()


def bind_truth(pred: str, truths: Sequence[str], track: str = "legacy_archive") -> tuple[str, str]:
    """(the truth file of a prediction file, how it was found): the only one, the same stem, containment, most common words, the first."""
    if len(truths) == 1:
        return truths[0], "single_truth"
    if track in STRICT_TRACKS:
        raise ValueError(f"{track} forbids guessing the truth of {pred}")
    p = _stem(pred)
    words = lambda x: {w for w in re.split("[^a-z0-9]+", x) if w}
    tests = (("exact_stem_match", lambda t: _stem(t) == p), ("contains_match", lambda t: _stem(t) in p or p in _stem(t)))
    for how, ok in tests:
        if hit := [t for t in truths if ok(t)]:
            return hit[0], how
    shared = [(len(words(p) & words(_stem(t))), -i, t) for i, t in enumerate(truths)]
    most = max(shared)
    return (most[2], "token_overlap_match") if most[0] else (truths[0], "fallback_first_truth")


def training_files(names: Sequence[str], markers: Sequence[str], forbidden: Sequence[str] = ()) -> list[str]:
    """Files whose name has a marker; a forbidden name among them (evaluation data) is an error."""
    found = sorted(n for n in names if any(m.lower() in n.lower() for m in markers))
    leaks = [n for n in found if any(f.lower() in n.lower() for f in forbidden)]
    if leaks:
        raise ValueError(f"evaluation data among the training files: {leaks}")
    return found


def label_column(columns: Sequence[str], preferred: Sequence[str] = ("is_target", "label", "is_urban_renewal"), words: Sequence[str] = ("urban", "renew"), never: Sequence[str] = ("urban_parse_reason", "decision_source", "decision_reason")) -> str | None:
    """A label column: a preferred name, else the first that has all the words."""
    return next((c for c in preferred if c in columns), None) or next((c for c in columns if c.lower() not in never and all(w in c.lower() for w in words)), None)


def other_column(columns: Sequence[str], known: Sequence[str], parts: Sequence[str] = ("keyword", "abstract", "wos", "research", "theme", "review")) -> str | None:
    """The first column that isn't known and has none of the parts in its name."""
    return next((c for c in columns if c not in known and not any(p in c.lower() for p in parts)), None)


def truth_column(columns: Sequence[str], requested: str) -> str:
    if requested in columns:
        return requested
    found = next((c for c in columns if c.endswith("local_v2")), None)
    if found is None:
        raise KeyError(f"no truth column {requested}")
    return found


def matches_strategy(name: str, wanted: Sequence[str]) -> bool:
    """A file of a strategy: by stem, by a part between underscores, by its first two parts, or by prefix; all files if none is wanted."""
    stem = _stem(name)
    parts = stem.split("_")
    keys = {stem, *parts, "_".join(parts[:2])}
    return not wanted or any(w.lower() in keys or stem.startswith(w.lower()) for w in wanted)


def latest_run(spark: SparkSession, folder: str) -> str | None:
    """The run directory of a folder that changed last (ties: the last name)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return max(runs)[1] if runs else None


# --- labelled sets ---


def labelled(frames: Mapping[str, DataFrame], label: str, *, title: str = "title", abstract: str = "abstract", prefix: int = 400) -> DataFrame:
    """Labelled rows of several files in order of their names: label 0 or 1, not blank, the first of each title and start of the abstract."""
    from quillgrid.operators.align import keep_first

    out = None
    for i, (name, df) in enumerate(sorted(frames.items())):
        one = df.select(F.lit(name).alias("file"), F.lit(i).alias("_file"), title, abstract, cells.binary(label).alias("label"), F.col(ROW))
        out = one if out is None else out.unionByName(one)
    keyed = out.where("label >= 0").where((text.normalize(title) != "") | (text.normalize(abstract) != ""))
    keyed = keyed.withColumns({"_k": text.phrase(title), "_a": text.phrase(F.substring(text.normalize(abstract), 1, prefix)), "_o": F.struct("_file", ROW)})
    return keep_first(keyed, ["_k", "_a"], "_o")[0].drop("_k", "_a", "_o", "_file")


# --- sinks ---


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> list[str]:
    """A directory of Parquet for each named table; names are cut to 31 characters, as sheets are."""
    done = []
    for name, df in tables.items():
        path = f"{folder}/{re.sub(r'[^A-Za-z0-9_-]+', '_', name)[:31]}"
        df.write.mode(mode).parquet(path)
        done.append(path)
    return done


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{re.sub(r'[^A-Za-z0-9_-]+', '_', n)[:31]}") for n in names}


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value: Mapping) -> None:
    """A sidecar beside an output, on any file system that Spark writes; it appears under its name when it is whole."""
    final, fs = _path(spark, path)
    temp, _ = _path(spark, f"{path}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.close()
    fs.delete(final, False)
    fs.rename(temp, final)


def read_json(spark: SparkSession, path: str) -> dict | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; under a temporary folder only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: what it was computed from is forgotten."""
    folder = scratch(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def run_paths(dataset: str, track: str, tag: str) -> dict[str, str]:
    """Where a run's outputs go, as partition directories."""
    root = f"dataset={dataset}/track={track}/run_tag={tag}"
    return {k: f"{root}/{k}" for k in ("predictions", "evaluation", "review", "summary")}
