"""Diagnostics, protocol, release gates and report facts: small tables made of the metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators.align import Alignment


def diagnostics(a: Alignment, verbose: bool = False, preview: int = 50) -> DataFrame:
    """Counts of an alignment as (type, key, value), and up to ``preview`` rows of each leftover if asked for."""
    s = a.summary
    args = ", ".join(f"'{c}', cast(`{c}` as string)" for c in s.columns)
    out = s.selectExpr("'summary' as type", f"stack({len(s.columns)}, {args}) as (key, value)")
    for name in ("truth_unmatched", "pred_unmatched", "truth_duplicates", "pred_duplicates"):
        df = getattr(a, name)
        out = out.unionByName(df.agg(F.count("*").cast("string").alias("value")).select(F.lit("section").alias("type"), F.lit(name).alias("key"), "value"))
        if verbose:
            out = out.unionByName(df.orderBy("_key").limit(preview).select(F.lit(name).alias("type"), F.col("_key").alias("key"), cells.text_of("title").alias("value")))
    return out


def key_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """A table (field, value) of settings, in order; ``df`` gives the session."""
    return df.sparkSession.createDataFrame([(k, "" if v is None else str(v)) for k, v in values.items()], "field string, value string")


def protocol(settings: Mapping[str, object], sources: DataFrame, column: str) -> DataFrame:
    """The settings of an evaluation, and the decision sources that occur in it."""
    seen = sources.where(cells.text_of(column) != "").agg(F.array_join(F.array_sort(F.collect_set(cells.text_of(column))), ";").alias("v")).first()["v"]
    return key_values(sources, {**settings, "decision_source_contract": seen})


#: Bounds of a release: (metric, least) and (metric, most) (fixed values).
LEAST = (("accuracy", 88.0), ("precision", 0.956), ("recall", 0.940), ("f1", 0.948), ("explanation_coverage", 1.0), ("rule_stack_coverage", 1.0), ("evidence_coverage", 1.0))
MOST = (("fp", 34), ("fn", 48), ("unknown_count", 38), ("unknown_rate", 0.038))


def gate_failures(metrics: Mapping[str, float | None], rows: int, expected: int = 1000, least: Sequence[tuple[str, float]] = LEAST, most: Sequence[tuple[str, float]] = MOST) -> list[str]:
    """What keeps a release from passing; a missing metric fails."""
    out = [] if rows == expected else [f"rows {rows} != {expected}"]
    for pairs, bad, sign in ((least, lambda v, b: v < b, "<"), (most, lambda v, b: v > b, ">")):
        for name, bound in pairs:
            v = metrics.get(name)
            if v is None or v != v:
                out.append(f"{name} missing")
            elif bad(v, bound):
                out.append(f"{name} {v} {sign} {bound}")
    return out


def gates(metrics: DataFrame, least: Sequence[tuple[str, float]] = LEAST, most: Sequence[tuple[str, float]] = MOST) -> DataFrame:
    """``gate_failures`` as a table over one row for each run: adds ``failures`` (names, joined) and ``passed``."""
    fails = [F.when(F.col(n).isNull() | (F.col(n) < b), n) for n, b in least if n in metrics.columns] + [F.when(F.col(n).isNull() | (F.col(n) > b), n) for n, b in most if n in metrics.columns]
    return metrics.withColumn("failures", F.array_join(F.array_compact(F.array(*fails)), ";")).withColumn("passed", F.col("failures") == "")


def metric_of(metrics: DataFrame, metric: str, file: str, column: str) -> DataFrame:
    """A metric's row of a file, or the metric's first row if the file has none."""
    return metrics.where(F.col("metric") == metric).orderBy(F.when(F.col("file") == file, 0).otherwise(1), "file").limit(1).select("file", "metric", column)


def first_matching(df: DataFrame, values: Mapping[str, object], order: str) -> DataFrame:
    """The first row that has all the given values."""
    out = df
    for c, v in values.items():
        out = out.where(F.col(c) == v)
    return out.orderBy(order).limit(1)


def facts(df: DataFrame, label: str, source: str, explanation: str) -> DataFrame:
    """Scalar facts of a prediction table for a report."""
    return df.agg(F.count("*").alias("rows"), F.count_if(cells.binary(label) == 1).alias("positive"), F.count_if(cells.binary(label) == 0).alias("negative"), F.count_distinct(cells.text_of(source)).alias("sources"), F.round(F.avg(cells.is_present(explanation).cast("int")), 6).alias("explained"))
