"""Samples that don't depend on how rows are dealt out: seeded by a hash of the row's key."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators.align import ROW


def hashed(key: Column | str, seed: int) -> Column:
    """The order of a seeded sample: md5 of the seed and the key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), cells.col(key).cast("string")).cast("binary"))


def clean_sample(df: DataFrame, n: int, seed: int, *, title: str = "title", abstract: str = "abstract", least: int = 20, order: str = ROW) -> DataFrame:
    """``n`` of the rows with a title and an abstract of ``least`` characters, the first of each pair of them."""
    w = df.withColumns({c: cells.text_of(c) for c in (title, abstract)}).where((F.col(title) != "") & (F.length(abstract) >= least))
    first = w.withColumn("__n", F.row_number().over(Window.partitionBy(title, abstract).orderBy(order))).where("__n = 1").drop("__n")
    return first.orderBy(hashed(order, seed), order).limit(n)


def sample_summary(df: DataFrame, sampled: DataFrame, *, title: str = "title", abstract: str = "abstract", least: int = 20) -> DataFrame:
    """What each step of ``clean_sample`` left."""
    t, a = cells.text_of(title), cells.text_of(abstract)
    ok = (t != "") & (a != "")
    n = df.agg(F.count("*").alias("input_rows"), F.count_if(ok).alias("with_both"), F.count_if(ok & (F.length(a) >= least)).alias("long_enough"), F.count_distinct(F.when(ok & (F.length(a) >= least), F.struct(t, a))).alias("distinct_rows"))
    out = n.join(F.broadcast(sampled.agg(F.count("*").alias("sampled"))))
    args = ", ".join(f"'{c}', `{c}`" for c in out.columns)
    return out.selectExpr(f"stack({len(out.columns)}, {args}) as (step, rows)")


def allocate(counts: Mapping[str, int], n: int) -> dict[str, int]:
    """How many of ``n`` fall to each stratum, in proportion.

    Every stratum gets its whole share, and one at least if ``n`` is enough for
    all; what is missing goes to the largest remainders (then the largest
    strata), what is too much comes from the smallest, never below one.
    """
    if n <= 0:
        raise ValueError("the sample size must be positive")
    total = sum(counts.values())
    if n >= total:
        return dict(counts)
    exact = {k: c / total * n for k, c in counts.items()}
    least = 1 if n >= sum(c > 0 for c in counts.values()) else 0
    out = {k: max(int(q), least if counts[k] else 0) for k, q in exact.items()}
    missing = n - sum(out.values())
    strength = {k: (exact[k] - int(exact[k]), c) for k, c in counts.items()}
    if missing > 0:  # seats in rounds, in each round the strongest first
        seats = [(turn, -strength[k][0], -strength[k][1], i, k) for i, k in enumerate(counts) for turn in range(min(missing, counts[k] - out[k]))]
        for *_, k in heapq.nsmallest(missing, seats):
            out[k] += 1
    else:
        for *_, k in heapq.nsmallest(-missing, [(*strength[k], i, k) for i, k in enumerate(counts) if out[k] > 1]):
            out[k] -= 1
    return out


def stratified(df: DataFrame, stratum: str, n: int, seed: int, order: str = ROW) -> DataFrame:
    """A stratified sample of ``n`` rows; the strata's counts, a row for each, are read to the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count("*")).orderBy(stratum).collect()}
    if not counts:
        return df.limit(0)
    quota = F.create_map(*(F.lit(x) for kv in allocate(counts, n).items() for x in kv))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hashed(order, seed), order))
    return df.withColumn("__n", rank).where(F.col("__n") <= F.coalesce(F.try_element_at(quota, F.col(stratum)), F.lit(0))).drop("__n")


#: Blank columns of an annotation sheet (fixed values).
ANNOTATION = tuple(f"{who}_{what}" for who in ("annotator_a", "annotator_b") for what in ("spatial", "level", "desc", "notes")) + ("adjudicated_spatial", "adjudicated_level", "adjudicated_desc", "adjudication_notes", "agreement_spatial", "agreement_level", "agreement_desc")


def annotation_sheet(sampled: DataFrame, stratum: str, title: str, seed: int, prefix: str = "SPA", order: str = ROW) -> DataFrame:
    """A sample in order of stratum and title, numbered, with blank columns to fill in. A sheet is for people: a few hundred rows."""
    rid = F.format_string(f"{prefix}-%03d", F.row_number().over(Window.orderBy(stratum, title, order)))
    return sampled.select(rid.alias("review_id"), F.lit(seed).alias("sample_seed"), *sampled.columns, *(F.lit("").alias(c) for c in ANNOTATION))


def stratum_summary(df: DataFrame, sampled: DataFrame, stratum: str) -> DataFrame:
    a = df.groupBy(stratum).agg(F.count("*").alias("population_count"))
    b = sampled.groupBy(stratum).agg(F.count("*").alias("selected_count"))
    n = F.coalesce("selected_count", F.lit(0))
    return a.join(b, stratum, "left").select(stratum, "population_count", n.alias("selected_count"), F.round(n / F.col("population_count"), 6).alias("selected_rate"))


def run_order(df: DataFrame, *, title: str = "title", seed: int | None = None, order: str = ROW) -> DataFrame:
    """Rows in the order of a run: shuffled by a seed, else by trimmed lower-case title."""
    return df.orderBy(hashed(order, seed), order) if seed is not None else df.orderBy(F.lower(cells.text_of(title)), order)


def checkpoint_interval(rows: int) -> int:
    """Rows between two checkpoints of a run (fixed values)."""
    return 1000 if rows >= 5000 else 100 if rows >= 1000 else 10


def clean_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: cells.text_of(c) for c in columns if c in df.columns})
