"""Keyed, occurrence-indexed, positional and anti joins between truth and predictions.

Order is data: frames carry a ``_row_id`` (see ``sources.tables.with_row_id``),
and "first" always means the smallest one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import cells, text

ROW = "_row_id"


class Alignment(NamedTuple):
    """The pairs, what was left over on either side, and one row of counts and coverages."""

    merged: DataFrame
    truth_unmatched: DataFrame
    pred_unmatched: DataFrame
    truth_duplicates: DataFrame
    pred_duplicates: DataFrame
    summary: DataFrame


def require(df: DataFrame, columns: Sequence[str], role: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{role}: missing columns {', '.join(missing)}")


def rename_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each canonical column that isn't there takes the place of its first alias that is."""
    found = {}
    for name, others in aliases.items():
        if name not in df.columns and (other := next((o for o in others if o in df.columns), None)):
            found[other] = name
    return df.withColumnsRenamed(found)


def resolve(df: DataFrame, candidates: Sequence[str], role: str) -> str | None:
    """The first candidate that is a column with the role's suffix, or without."""
    for c in candidates:
        for name in (f"{c}_{role}", c):
            if name in df.columns:
                return name
    return None


def first_existing(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first candidate column that exists; empty text if none does."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(""))


def keep_first(df: DataFrame, key: str | Sequence[str], order: str = ROW) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key, all rows of keys that occur more than once)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__n": F.row_number().over(w.orderBy(order)), "__k": F.count("*").over(w)})
    return ranked.where("__n = 1").drop("__n", "__k"), ranked.where("__k > 1").drop("__n", "__k")


def align(truth: DataFrame, pred: DataFrame, *, title: str = "title", aliases: Mapping[str, Sequence[str]] = {}, strict: bool = False, least: float = 0.8, order: str = ROW) -> Alignment:
    """Pair truth and prediction by normalised title, the first row of each key on either side.

    Columns that both sides have get ``_truth`` and ``_pred``. ``strict`` raises
    on repeated keys, or if less than ``least`` of either side is paired.
    """
    require(truth, [title], "truth")
    require(pred, [title], "prediction")
    t, p = (rename_aliases(df, aliases).withColumn("_key", text.key(title)) for df in (truth, pred))
    (t, t_dup), (p, p_dup) = keep_first(t, "_key", order), keep_first(p, "_key", order)
    both = set(t.columns) & set(p.columns) - {"_key"}
    a = t.select("_key", *(F.col(c).alias(f"{c}_truth" if c in both else c) for c in t.columns if c != "_key"))
    b = p.select("_key", *(F.col(c).alias(f"{c}_pred" if c in both else c) for c in p.columns if c != "_key"))
    merged = a.join(b, "_key")
    sides = t.select("_key", F.lit(1).alias("t")).join(p.select("_key", F.lit(1).alias("p")), "_key", "full")
    n = sides.agg(F.count("t").alias("truth_count"), F.count("p").alias("pred_count"), F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("match_count"))
    summary = n.select("*", share("match_count", "truth_count").alias("truth_coverage"), share("match_count", "pred_count").alias("pred_coverage"))
    if strict:
        if not t_dup.isEmpty() or not p_dup.isEmpty():
            raise ValueError("repeated keys")
        s = summary.first()
        if s["truth_coverage"] < least or s["pred_coverage"] < least:
            raise ValueError(f"coverage below {least}: truth {s['truth_coverage']:.4f}, prediction {s['pred_coverage']:.4f}")
    return Alignment(merged, t.join(p, "_key", "left_anti"), p.join(t, "_key", "left_anti"), t_dup, p_dup, summary)


def share(part: str | Column, whole: str | Column) -> Column:
    """part / whole, 0 where there is no whole."""
    a, b = cells.col(part), cells.col(whole)
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def pair_key(*columns: str | Column) -> Column:
    """Trimmed lower-case texts, joined by a unit separator."""
    return F.concat_ws("\x1f", *(F.lower(cells.text_of(c)) for c in columns))


def with_occurrence(df: DataFrame, columns: Sequence[str], order: str = ROW) -> DataFrame:
    """Adds ``_merge_key`` and ``_dup_index``: how many rows of the key come before."""
    keyed = df.withColumn("_merge_key", pair_key(*columns))
    return keyed.withColumn("_dup_index", F.row_number().over(Window.partitionBy("_merge_key").orderBy(order)) - 1)


def by_occurrence(left: DataFrame, right: DataFrame, columns: Sequence[str], order: str = ROW) -> DataFrame:
    """Left join by key and occurrence, so that repeated keys pair up in order; keeps left's order column and right's columns."""
    a = with_occurrence(left, columns, order).select(order, "_merge_key", "_dup_index")
    b = with_occurrence(right, columns, order).drop(order)
    return a.join(b, ["_merge_key", "_dup_index"], "left").drop("_merge_key", "_dup_index")


def first_value(df: DataFrame, key: Sequence[str], value: str, order: str = ROW) -> DataFrame:
    """The first value of each key that isn't null; empty text if there is none."""
    keyed = df.withColumn("_merge_key", pair_key(*key))
    some = F.min_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order)))
    return keyed.groupBy("_merge_key").agg(F.coalesce(some.cast("string"), F.lit("")).alias(value))


def fill_blank(df: DataFrame, lookup: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Blank or null values filled from a lookup by key; a column that isn't there is added."""
    keyed = df.withColumn("_merge_key", pair_key(*key)).join(lookup.withColumnRenamed(value, "__found"), "_merge_key", "left")
    found = F.coalesce("__found", F.lit(""))
    filled = F.when(cells.text_of(value) == "", found).otherwise(F.col(value).cast("string")) if value in df.columns else found
    return keyed.withColumn(value, filled).drop("_merge_key", "__found")


def by_position(left: DataFrame, right: DataFrame, *, suffix: str = "_spatial", order: str = ROW, check: bool = True) -> DataFrame:
    """Row i of left beside row i of right; colliding columns of right get ``suffix``. Unequal lengths raise."""
    if check and left.count() != right.count():
        raise ValueError("frames of unequal length can't be paired by position")
    renamed = right.select(order, *(F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != order))
    return left.join(renamed, order)


def side_by_side(frames: Mapping[str, DataFrame], order: str = ROW) -> DataFrame:
    """Frames by row position, each column as ``[STEM] column``; shorter frames leave nulls."""
    out = None
    for stem, df in frames.items():
        named = df.select(order, *(F.col(c).alias(f"[{stem.upper()}] {c}") for c in df.columns if c != order))
        out = named if out is None else out.join(named, order, "full")
    return out


def by_title(left: DataFrame, right: DataFrame, *, title: str = "title", suffix: str = "_right", deals: int = 16, most: int = 1 << 17) -> DataFrame:
    """Left join by trimmed lower-case title; repeated titles on the right repeat the row.

    The pairs of one title are the product of its rows, so they are dealt: its right rows
    to ``deals`` groups, and its left rows, packed into arrays of about ``most``, to each of
    them. A pair is unpacked last, left rows within a right one, so that the same
    runs of left rows follow each other, which files store in little room.
    """
    k = lambda df: df.withColumn("_key", F.lower(cells.text_of(title)))
    a, b = k(left), k(right)
    row = F.struct(*(F.col(c) for c in left.columns))
    packed = a.groupBy("_key", F.pmod(F.xxhash64(*left.columns), F.lit(left.count() // most + 1)).alias("_part")).agg(F.collect_list(row).alias("_rows"))
    found = [F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != title]
    dealt = b.select("_key", F.pmod(F.xxhash64(*right.columns), F.lit(deals)).cast("int").alias("_deal"), F.struct("_key", *found).alias("_found"))
    pairs = packed.select("_key", "_rows", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("_deal")).hint("merge").join(dealt, ["_key", "_deal"])
    pairs = pairs.select(F.explode("_rows").alias("_row"), "_found").select("_row.*", "_found.*").drop("_key")
    alone = a.join(b.select("_key").distinct(), "_key", "left_anti").select(*left.columns)
    return pairs.unionByName(alone, allowMissingColumns=True)


def reused(base: DataFrame, other: DataFrame, value: str, *, title: str = "title", abstract: str = "abstract", order: str = ROW) -> DataFrame:
    """Another run's values for the base rows: by position if the titles agree row by row, else by title and abstract.

    Raises if a base row finds none.
    """
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sides = base.select(order, t(title).alias("a")).join(other.select(order, t(title).alias("b")), order, "full")
    if sides.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
        return base.select(order, title).join(other.select(order, value), order)
    k = F.concat_ws(" || ", F.lower(cells.text_of(title)), F.lower(cells.text_of(abstract)))
    out = base.select(order, title, k.alias("_key")).join(other.select(k.alias("_key"), value), "_key", "left").drop("_key")
    if missing := out.where(F.col(value).isNull()).count():
        raise ValueError(f"{missing} rows find no value")
    return out
