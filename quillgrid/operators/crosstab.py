"""Cross-tabs with margins, shares, top-k and ranking tables of a review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators.align import share
from quillgrid.operators.metrics import numbered

TOTAL, NOT_MENTIONED = "Total", "Not mentioned"
#: Levels that are written in two ways (fixed value).
LEVEL_SPELLINGS = {"9. Micro / Neighborhood / Block": "9. Micro / Neighborhood / Block Scale"}
#: A cross-tab makes a column for each value; more values than this are an error, never cut.
MOST_COLUMNS = 2000


def normalize(df: DataFrame, year: str, topic: str, flag: str, level: str, detail: str) -> DataFrame:
    """Adds typed columns: year_number, has_year, topic_name, flag_name, is_spatial, level_name, detail_name, has_detail."""
    named = lambda c: F.when(cells.text_of(c) == "", NOT_MENTIONED).otherwise(cells.text_of(c))
    lv = named(level)
    for a, b in LEVEL_SPELLINGS.items():
        lv = F.when(named(level) == a, b).otherwise(lv)
    n = F.col(year).cast("string").try_cast("double")
    out = df.withColumns({"year_number": F.when(n == F.floor(n), n).cast("int"), "topic_name": cells.text_of(topic), "flag_name": cells.spatial_flag(flag), "level_name": lv, "detail_name": named(detail)})
    return out.withColumns({"has_year": F.col("year_number").isNotNull(), "is_spatial": F.col("flag_name") == "Spatial", "has_detail": F.col("detail_name") != NOT_MENTIONED})


def ordered_values(df: DataFrame, column: str) -> list[str]:
    """Distinct values by falling frequency, then by value; read to the driver as the columns of a cross-tab."""
    rows = df.groupBy(cells.text_of(column).alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values")
    return [r["v"] for r in rows]


def count_long(df: DataFrame, index: str, column: str, counted: str | None = None) -> DataFrame:
    """Counts of each pair of values, in long form; null values drop out, and rows whose ``counted`` cell is null count 0."""
    return df.where(F.col(index).isNotNull() & F.col(column).isNotNull()).groupBy(index, column).agg((F.count(counted) if counted else F.count("*")).alias("count"))


def pivot(df: DataFrame, index: str, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """A cross-tab of counts with a column for each value, zeros filled in."""
    values = list(order) if order is not None else ordered_values(df, column)
    there = df.where(F.col(index).isNotNull() & F.col(column).isNotNull())
    return there.groupBy(index).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def with_totals(table: DataFrame) -> DataFrame:
    """Row totals and a row of totals; the first column names the rows and becomes text."""
    first, *rest = table.columns
    total = _sum(rest)
    rows = table.select(F.col(first).cast("string").alias(first), *map(_q, rest), total.alias(TOTAL))
    margin = rows.agg(*(F.sum(_q(c)).alias(c) for c in (*rest, TOTAL))).select(F.lit(TOTAL).alias(first), *map(_q, (*rest, TOTAL))).where(_q(TOTAL).isNotNull())
    return rows.unionByName(margin)


def shares(table: DataFrame) -> DataFrame:
    """Each row as shares of its total, their sum, and a row of overall shares."""
    first, *rest = table.columns
    rows = table.select(F.col(first).cast("string").alias(first), *(share(_q(c), _sum(rest)).alias(c) for c in rest)).withColumn(TOTAL, _sum(rest))
    sums = table.agg(*(F.sum(_q(c)).alias(c) for c in rest)).where(_q(rest[0]).isNotNull())
    overall = sums.select(F.lit(TOTAL).alias(first), *(share(_q(c), _sum(rest)).alias(c) for c in rest), F.when(_sum(rest) != 0, 1.0).otherwise(0.0).alias(TOTAL))
    return rows.unionByName(overall)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _sum(columns: Sequence[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + _q(c)
    return out


def long_table(df: DataFrame, index: str, column: str) -> DataFrame:
    """A cross-tab with margins in long form - index, column, count, share of the row - from one pass of grouping sets."""
    name = lambda c: F.when(F.grouping(c) == 1, TOTAL).otherwise(F.col(c).cast("string"))
    there = df.where(F.col(index).isNotNull() & F.col(column).isNotNull())
    g = there.cube(index, column).agg(name(index).alias("row"), name(column).alias("col"), F.count("*").alias("count"))
    whole = F.max(F.when(F.col("col") == TOTAL, F.col("count"))).over(Window.partitionBy("row"))
    return g.select("row", "col", "count").withColumn("share", F.col("count") / whole)


def flags_by_year(df: DataFrame, year: str, flag: str, values: tuple[str, str] = ("Spatial", "Non-spatial")) -> DataFrame:
    """Counts and shares of both flags in each year, and in all; other flags aren't counted."""
    a, b = values
    g = df.rollup(year).agg(F.grouping(year).alias("__g"), F.count_if(F.col(flag) == a).alias("yes"), F.count_if(F.col(flag) == b).alias("no"))
    n = F.col("yes") + F.col("no")
    return g.select(F.when(F.col("__g") == 1, TOTAL).otherwise(F.col(year).cast("string")).alias(year), "yes", "no", n.alias("total_count"), share("yes", n).alias("yes_share"), share("no", n).alias("no_share"))


def level_share(df: DataFrame, level: str, is_in: str) -> DataFrame:
    """Count of each level among the rows in question, as shares of all rows and of these."""
    n = df.agg(F.count("*").alias("all_rows"), F.count_if(is_in).alias("in_rows"))
    g = df.where(is_in).groupBy(level).agg(F.count("*").alias("count"))
    return g.join(F.broadcast(n)).select(level, "count", share("count", "all_rows").alias("share_all"), share("count", "in_rows").alias("share_in"))


def ranked(df: DataFrame, value: str, year: str, all_rows: int) -> DataFrame:
    """Each value's count, overall rank (by falling count, then value), shares, and first and last year."""
    g = df.groupBy(value).agg(F.count("*").alias("count"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    g = numbered(g.withColumn("__minus", -F.col("count")), ["__minus", value], "overall_rank").drop("__minus")
    return g.withColumns({"share_all": F.when(F.lit(all_rows) > 0, F.col("count") / all_rows).otherwise(0.0), "share_in": F.col("count") / F.lit(g.agg(F.sum("count")).first()[0])})


def top_per_group(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group (ties by value), with shares and the value's overall rank."""
    pairs = df.groupBy(group, value).agg(F.count("*").alias("count"))
    overall = pairs.groupBy(value).agg((-F.sum("count")).alias("__minus"))
    overall = numbered(overall, ["__minus", value], "overall_rank").drop("__minus")
    w = Window.partitionBy(group)
    out = pairs.withColumns({"group_total": F.sum("count").over(w), "__r": F.row_number().over(w.orderBy(F.desc("count"), value))}).where(F.col("__r") <= k)
    return out.join(overall, value).select(group, value, "count", (F.col("count") / F.col("group_total")).alias("share_within"), "group_total", "overall_rank")


def kpis(df: DataFrame) -> DataFrame:
    """Scalar facts of a normalised review frame, as text."""
    n = df.agg(
        F.count("*").alias("Total Samples"), F.concat_ws("-", F.min("year_number"), F.max("year_number")).alias("Year Range"), F.count_distinct("topic_name").alias("Distinct Topics"), F.count_if("is_spatial").alias("Spatial Studies"), F.count_if(~F.col("is_spatial")).alias("Non-spatial Studies"),
        F.count_distinct(F.when(F.col("has_detail") & F.col("is_spatial"), F.col("detail_name"))).alias("Distinct Detailed Spaces"), F.count_if(~F.col("has_detail")).alias("Not Mentioned Count"), F.round(F.avg((~F.col("has_detail")).cast("int")), 6).alias("Not Mentioned Share"),
    )
    args = ", ".join(f"'{c}', cast(`{c}` as string)" for c in n.columns)
    return n.selectExpr(f"stack({len(n.columns)}, {args}) as (metric, value)")


def trend(df: DataFrame, year: str, topic: str, early: int = 2005, late: int = 2016) -> DataFrame:
    """Each topic's mean yearly share up to ``early``, from ``late`` on, and the change; years without rows of a topic count 0."""
    by = df.where(F.col(year).isNotNull()).groupBy(year, topic).agg(F.count("*").alias("n"))
    s = by.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy(year)))
    years = by.agg(F.count_distinct(F.when(F.col(year) <= early, F.col(year))).alias("ey"), F.count_distinct(F.when(F.col(year) >= late, F.col(year))).alias("ly"))
    g = s.groupBy(topic).agg(F.sum(F.when(F.col(year) <= early, F.col("s")).otherwise(0.0)).alias("e"), F.sum(F.when(F.col(year) >= late, F.col("s")).otherwise(0.0)).alias("l")).join(F.broadcast(years))
    out = g.select(topic, share("e", "ey").alias("early_share"), share("l", "ly").alias("late_share"))
    return out.withColumn("delta_share", F.col("late_share") - F.col("early_share"))


def with_other(df: DataFrame, column: str, k: int, other: str = "Other") -> DataFrame:
    """The column with all but its k most frequent values as ``other``: the data of a chart."""
    top = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k).select(F.col(column).alias("__top"))
    return df.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("__top")), "left").withColumn(column, F.coalesce("__top", F.lit(other))).drop("__top")


def analysis(df: DataFrame) -> dict[str, DataFrame]:
    """All tables of a normalised review frame by name."""
    dated, spatial = df.where("has_year"), df.where("is_spatial")
    detailed = spatial.where("has_detail")
    topics = ordered_values(df, "topic_name")
    years, levels, spaces = pivot(dated, "year_number", "topic_name", topics), pivot(spatial, "level_name", "topic_name", topics), pivot(detailed, "detail_name", "topic_name", topics)
    return {
        "data": df, "year_topic_count": with_totals(years), "year_topic_share": shares(years), "year_level_count": with_totals(pivot(dated, "year_number", "level_name")), "year_flag": flags_by_year(dated, "year_number", "flag_name"), "level_share": level_share(df, "level_name", "is_spatial"),
        "level_topic_count": with_totals(levels), "level_topic_share": shares(levels), "space_count": ranked(detailed, "detail_name", "year_number", df.count()), "space_topic_count": with_totals(spaces), "space_topic_share": shares(spaces), "topic_space_top": top_per_group(detailed, "topic_name", "detail_name", 10),
    }
