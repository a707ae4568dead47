"""Classification metrics as aggregates: overall, by group, chunk, class and cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators.align import ROW, share

ALL = "__OVERALL__"


def rate(condition: Column, digits: int = 6) -> Column:
    """The share of a group's rows that meet a condition; rows where it is null don't."""
    return F.round(F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0)), digits)


def cells_of(truth: Column | str, pred: Column | str) -> dict[str, Column]:
    """Aggregates TP, TN, FP, FN, total of raw labels; rows with any other value count in the total alone."""
    t, p = cells.binary(truth), cells.binary(pred)
    return {"tp": F.count_if((t == 1) & (p == 1)), "tn": F.count_if((t == 0) & (p == 0)), "fp": F.count_if((t == 0) & (p == 1)), "fn": F.count_if((t == 1) & (p == 0)), "total": F.count("*")}


def scores() -> dict[str, Column]:
    """Accuracy (0 to 100), precision, recall and F1 (0 to 1) from columns tp, tn, fp, fn, total."""
    c = F.col
    p, r = share("tp", c("tp") + c("fp")), share("tp", c("tp") + c("fn"))
    return {"accuracy": F.round(share(c("tp") + c("tn"), "total") * 100, 4), "correct": c("tp") + c("tn"), "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(share(2 * p * r, p + r), 6)}


def binary(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), also: dict[str, Column] | None = None) -> DataFrame:
    """Counts and scores of binary labels for each group; ``also`` adds aggregates."""
    aggs = {**cells_of(truth, pred), **(also or {})}
    grouped = (df.groupBy(*by) if by else df.groupBy()).agg(*(v.alias(k) for k, v in aggs.items()))
    return grouped.withColumns(scores())


def decided(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over rows that both sides decide, 0 to 1, with coverage, specificity and balanced accuracy."""
    t, p = cells.decided(truth), cells.decided(pred)
    ok = t.isNotNull() & p.isNotNull()
    n = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("decided"), F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn")
    )
    c = F.col
    pr, re, sp = share("tp", c("tp") + c("fp")), share("tp", c("tp") + c("fn")), share("tn", c("tn") + c("fp"))
    r6 = lambda x: F.round(x, 6)
    return n.withColumns(
        {
            "unknown": c("total") - c("decided"), "coverage": r6(share("decided", "total")), "accuracy": r6(share(c("tp") + c("tn"), "decided")), "precision": r6(pr), "recall": r6(re), "specificity": r6(sp), "f1": r6(share(2 * pr * re, pr + re)),
            "balanced_accuracy": r6(F.when(c("decided") > 0, (re + sp) / 2).otherwise(0.0)), "truth_positive_rate": r6(share(c("tp") + c("fn"), "decided")), "pred_positive_rate": r6(share(c("tp") + c("fp"), "decided")),
        }
    )


def fields(df: DataFrame, specs: Sequence[tuple[str, str | None, str | None, str]], file: str, least: float = 0.6) -> DataFrame:
    """A metric row for each field: (name, truth column, prediction column, kind: binary, level or description).

    A field without a pair of columns has null accuracy and total 0; only
    binary fields have precision, recall and F1.
    """
    out = None
    for name, truth, pred, kind in specs:
        if truth is None or pred is None:
            row = df.groupBy().agg(F.lit(0).cast("long").alias("correct"), F.lit(0).cast("long").alias("total"), *(F.lit(0).cast("long").alias(k) for k in ("tp", "tn", "fp", "fn")))
        elif kind == "binary":
            t, p = cells.binary(truth), cells.binary(pred)
            row = df.groupBy().agg(F.count_if((t == p) & p.isin(0, 1)).alias("correct"), *(v.alias(k) for k, v in cells_of(truth, pred).items()))
        else:
            ok = cells.same_level(truth, pred) if kind == "level" else cells.same_description(truth, pred, least)
            row = df.groupBy().agg(F.count_if(ok).alias("correct"), F.count("*").alias("total"), *(F.lit(0).cast("long").alias(k) for k in ("tp", "tn", "fp", "fn")))
        s = scores()
        null = F.lit(None).cast("double")
        paired = truth is not None and pred is not None
        row = row.select(
            F.lit(file).alias("file"), F.lit(name).alias("metric"), (F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total") * 100, 4)) if paired else null).alias("accuracy"), "correct", "total", "tp", "tn", "fp", "fn",
            *((s[k] if kind == "binary" and paired else null).alias(k) for k in ("precision", "recall", "f1")),
        )
        out = row if out is None else out.unionByName(row)
    return out


def differences(df: DataFrame, specs: Sequence[tuple[str, str | None, str | None, str]], keep: Sequence[str], least: float = 0.6) -> DataFrame:
    """Row by row: both sides of each field, and 1 where they agree, 0 where not; null without a pair."""
    cols = []
    for name, truth, pred, kind in specs:
        if truth is None or pred is None:
            ok = F.lit(None).cast("int")
        elif kind == "binary":
            ok = ((cells.binary(truth) == cells.binary(pred)) & cells.binary(pred).isin(0, 1)).cast("int")
        else:
            ok = (cells.same_level(truth, pred) if kind == "level" else cells.same_description(truth, pred, least)).cast("int")
        cols += [(F.col(c) if c else F.lit(None).cast("string")).alias(f"{name}_{side}") for c, side in ((truth, "truth"), (pred, "pred"))] + [ok.alias(f"diff_{name}")]
    return df.select(*keep, *cols)


def with_chunk(df: DataFrame, size: int, order: str = ROW) -> DataFrame:
    """Adds ``_position`` (from 0 by order) and ``chunk`` (from 1, of ``size`` rows each).

    Positions come from counts of range partitions and ranks within them, so the
    rows aren't gathered in one task.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return with_position(df, order).withColumn("chunk", (F.floor(F.col("_position") / size) + 1).cast("int"))


def numbered(df: DataFrame, order: Sequence[str], name: str = "_position", buckets: int | None = None) -> DataFrame:
    """Adds the place (from 1) of each row by columns that tell rows apart.

    Bounds from a sample of a thousand rows, taken by a hash, deal the rows out
    to ``buckets`` (a bucket for each shuffle partition, 64 at least); a row's
    place is the count of the buckets before it and its rank within its own, so
    no task gets all rows, whatever value many of them share.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.struct(*(F.col(c) for c in order))
    some = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(1000)
    bounds = [r[0] for r in some.orderBy(*order).select(own).collect()]
    bounds = bounds[:: max(1, len(bounds) // buckets)][1:]
    kinds = {c: df.schema[c].dataType for c in order}
    edges = F.array(*(F.struct(*(F.lit(b[c]).cast(kinds[c]).alias(c) for c in order)) for b in bounds)) if bounds else None
    dealt = df.withColumn("__b", F.size(F.filter(edges, lambda e: e <= own)) if bounds else F.lit(0))
    counts = dealt.groupBy("__b").agg(F.count("*").alias("n"))
    before = counts.select("__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each bucket
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__b").withColumn(name, F.col("before") + F.col("__r")).drop("__b", "__r", "before")


def with_position(df: DataFrame, order: str = ROW, buckets: int | None = None) -> DataFrame:
    """Adds ``_position``, the number of rows that come before by ``order`` (a unique number)."""
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if ends["lo"] is None:
        return df.withColumn("_position", F.lit(0).cast("long"))
    lo, width = ends["lo"], max(1, -(-(ends["hi"] - ends["lo"] + 1) // buckets))
    dealt = df.withColumn("__b", F.floor((F.col(order) - lo) / width).cast("int"))
    counts = dealt.groupBy("__b").agg(F.count("*").alias("n"))
    before = counts.select("__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(order)))
    return ranked.join(F.broadcast(before), "__b").withColumn("_position", F.col("before") + F.col("__r") - 1).drop("__b", "__r", "before")


def chunked(df: DataFrame, truth: str, pred: str, size: int = 100, order: str = ROW) -> DataFrame:
    """Binary metrics of every ``size`` rows, with both positive rates."""
    t, p = cells.binary(truth), cells.binary(pred)
    out = binary(with_chunk(df, size, order), truth, pred, ["chunk"], {"truth_positive_rate": rate(t == 1), "predicted_positive_rate": rate(p == 1)})
    return out.withColumns({"chunk_start": (F.col("chunk") - 1) * size + 1, "chunk_end": (F.col("chunk") - 1) * size + F.col("total")})


def roll_up(metrics: DataFrame, by: Sequence[str] = ("metric",), file: str = "__GLOBAL__") -> DataFrame:
    """Micro-averages of metric rows; metrics without any precision stay without."""
    g = metrics.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("correct", "total", "tp", "tn", "fp", "fn")), F.count("precision").alias("__has"))
    s = scores()
    acc = F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total") * 100, 4))
    return g.select(F.lit(file).alias("file"), *by, acc.alias("accuracy"), "correct", "total", "tp", "tn", "fp", "fn", *(F.when(F.col("__has") > 0, s[k]).alias(k) for k in ("precision", "recall", "f1")))


def themes(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One-against-rest metrics of each label, and a row for the exact match of all; rows without a true label stay out."""
    w = df.select(cells.topic(truth).alias("t"), cells.topic(pred).alias("p")).where("t <> ''")
    pairs = w.groupBy("t", "p").agg(F.count("*").alias("n"))
    by_t = pairs.groupBy(F.col("t").alias("theme")).agg(F.sum("n").alias("truth_support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_p = pairs.where("p <> ''").groupBy(F.col("p").alias("theme")).agg(F.sum("n").alias("pred_support"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = by_t.join(by_p, "theme", "full").select("theme", z("truth_support").alias("truth_support"), z("pred_support").alias("pred_support"), z("tp").alias("tp"))
    each = each.withColumns({"fp": F.col("pred_support") - F.col("tp"), "fn": F.col("truth_support") - F.col("tp"), "tn": F.lit(0)}).withColumn("total", F.col("truth_support"))
    s = scores()
    rows = each.select("theme", cells.family("theme").alias("theme_group"), F.round(share("tp", "truth_support") * 100, 4).alias("accuracy"), F.col("tp").alias("correct"), "total", "truth_support", "pred_support", "tp", "fp", "fn", s["precision"].alias("precision"), s["recall"].alias("recall"), s["f1"].alias("f1"))
    n = pairs.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("correct")).where("total > 0")
    null = lambda k, a: F.lit(None).cast(k).alias(a)
    overall = n.select(F.lit(ALL).alias("theme"), F.lit("").alias("theme_group"), F.round(F.col("correct") / F.col("total") * 100, 4).alias("accuracy"), "correct", "total", F.col("total").alias("truth_support"), F.col("total").alias("pred_support"), null("long", "tp"), null("long", "fp"), null("long", "fn"), null("double", "precision"), null("double", "recall"), null("double", "f1"))
    return overall.unionByName(rows)


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts of each pair of labels, for rows with a true label."""
    return df.select(cells.topic(truth).alias("truth_theme"), cells.topic(pred).alias("pred_theme")).where("truth_theme <> ''").groupBy("truth_theme", "pred_theme").agg(F.count("*").alias("count"))


def families(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Binary metrics of label families, over rows where both sides have one; no row if none has."""
    known = lambda c: F.when(cells.family(c) == cells.IN, "1").when(cells.family(c) == cells.OUT, "0")
    w = df.select(known(truth).alias("t"), known(pred).alias("p")).where("t is not null and p is not null")
    return binary(w, "t", "p").where("total > 0")


def unknown_rate(df: DataFrame, pred: str, truth: str | None = None) -> DataFrame:
    p, t = cells.topic(pred), cells.topic(truth) if truth else F.lit("")
    n = df.agg(F.count("*").alias("total_samples"), F.count_if(t != "").alias("theme_truth_samples"), F.count_if(p == cells.UNKNOWN).alias("predicted_unknown_count"), F.count_if(t == cells.UNKNOWN).alias("truth_unknown_count"))
    return n.withColumns({"predicted_unknown_rate": F.round(share("predicted_unknown_count", "total_samples"), 6), "truth_unknown_rate": F.round(share("truth_unknown_count", "theme_truth_samples"), 6)})


def filled(c: str, name: str) -> Column:
    """A grouping column with null and empty as ``name``."""
    return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", name).otherwise(F.col(c).cast("string"))


def by_source(df: DataFrame, truth: str, pred: str, source: str, topic: str | None = None) -> DataFrame:
    """Metrics of each decision source, with its positive rate and its rate of unknown topics."""
    unknown = rate(cells.topic(topic) == cells.UNKNOWN) if topic else F.lit(0.0)
    return binary(df.withColumn("decision_source", filled(source, "missing")), truth, pred, ["decision_source"], {"predicted_positive_rate": rate(cells.binary(pred) == 1), "unknown_topic_rate": unknown})


def topic_distribution(df: DataFrame, topic: str, truth: str, pred: str) -> DataFrame:
    t, p = cells.binary(truth), cells.binary(pred)
    w = df.withColumn("topic_final", F.when(cells.topic(topic) == "", cells.UNKNOWN).otherwise(cells.topic(topic)))
    g = w.groupBy("topic_final").agg(F.count("*").alias("count"), rate(t == 1).alias("truth_positive_rate"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"))
    return g.withColumns({"share": F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6), "topic_group": cells.family("topic_final")})


def by_boundary(df: DataFrame, truth: str, pred: str, bucket: str, pattern: str, topic: str) -> DataFrame:
    w = df.withColumns({"boundary_bucket": filled(bucket, "unclassified"), "conflict_pattern": filled(pattern, "unknown")})
    return binary(w, truth, pred, ["boundary_bucket", "conflict_pattern"], {"unknown_count": F.count_if(cells.topic(topic) == cells.UNKNOWN)})


def unknown_conflicts(df: DataFrame, topic: str, keys: Sequence[str]) -> DataFrame:
    """Counts of rows of unknown topic by keys; null keys are groups of their own."""
    return df.where(cells.topic(topic) == cells.UNKNOWN).groupBy(*keys).agg(F.count("*").alias("count"))


def explainability(df: DataFrame, columns: Sequence[str], review_flag: str, review_reason: str, consistency: str) -> DataFrame:
    """Coverage of explanation columns, and counts of reviews, near thresholds and conflicts."""
    reason = F.coalesce(F.col(review_reason).cast("string"), F.lit(""))
    flagged = cells.flag_number(review_flag) > 0
    conflict = F.rlike(reason, F.lit("(?i)conflict|inconsistency")) | (cells.flag_number(consistency) > 0)
    return df.agg(F.count("*").alias("total"), *(rate(cells.is_present(c)).alias(f"{c}_coverage") for c in columns), F.count_if(flagged).alias("review_count"), rate(flagged).alias("review_rate"), F.count_if(F.contains(reason, F.lit("binary_near_threshold"))).alias("near_threshold_count"), F.count_if(conflict).alias("conflict_count"))


def by_balance(df: DataFrame, truth: str, pred: str, balance: str, review_flag: str) -> DataFrame:
    w = df.withColumn("evidence_balance", F.when(cells.is_present(balance), cells.text_of(balance)).otherwise("missing"))
    return binary(w, truth, pred, ["evidence_balance"], {"predicted_positive_rate": rate(cells.binary(pred) == 1), "review_rate": rate(cells.flag_number(review_flag) > 0)})


def number(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def cluster_quality(df: DataFrame, cluster: str, pool: str, status: str, confidence: str) -> DataFrame:
    here, p, s = cells.is_cluster(cluster), cells.text_of(pool), cells.text_of(status)
    n = df.agg(
        F.count("*").alias("total"), F.count_if(p != "").alias("pool_count"), F.count_distinct(F.when(here, F.col(cluster))).alias("cluster_count"), rate(here).alias("cluster_coverage"), F.count_if(p == "unknown_pool").alias("unknown_pool_count"),
        F.count_if(here & (p == "unknown_pool")).alias("__u"), *(F.count_if(s == v).alias(f"{v}_count") for v in STATUSES), F.round(F.coalesce(F.avg(number(confidence)), F.lit(0.0)), 6).alias("mean_confidence"),
    )
    return n.withColumn("unknown_cluster_coverage", F.round(share("__u", "unknown_pool_count"), 6)).drop("__u")


#: What a cluster can be to the fixed topics (fixed values).
STATUSES = ("mapped_to_fixed", "candidate_new_urban_topic", "candidate_new_nonurban_topic", "needs_review")


def first_present(c: str, order: str = ROW) -> Column:
    """Aggregate: the first present value by order, trimmed; empty text if there is none."""
    ok = cells.is_present(c)
    return F.coalesce(F.min_by(F.when(ok, cells.text_of(c)), F.when(ok, F.col(order))), F.lit(""))


def cluster_distribution(df: DataFrame, cluster: str, truth: str, pred: str, topic: str, confidence: str, attributes: Sequence[str], order: str = ROW) -> DataFrame:
    """Size, share, rates, mean confidence and first attributes of each cluster."""
    w = df.where(cells.is_cluster(cluster))
    unknown = F.when(cells.topic(topic) == "", cells.UNKNOWN).otherwise(cells.topic(topic)) == cells.UNKNOWN
    g = w.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("count"), rate(cells.binary(pred) == 1).alias("predicted_positive_rate"), rate(cells.binary(truth) == 1).alias("truth_positive_rate"), rate(unknown).alias("unknown_topic_rate"), F.round(F.coalesce(F.avg(number(confidence)), F.lit(0.0)), 6).alias("mean_confidence"),
        *(first_present(a, order).alias(a) for a in attributes),
    )
    return g.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6))


def cluster_candidates(distribution: DataFrame, status: str) -> DataFrame:
    """The clusters that aren't mapped to a fixed topic."""
    return distribution.where(F.col(status).isin(*STATUSES[1:]))


def crosswalk(df: DataFrame, cluster: str, topic: str) -> DataFrame:
    """Counts of each cluster and topic, and the share within the cluster."""
    t = F.when(cells.topic(topic) == "", cells.UNKNOWN).otherwise(cells.topic(topic))
    g = df.where(cells.is_cluster(cluster)).groupBy(F.col(cluster).alias("cluster"), t.alias("topic_final")).agg(F.count("*").alias("count"))
    return g.withColumns({"topic_group": cells.family("topic_final"), "share_within": F.round(F.col("count") / F.sum("count").over(Window.partitionBy("cluster")), 6)})


def recommendations(df: DataFrame, action: str, label: str, priority: str, confidence: str, pred: str) -> DataFrame:
    w = df.where(cells.is_present(action)).select(cells.text_of(action).alias("action"), cells.text_of(label).alias("label"), cells.text_of(priority).alias("priority"), number(confidence).alias("c"), cells.binary(pred).alias("p"))
    g = w.groupBy("action", "label", "priority").agg(F.count("*").alias("total"), rate(F.col("p") == 1).alias("positive_rate"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean_confidence"))
    return g.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


#: Parse reasons that count as fallbacks (fixed values).
FALLBACKS = ("fallback_first_digit", "fallback_boolean_yes", "no_label_detected", "empty_text", "missing_parse_reason")


def warnings(positive: Column, empty: Column, fallback: Column) -> Column:
    """The guardrails' warnings for a chunk's rates."""
    w = F.array_compact(F.array(F.when(positive <= 0.01, "predicted_positive_rate_near_zero"), F.when(empty > 0, "empty_response_detected"), F.when(fallback >= 0.2, "high_parse_fallback_rate")))
    return F.array_join(w, ";")


def guardrails(df: DataFrame, pred: str, reason: str, size: int = 100, order: str = ROW) -> DataFrame:
    """Positive, empty and fallback rates of every ``size`` predictions, with warnings."""
    r = F.coalesce(F.col(reason), F.lit("missing_parse_reason"))
    share_of = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = with_chunk(df, size, order).groupBy("chunk").agg(F.count("*").alias("total"), share_of(cells.binary(pred) == 1).alias("p"), share_of(r == "empty_response").alias("e"), share_of(r.isin(*FALLBACKS)).alias("f"))
    return g.select("chunk", ((F.col("chunk") - 1) * size + 1).alias("chunk_start"), ((F.col("chunk") - 1) * size + F.col("total")).alias("chunk_end"), "total", F.round("p", 6).alias("predicted_positive_rate"), F.round("e", 6).alias("empty_response_rate"), F.round("f", 6).alias("parse_fallback_rate"), warnings(F.col("p"), F.col("e"), F.col("f")).alias("warnings"))


def check_accuracy(metrics: DataFrame, context: str) -> None:
    """Raise if an accuracy lies outside 0 to 100."""
    bad = metrics.where((F.col("accuracy") < 0) | (F.col("accuracy") > 100)).limit(5).collect()
    if bad:
        raise ValueError(f"{context}: accuracy outside 0 to 100: {[r.asDict() for r in bad]}")


def stability(metrics: DataFrame, unknown: DataFrame, runs: DataFrame, accuracy_delta: float = 1.5, f1_delta: float = 0.015) -> DataFrame:
    """How far runs that differ only in order agree: means, largest deltas, and whether order matters.

    ``metrics``: file, accuracy, precision, recall, f1; ``unknown``: file,
    unknown_count; ``runs``: file, signature, order_id.
    """
    m = metrics.join(runs, "file").join(unknown.select("file", "unknown_count"), "file", "left")
    g = m.groupBy("signature").agg(
        F.count("*").alias("run_count"), F.array_join(F.array_sort(F.collect_set(F.col("order_id").cast("string"))), ", ").alias("orders"), *(F.avg(c).alias(f"mean_{c}") for c in ("accuracy", "precision", "recall", "f1")),
        (F.max("accuracy") - F.min("accuracy")).alias("max_delta_accuracy"), (F.max("f1") - F.min("f1")).alias("max_delta_f1"), F.min("unknown_count").alias("unknown_min"), F.max("unknown_count").alias("unknown_max"), F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("files"),
    )
    return g.withColumns({"unknown_range": F.col("unknown_max") - F.col("unknown_min"), "order_sensitive": (F.col("max_delta_accuracy") > accuracy_delta) | (F.col("max_delta_f1") > f1_delta)})


def group_summaries(metrics: DataFrame, runs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Micro-averages for each comparability signature (runs: file, signature), without the excluded files."""
    kept = runs.join(excluded, "file", "left_anti")
    return roll_up(metrics.join(kept, "file"), ["signature", "metric"])


def model_flags(df: DataFrame, truth: str, preds: Sequence[str]) -> DataFrame:
    """Adds ``<model>_correct`` for each prediction column: 1 where both are decided and equal."""
    return df.withColumns({f"{p}_correct": F.coalesce((cells.decided(truth) == cells.decided(p)).cast("int"), F.lit(0)) for p in preds})


def disagreements(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """The rows where any two models' predictions differ; undecided counts as a value."""
    v = [F.coalesce(cells.decided(p), F.lit(-1)) for p in preds]
    out = F.lit(False)
    for a, b in zip(v, v[1:]):
        out = out | (a != b)
    return df.where(out)


def long_form(row: DataFrame, columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A row for each named column of a frame."""
    args = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {args}) as ({name}, {value})")


def token_documents(tokens: DataFrame, label: str, least: int = 2) -> DataFrame:
    """In how many documents of either class each token occurs (tokens: one row for a document's distinct token)."""
    g = tokens.groupBy("token").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return g.where(F.col("pos") + F.col("neg") >= least)
