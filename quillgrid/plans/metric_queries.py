"""Queries of the metrics (A01 to A40)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators import metrics as M
from quillgrid.plans import frames as D
from quillgrid.plans.registry import query

_E = D.duck(D.EVAL)


def ev(spark, sf):
    return D.spark_frame(spark, sf, D.EVAL)


def q(name: str, sql: str | None):
    return query(name, None if sql is None else f"WITH e AS ({_E}) {sql}")


@q("a01_binary_metrics", f"SELECT *, {D.scores()} FROM (SELECT {D.counts('truth', 'pred')} FROM e)")
def a01(spark, sf):
    return M.binary(ev(spark, sf), "truth", "pred")


_SPECS = (("target", "truth", "pred", "binary"), ("level", "level_truth", "level_pred", "level"), ("area", "area_truth", "area_pred", "description"), ("spatial", None, None, "binary"))
_LEVEL = "(CASE WHEN {t} IN ('全国', '国家') THEN 3 WHEN contains(lower({t}), 'global') THEN 1 WHEN contains(lower({t}), 'nation') THEN 3 WHEN contains(lower({t}), 'single city') OR contains(lower({t}), 'city-wide') THEN 7 WHEN contains(lower({t}), 'block') OR contains(lower({t}), 'street') THEN 9 ELSE coalesce(try_cast(regexp_extract({t}, '\\b([1-9])\\b', 1) AS INTEGER), -1) END)"
_LT, _LP = (_LEVEL.replace("{t}", f"trim(coalesce({c}, 'nan'))") for c in ("level_truth", "level_pred"))
_DESC = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split(" + _DESC + ", ' '), lambda x: x <> ''))"
_AT, _AP = (_DESC.replace("{c}", c) for c in ("area_truth", "area_pred"))
_WT, _WP = (_WORDS.replace("{c}", c) for c in ("area_truth", "area_pred"))
_SAME_LEVEL = f"(CASE WHEN {_LT} = -1 OR {_LP} = -1 THEN lower(trim(coalesce(level_truth, 'nan'))) = lower(trim(coalesce(level_pred, 'nan'))) ELSE {_LT} = {_LP} END)"
_SAME_AREA = f"(CASE WHEN {_AT} = 'not mentioned' OR {_AP} = 'not mentioned' OR len({_WT}) = 0 OR len({_WP}) = 0 THEN {_AT} = {_AP} ELSE len(list_intersect({_WT}, {_WP})) / CAST(len(list_distinct(list_concat({_WT}, {_WP}))) AS DOUBLE) >= 0.6 END)"
_ROW = "CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS tn, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1"
FIELDS_SQL = f"""SELECT 'run' AS file, 'target' AS metric, accuracy, correct, total, tp, tn, fp, fn, precision, recall, f1 FROM (SELECT *, {D.scores()} FROM (SELECT {D.counts('truth', 'pred')} FROM e))
UNION ALL SELECT 'run', 'level', round(count(*) FILTER ({_SAME_LEVEL}) * 100.0 / count(*), 4), count(*) FILTER ({_SAME_LEVEL}), count(*), {_ROW} FROM e
UNION ALL SELECT 'run', 'area', round(count(*) FILTER ({_SAME_AREA}) * 100.0 / count(*), 4), count(*) FILTER ({_SAME_AREA}), count(*), {_ROW} FROM e
UNION ALL SELECT 'run', 'spatial', NULL, 0, 0, {_ROW}"""


@q("a02_field_metrics", FIELDS_SQL)
def a02(spark, sf):
    return M.fields(ev(spark, sf), _SPECS, "run")


@q("a02_field_differences", f"SELECT doc_id, truth AS target_truth, pred AS target_pred, CAST(({D.binary('truth')} = {D.binary('pred')} AND {D.binary('pred')} IN (0, 1)) AS INTEGER) AS diff_target, level_truth, level_pred, CAST({_SAME_LEVEL} AS INTEGER) AS diff_level FROM e")
def a02b(spark, sf):
    return M.differences(ev(spark, sf), _SPECS[:2], ["doc_id"])


_CHUNK = "CAST(floor((row_number() OVER (ORDER BY _row_id) - 1) / {n}) AS INTEGER) + 1 AS chunk"


@q("a03_chunked_metrics", f"SELECT *, {D.scores()}, (chunk - 1) * 50 + 1 AS chunk_start, (chunk - 1) * 50 + total AS chunk_end FROM (SELECT chunk, {D.counts('truth', 'pred')}, {D.rate(D.binary('truth') + ' = 1')} AS truth_positive_rate, {D.rate(D.binary('pred') + ' = 1')} AS predicted_positive_rate FROM (SELECT *, {_CHUNK.format(n=50)} FROM e) GROUP BY chunk)")
def a03(spark, sf):
    return M.chunked(ev(spark, sf), "truth", "pred", 50)


def three_runs(spark, sf):
    df = ev(spark, sf)
    out = None
    for p in ("pred", "pred_b", "pred_c"):
        one = M.fields(df, [("target", "truth", p, "binary"), ("area", "area_truth", "area_pred", "description")], p)
        out = one if out is None else out.unionByName(one)
    return out


_RUN = "SELECT '{p}' AS file, 'target' AS metric, accuracy, correct, total, tp, tn, fp, fn, precision, recall, f1 FROM (SELECT *, {s} FROM (SELECT {c} FROM e)) UNION ALL SELECT '{p}', 'area', round(count(*) FILTER ({a}) * 100.0 / count(*), 4), count(*) FILTER ({a}), count(*), {r} FROM e"
RUNS_SQL = " UNION ALL ".join(_RUN.format(p=p, s=D.scores(), c=D.counts("truth", p), a=_SAME_AREA, r=_ROW) for p in ("pred", "pred_b", "pred_c"))
_SUMS = "CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(precision) AS has"
_P, _R = D.share("tp", "tp + fp"), D.share("tp", "tp + fn")
_ROLL = f"round(correct * 100.0 / total, 4) AS accuracy, correct, total, tp, tn, fp, fn, CASE WHEN has > 0 THEN round({_P}, 6) END AS precision, CASE WHEN has > 0 THEN round({_R}, 6) END AS recall, CASE WHEN has > 0 THEN round({D.share(f'2 * {_P} * {_R}', f'{_P} + {_R}')}, 6) END AS f1"


@q("a04_metric_roll_up", f"SELECT '__GLOBAL__' AS file, metric, {_ROLL} FROM (SELECT metric, {_SUMS} FROM ({RUNS_SQL}) GROUP BY metric)")
def a04(spark, sf):
    return M.roll_up(three_runs(spark, sf))


_TH = f"w AS (SELECT {D.topic('theme_truth')} AS t, {D.topic('topic_final')} AS p FROM e)"
_ONE = "CAST(count(*) FILTER (t = theme) AS BIGINT) AS truth_support, CAST(count(*) FILTER (p = theme) AS BIGINT) AS pred_support, CAST(count(*) FILTER (t = theme AND p = theme) AS BIGINT) AS tp"


@q(
    "a05_theme_metrics",
    f""", {_TH}, v AS (SELECT * FROM w WHERE t <> ''), l AS (SELECT DISTINCT t AS theme FROM v UNION SELECT DISTINCT p FROM v WHERE p <> ''),
g AS (SELECT theme, {_ONE} FROM l, v GROUP BY theme), h AS (SELECT *, pred_support - tp AS fp, truth_support - tp AS fn, 0 AS tn, truth_support AS total FROM g)
SELECT theme, {D.family('theme')} AS theme_group, accuracy, correct, total, truth_support, pred_support, tp, fp, fn, precision, recall, f1 FROM (SELECT *, {D.scores('tp')} FROM h)
UNION ALL SELECT '__OVERALL__', '', round(count(*) FILTER (t = p) * 100.0 / count(*), 4), count(*) FILTER (t = p), count(*), count(*), count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM v""".replace("SELECT theme,", "SELECT theme,"),
)
def a05(spark, sf):
    return M.themes(ev(spark, sf), "theme_truth", "topic_final")


@q("a06_theme_confusion", f", {_TH} SELECT t AS truth_theme, p AS pred_theme, count(*) AS count FROM w WHERE t <> '' GROUP BY t, p")
def a06(spark, sf):
    return M.confusion(ev(spark, sf), "theme_truth", "topic_final")


@q("a07_family_metrics", f", f AS (SELECT CASE {D.family('theme_truth')} WHEN 'urban' THEN '1' WHEN 'nonurban' THEN '0' END AS t, CASE {D.family('topic_final')} WHEN 'urban' THEN '1' WHEN 'nonurban' THEN '0' END AS p FROM e) SELECT *, {D.scores()} FROM (SELECT {D.counts('t', 'p')} FROM f WHERE t IS NOT NULL AND p IS NOT NULL)")
def a07(spark, sf):
    return M.families(ev(spark, sf), "theme_truth", "topic_final")


@q("a08_unknown_rate", f", {_TH} SELECT *, round({D.share('predicted_unknown_count', 'total_samples')}, 6) AS predicted_unknown_rate, round({D.share('truth_unknown_count', 'theme_truth_samples')}, 6) AS truth_unknown_rate FROM (SELECT count(*) AS total_samples, count(*) FILTER (t <> '') AS theme_truth_samples, count(*) FILTER (p = 'Unknown') AS predicted_unknown_count, count(*) FILTER (t = 'Unknown') AS truth_unknown_count FROM w)")
def a08(spark, sf):
    return M.unknown_rate(ev(spark, sf), "topic_final", "theme_truth")


_SRC = "CASE WHEN coalesce(decision_source, '') = '' THEN 'missing' ELSE decision_source END"


@q("a09_decision_source_metrics", f"SELECT *, {D.scores()} FROM (SELECT {_SRC} AS decision_source, {D.counts('truth', 'pred')}, {D.rate(D.binary('pred') + ' = 1')} AS predicted_positive_rate, {D.rate(D.topic('topic_final') + chr(32) + chr(61) + chr(32) + repr('Unknown'))} AS unknown_topic_rate FROM e GROUP BY 1)")
def a09(spark, sf):
    return M.by_source(ev(spark, sf), "truth", "pred", "decision_source", "topic_final")


_TF = f"CASE WHEN {D.topic('topic_final')} = '' THEN 'Unknown' ELSE {D.topic('topic_final')} END"
_BT, _BP = D.binary("truth"), D.binary("pred")


@q("a10_topic_distribution", f", x AS (SELECT *, {_TF} AS tf FROM e) SELECT tf AS topic_final, {D.family('tf')} AS topic_group, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, {D.rate(_BT + ' = 1')} AS truth_positive_rate, count(*) FILTER ({_BT} = 0 AND {_BP} = 1) AS fp, count(*) FILTER ({_BT} = 1 AND {_BP} = 0) AS fn FROM x GROUP BY tf")
def a10(spark, sf):
    return M.topic_distribution(ev(spark, sf), "topic_final", "truth", "pred")


@q("a11_boundary_metrics", f"SELECT *, {D.scores()} FROM (SELECT CASE WHEN coalesce(boundary_bucket, '') = '' THEN 'unclassified' ELSE boundary_bucket END AS boundary_bucket, CASE WHEN coalesce(conflict_pattern, '') = '' THEN 'unknown' ELSE conflict_pattern END AS conflict_pattern, {D.counts('truth', 'pred')}, count(*) FILTER ({D.topic('topic_final')} = 'Unknown') AS unknown_count FROM e GROUP BY 1, 2)")
def a11(spark, sf):
    return M.by_boundary(ev(spark, sf), "truth", "pred", "boundary_bucket", "conflict_pattern", "topic_final")


@q("a12_unknown_conflicts", f"SELECT review_reason, boundary_bucket, conflict_pattern, theme_truth, lang, candidate_label, count(*) AS count FROM e WHERE {D.topic('topic_final')} = 'Unknown' GROUP BY ALL")
def a12(spark, sf):
    return M.unknown_conflicts(ev(spark, sf), "topic_final", ["review_reason", "boundary_bucket", "conflict_pattern", "theme_truth", "lang", "candidate_label"])


_FL = D.flag("review_flag")


@q("a13_explainability", f"SELECT count(*) AS total, {D.rate(D.present('decision_explanation'))} AS decision_explanation_coverage, {D.rate(D.present('evidence_balance'))} AS evidence_balance_coverage, count(*) FILTER ({_FL} > 0) AS review_count, {D.rate(_FL + ' > 0')} AS review_rate, count(*) FILTER (contains(coalesce(review_reason, ''), 'binary_near_threshold')) AS near_threshold_count, count(*) FILTER (regexp_matches(coalesce(review_reason, ''), '(?i)conflict|inconsistency') OR {D.flag('consistency')} > 0) AS conflict_count FROM e")
def a13(spark, sf):
    return M.explainability(ev(spark, sf), ["decision_explanation", "evidence_balance"], "review_flag", "review_reason", "consistency")


@q("a14_evidence_balance", f"SELECT *, {D.scores()} FROM (SELECT CASE WHEN {D.present('evidence_balance')} THEN {D.text('evidence_balance')} ELSE 'missing' END AS evidence_balance, {D.counts('truth', 'pred')}, {D.rate(_BP + ' = 1')} AS predicted_positive_rate, {D.rate(_FL + ' > 0')} AS review_rate FROM e GROUP BY 1)")
def a14(spark, sf):
    return M.by_balance(ev(spark, sf), "truth", "pred", "evidence_balance", "review_flag")


_CL, _NUM = D.clustered("cluster"), "try_cast(cluster_confidence AS DOUBLE)"


@q("a15_cluster_quality", f"SELECT * EXCLUDE (u), round({D.share('u', 'unknown_pool_count')}, 6) AS unknown_cluster_coverage FROM (SELECT count(*) AS total, count(*) FILTER ({D.text('source_pool')} <> '') AS pool_count, count(DISTINCT cluster) FILTER ({_CL}) AS cluster_count, {D.rate(_CL)} AS cluster_coverage, count(*) FILTER (source_pool = 'unknown_pool') AS unknown_pool_count, count(*) FILTER ({_CL} AND source_pool = 'unknown_pool') AS u, {', '.join(f'''count(*) FILTER (mapping_status = '{s}') AS {s}_count''' for s in M.STATUSES)}, round(coalesce(avg({_NUM}), 0), 6) AS mean_confidence FROM e)")
def a15(spark, sf):
    return M.cluster_quality(ev(spark, sf), "cluster", "source_pool", "mapping_status", "cluster_confidence")


def _firsts(*cols):
    return ", ".join(f"coalesce(arg_min({D.text(c)}, _row_id) FILTER ({D.present(c)}), '') AS {c}" for c in cols)


_DIST = f"SELECT cluster, count(*) AS count, {D.rate(_BP + ' = 1')} AS predicted_positive_rate, {D.rate(_BT + ' = 1')} AS truth_positive_rate, {D.rate('(' + _TF + chr(41) + ' = ' + repr('Unknown'))} AS unknown_topic_rate, round(coalesce(avg({_NUM}), 0), 6) AS mean_confidence, {_firsts('mapping_status', 'source_pool')}, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM e WHERE {_CL} GROUP BY cluster"


def dist(spark, sf):
    return M.cluster_distribution(ev(spark, sf), "cluster", "truth", "pred", "topic_final", "cluster_confidence", ["mapping_status", "source_pool"])


@q("a16_cluster_distribution", _DIST)
def a16(spark, sf):
    return dist(spark, sf)


@q("a17_cluster_crosswalk", f", x AS (SELECT cluster, {_TF} AS tf FROM e WHERE {_CL}) SELECT cluster, tf AS topic_final, {D.family('tf')} AS topic_group, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY cluster) AS DOUBLE), 6) AS share_within FROM x GROUP BY cluster, tf")
def a17(spark, sf):
    return M.crosswalk(ev(spark, sf), "cluster", "topic_final")


@q("a18_cluster_candidates", f"SELECT * FROM ({_DIST}) WHERE mapping_status IN ('candidate_new_urban_topic', 'candidate_new_nonurban_topic', 'needs_review')")
def a18(spark, sf):
    return M.cluster_candidates(dist(spark, sf), "mapping_status")


@q("a19_binary_recommendations", f"SELECT {D.text('candidate_action')} AS action, {D.text('candidate_label')} AS label, {D.text('review_priority')} AS priority, count(*) AS total, {D.rate(_BP + ' = 1')} AS positive_rate, round(coalesce(avg({_NUM}), 0), 6) AS mean_confidence, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM e WHERE {D.present('candidate_action')} GROUP BY 1, 2, 3")
def a19(spark, sf):
    return M.recommendations(ev(spark, sf), "candidate_action", "candidate_label", "review_priority", "cluster_confidence", "pred")


@q("a20_first_present", f"SELECT lang, {_firsts('evidence_balance', 'decision_explanation')} FROM e GROUP BY lang")
def a20(spark, sf):
    return ev(spark, sf).groupBy("lang").agg(*(M.first_present(c).alias(c) for c in ("evidence_balance", "decision_explanation")))


@q("a23_accuracy_bounds", f"SELECT count(*) FILTER (accuracy < 0 OR accuracy > 100) AS outside, count(*) AS metrics FROM ({RUNS_SQL})")
def a23(spark, sf):
    m = three_runs(spark, sf)
    M.check_accuracy(m, "three runs")
    return m.agg(F.count_if((F.col("accuracy") < 0) | (F.col("accuracy") > 100)).alias("outside"), F.count("*").alias("metrics"))


_GR = "coalesce(parse_reason, 'missing_parse_reason')"


@q(
    "a24_guardrails",
    f""", g AS (SELECT chunk, count(*) AS total, avg(CASE WHEN {_BP} = 1 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN {_GR} = 'empty_response' THEN 1.0 ELSE 0.0 END) AS x, avg(CASE WHEN {_GR} IN ('fallback_first_digit', 'fallback_boolean_yes', 'no_label_detected', 'empty_text', 'missing_parse_reason') THEN 1.0 ELSE 0.0 END) AS f FROM (SELECT *, {_CHUNK.format(n=20)} FROM e) GROUP BY chunk)
SELECT chunk, (chunk - 1) * 20 + 1 AS chunk_start, (chunk - 1) * 20 + total AS chunk_end, total, round(p, 6) AS predicted_positive_rate, round(x, 6) AS empty_response_rate, round(f, 6) AS parse_fallback_rate, array_to_string(list_filter([CASE WHEN p <= 0.01 THEN 'predicted_positive_rate_near_zero' END, CASE WHEN x > 0 THEN 'empty_response_detected' END, CASE WHEN f >= 0.2 THEN 'high_parse_fallback_rate' END], lambda w: w IS NOT NULL), ';') AS warnings FROM g""",
)
def a24(spark, sf):
    return M.guardrails(ev(spark, sf), "pred", "parse_reason", 20)


_UN = "SELECT '{p}' AS file, count(*) FILTER ({t} = 'Unknown' AND {b} = 1) AS unknown_count FROM e"
_UNK = " UNION ALL ".join(_UN.format(p=p, t=D.topic("topic_final"), b=D.binary(p)) for p in ("pred", "pred_b", "pred_c"))
_RUNTAB = "(VALUES ('pred', 's1', 'o1'), ('pred_b', 's1', 'o2'), ('pred_c', 's2', 'o1')) AS r(file, signature, order_id)"


def runs(spark):
    return spark.createDataFrame([("pred", "s1", "o1"), ("pred_b", "s1", "o2"), ("pred_c", "s2", "o1")], "file string, signature string, order_id string")


@q(
    "a25_order_stability",
    f", m AS (SELECT * FROM ({RUNS_SQL}) WHERE metric = 'target'), u AS ({_UNK}) SELECT *, unknown_max - unknown_min AS unknown_range, max_delta_accuracy > 1.5 OR max_delta_f1 > 0.015 AS order_sensitive FROM (SELECT signature, count(*) AS run_count, string_agg(DISTINCT order_id, ', ' ORDER BY order_id) AS orders, avg(accuracy) AS mean_accuracy, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, max(accuracy) - min(accuracy) AS max_delta_accuracy, max(f1) - min(f1) AS max_delta_f1, min(unknown_count) AS unknown_min, max(unknown_count) AS unknown_max, string_agg(file, ', ' ORDER BY file) AS files FROM m JOIN {_RUNTAB} USING (file) JOIN u USING (file) GROUP BY signature)",
)
def a25(spark, sf):
    df = ev(spark, sf)
    unknown = None
    for p in ("pred", "pred_b", "pred_c"):
        one = df.agg(F.count_if((cells.topic("topic_final") == "Unknown") & (cells.binary(p) == 1)).alias("unknown_count")).select(F.lit(p).alias("file"), "unknown_count")
        unknown = one if unknown is None else unknown.unionByName(one)
    return M.stability(three_runs(spark, sf).where("metric = 'target'"), unknown, runs(spark))


@q("a26_group_summaries", f"SELECT '__GLOBAL__' AS file, signature, metric, {_ROLL} FROM (SELECT signature, metric, {_SUMS} FROM ({RUNS_SQL}) JOIN {_RUNTAB} USING (file) WHERE file <> 'pred_b' GROUP BY signature, metric)")
def a26(spark, sf):
    excluded = spark.createDataFrame([("pred_b",)], "file string")
    return M.group_summaries(three_runs(spark, sf), runs(spark).select("file", "signature"), excluded)


_DEC = {k: (D.decided("truth"), D.decided(k)) for k in ("pred", "pred_b", "pred_c")}


def _decided_sql(p: str) -> str:
    t, b = _DEC[p]
    pr, re, sp = D.share("tp", "tp + fp"), D.share("tp", "tp + fn"), D.share("tn", "tn + fp")
    return f"""SELECT total, decided, tp, tn, fp, fn, total - decided AS unknown, round({D.share('decided', 'total')}, 6) AS coverage, round({D.share('tp + tn', 'decided')}, 6) AS accuracy, round({pr}, 6) AS precision, round({re}, 6) AS recall, round({sp}, 6) AS specificity, round({D.share(f'2 * {pr} * {re}', f'{pr} + {re}')}, 6) AS f1,
  round(CASE WHEN decided > 0 THEN ({re} + {sp}) / 2 ELSE 0 END, 6) AS balanced_accuracy, round({D.share('tp + fn', 'decided')}, 6) AS truth_positive_rate, round({D.share('tp + fp', 'decided')}, 6) AS pred_positive_rate
  FROM (SELECT count(*) AS total, count(*) FILTER ({t} IS NOT NULL AND {b} IS NOT NULL) AS decided, count(*) FILTER ({t} = 1 AND {b} = 1) AS tp, count(*) FILTER ({t} = 0 AND {b} = 0) AS tn, count(*) FILTER ({t} = 0 AND {b} = 1) AS fp, count(*) FILTER ({t} = 1 AND {b} = 0) AS fn FROM e)"""


@q("a29_decided_metrics", _decided_sql("pred_b"))
def a29(spark, sf):
    return M.decided(ev(spark, sf), "truth", "pred_b")


@q("a30_model_summary", " UNION ALL ".join(f"SELECT '{p}' AS model, * FROM ({_decided_sql(p)})" for p in _DEC))
def a30(spark, sf):
    args = ", ".join(f"'{p}', {p}" for p in _DEC)
    return M.decided(ev(spark, sf).selectExpr("truth", f"stack(3, {args}) as (model, p)"), "truth", "p", ["model"])


_OK = ", ".join(f"coalesce(CAST({t} = {b} AS INTEGER), 0) AS {p}_correct" for p, (t, b) in _DEC.items())


@q("a31_prediction_comparison", f"SELECT doc_id, {_OK} FROM e")
def a31(spark, sf):
    return M.model_flags(ev(spark, sf), "truth", list(_DEC)).select("doc_id", *(f"{p}_correct" for p in _DEC))


@q("a32_error_breakdown", f", c AS (SELECT *, {_OK} FROM e), n AS (SELECT count(*) FILTER (pred_correct = 0 AND decision_source = 'src0') AS first_stage_error, count(*) FILTER (pred_correct = 0 AND decision_source = 'src1') AS second_stage_error, count(*) FILTER (toxic = 1 AND pred_correct = 1 AND pred_b_correct = 0) AS corrected, count(*) FILTER (toxic = 1 AND pred_correct = 0) AS residual, count(*) FILTER (toxic = 1) AS calls FROM c) SELECT metric, CAST(value AS DOUBLE) AS value FROM n UNPIVOT (value FOR metric IN (first_stage_error, second_stage_error, corrected, residual, calls))")
def a32(spark, sf):
    c = M.model_flags(ev(spark, sf), "truth", ["pred", "pred_b"])
    wrong, called = F.col("pred_correct") == 0, F.col("toxic") == 1
    row = c.agg(
        F.count_if(wrong & (F.col("decision_source") == "src0")).alias("first_stage_error"), F.count_if(wrong & (F.col("decision_source") == "src1")).alias("second_stage_error"), F.count_if(called & ~wrong & (F.col("pred_b_correct") == 0)).alias("corrected"),
        F.count_if(called & wrong).alias("residual"), F.count_if(called).alias("calls"),
    )
    return M.long_form(row, row.columns)


@q("a33_source_accuracy", f", c AS (SELECT *, {_OK} FROM e) SELECT coalesce(decision_source, '') AS decision_source, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, round(avg(pred_correct), 6) AS accuracy FROM c GROUP BY 1")
def a33(spark, sf):
    from pyspark.sql import Window

    c = M.model_flags(ev(spark, sf), "truth", ["pred"]).withColumn("decision_source", F.coalesce("decision_source", F.lit("")))
    g = c.groupBy("decision_source").agg(F.count("*").alias("count"), F.round(F.avg("pred_correct"), 6).alias("accuracy"))
    return g.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6))


_V = [f"coalesce({b}, -1)" for _, b in _DEC.values()]


@q("a34_model_disagreements", f"SELECT doc_id FROM e WHERE {_V[0]} <> {_V[1]} OR {_V[1]} <> {_V[2]} OR {_V[0]} <> {_V[2]}")
def a34(spark, sf):
    return M.disagreements(ev(spark, sf), list(_DEC)).select("doc_id")


_UW = f"{D.topic('topic_final')} = 'Unknown'"


@q("a35_unknown_review", f", u AS (SELECT * FROM e WHERE {_UW}) SELECT 'Total Samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM e UNION ALL SELECT 'Unknown Samples', count(*) FROM u UNION ALL SELECT 'Unknown Rate', round((SELECT count(*) FROM u) / CAST(count(*) AS DOUBLE), 4) FROM e UNION ALL SELECT 'Truth Positive', count(*) FILTER ({_BT} = 1) FROM u UNION ALL SELECT 'Truth Negative', count(*) FILTER ({_BT} = 0) FROM u")
def a35(spark, sf):
    df = ev(spark, sf)
    unknown = cells.topic("topic_final") == "Unknown"
    t = cells.binary("truth")
    row = df.agg(F.count("*").alias("Total Samples"), F.count_if(unknown).alias("Unknown Samples"), F.round(F.avg(unknown.cast("int")), 4).alias("Unknown Rate"), F.count_if(unknown & (t == 1)).alias("Truth Positive"), F.count_if(unknown & (t == 0)).alias("Truth Negative"))
    return M.long_form(row, row.columns)


@q("a35_review_reasons", f"SELECT coalesce(review_reason, '') AS review_reason, count(*) AS count FROM e WHERE {_UW} GROUP BY 1")
def a35b(spark, sf):
    return ev(spark, sf).where(cells.topic("topic_final") == "Unknown").groupBy(F.coalesce("review_reason", F.lit("")).alias("review_reason")).agg(F.count("*").alias("count"))
