"""Queries of sources (S), sessions, prompts and manifests (U), reports (A27 to A38) and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators import metrics as M
from quillgrid.operators import report
from quillgrid.plans import frames as D
from quillgrid.plans import table_queries as TQ
from quillgrid.plans.registry import query
from quillgrid.sources import manifest as U
from quillgrid.sources import tables as S
from quillgrid.streaming import guardrails as G

_T, _E, _M = D.duck(D.TITLED), D.duck(D.EVAL), D.duck(D.MESSY)


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("s01_read_records", f"WITH t AS ({_T}) SELECT _row_id, title, abstract, '' AS author_keywords, '' AS keywords_plus, '' AS keywords, '' AS wos_categories, '' AS research_areas FROM t")
def s01(spark, sf):
    return S.records(D.spark_frame(spark, sf, D.TITLED))


@query("s02_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def s02(spark, sf):
    return S.head(read(spark, sf, "documents"), 25, "doc_id").select("doc_id")


@query("s03_positional_header", "SELECT doc_id AS title, lang AS abstract, n_chars AS is_target FROM documents")
def s03(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return d.toDF(*S.header_names(3))


@query("s12_labelled_rows", f"WITH t AS ({_T}), k AS (SELECT *, regexp_replace(lower(trim(coalesce(title, ''))), '\\s+', ' ', 'g') AS kt, lower(trim(abstract)) AS ka, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS f FROM t) SELECT doc_id FROM k QUALIFY row_number() OVER (PARTITION BY kt, ka ORDER BY f, doc_id) = 1")
def s12(spark, sf):
    t = D.spark_frame(spark, sf, D.TITLED)
    return S.labelled({"a.parquet": t.where("doc_id % 2 = 0"), "b.parquet": t.where("doc_id % 2 = 1")}, "label").select(F.col("_row_id").alias("doc_id"))


@query("f07_record", f"WITH m AS ({_M}) SELECT doc_id, CASE WHEN lower(trim(coalesce(kw2, ''))) = 'nan' THEN '' ELSE trim(coalesce(kw2, '')) END AS keywords_plus FROM m")
def f07(spark, sf):
    m = D.spark_frame(spark, sf, D.MESSY).select("doc_id", F.col("t").alias("title"), F.lit("").alias("abstract"), F.col("kw1").alias("author_keywords"), F.col("kw2").alias("keywords_plus"), F.lit("").alias("keywords"), F.lit("").alias("wos_categories"), F.lit("").alias("research_areas"))
    return S.normalised(m).select("doc_id", "keywords_plus")


@query("u11_prompt_lines", f"WITH m AS ({_M}) SELECT doc_id, concat_ws(chr(10), 'Classify', CASE WHEN {D.text('lang')} <> '' THEN 'Lang: ' || {D.text('lang')} END, CASE WHEN {D.text('kw2')} <> '' THEN 'Keywords: ' || {D.text('kw2')} END) AS prompt FROM m")
def u11(spark, sf):
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", U.prompt({"Lang": "lang", "Keywords": "kw2"}, "Classify").alias("prompt"))


@query("u13_hint_block", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang=' || lang || '; source=' || source ELSE 'lang=' || lang END AS hints FROM documents")
def u13(spark, sf):
    m = F.create_map(F.lit("source"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" "), F.lit("lang"), F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", U.hint_block(m).alias("hints"))


_KNOWN, _USED = "SELECT DISTINCT source AS name FROM documents WHERE lang = 'de'", "SELECT DISTINCT source AS name FROM documents JOIN labels USING (doc_id) WHERE quality = 0"


@query("u16_consistency", f"SELECT 'missing' AS kind, name FROM ({_KNOWN}) WHERE name NOT IN ({_USED}) UNION ALL SELECT 'orphan', name FROM ({_USED}) WHERE name NOT IN ({_KNOWN})")
def u16(spark, sf):
    d = read(spark, sf, "documents").withColumnRenamed("source", "name")
    return U.consistency(d.where("lang = 'de'").select("name").distinct(), d.join(read(spark, sf, "labels").where("quality = 0"), "doc_id").select("name").distinct())


@query("u18_context_full", "SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS characters, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) > 400 AS is_full FROM conversations")
def u18(spark, sf):
    return U.context_full(read(spark, sf, "conversations"), "conv_id", "turn", "text", 400).select("conv_id", "turn", "characters", "is_full")


#: The windows walked row by row: a new one after two rows, or behind a row that makes it longer than 400 characters.
_WALK = """WITH RECURSIVE r AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
w AS (SELECT conv_id, turn, i, 0 AS context, 1 AS have, n AS chars FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.turn, r.i, w.context + CAST(w.have >= {rows} OR w.chars > {chars} AS INTEGER), CASE WHEN w.have >= {rows} OR w.chars > {chars} THEN 1 ELSE w.have + 1 END, CASE WHEN w.have >= {rows} OR w.chars > {chars} THEN r.n ELSE w.chars + r.n END FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1)
SELECT conv_id, turn, context FROM w"""


@query("u06_context_windows", _WALK.replace("{rows}", "2").replace("{chars}", "400"))
def u06(spark, sf):
    return U.context_windows(read(spark, sf, "conversations"), "conv_id", "turn", "text", U.Limits(400, 2)).select("conv_id", "turn", "context")


@query("u21_row_signature", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS signature FROM documents")
def u21(spark, sf):
    return read(spark, sf, "documents").select("doc_id", U.row_signature("lang", "source").alias("signature"))


@query("u23_map_differences", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'a,c' END AS keys FROM documents")
def u23(spark, sf):
    one, two = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(U.map_differences(one, F.when(F.col("doc_id") % 2 == 0, one).otherwise(two)), ",").alias("keys"))


@query("u27_messages", "SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS text FROM conversations")
def u27(spark, sf):
    return U.messages(read(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", False)


@query("u09_replay_answers", "SELECT d.doc_id, l.quality AS answer FROM documents AS d LEFT JOIN labels AS l USING (doc_id)")
def u09(spark, sf):
    return U.replay(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").withColumnRenamed("quality", "answer"), "doc_id")


@query("a27_diagnostics", f"WITH t AS ({_T}), {TQ._SIDES}, n AS (SELECT (SELECT count(*) FROM a WHERE _key NOT IN (SELECT _key FROM b)) AS truth_unmatched, (SELECT count(*) FROM b WHERE _key NOT IN (SELECT _key FROM a)) AS pred_unmatched) SELECT key, CAST(value AS VARCHAR) AS value FROM n UNPIVOT (value FOR key IN (truth_unmatched, pred_unmatched))")
def a27(spark, sf):
    return report.diagnostics(TQ._aligned(spark, sf)).where("type = 'section' and key like '%unmatched'").select("key", "value")


@query("a28_protocol", f"WITH e AS ({_E}) SELECT 'accuracy_scale' AS field, '0-100' AS value UNION ALL SELECT 'decision_source_contract', string_agg(DISTINCT decision_source, ';' ORDER BY decision_source) FROM e WHERE coalesce(decision_source, '') <> ''")
def a28(spark, sf):
    return report.protocol({"accuracy_scale": "0-100"}, D.spark_frame(spark, sf, D.EVAL), "decision_source")


@query("a37_release_gates", f"WITH e AS ({_E}) SELECT lang, array_to_string(list_filter([CASE WHEN accuracy < 88 THEN 'accuracy' END, CASE WHEN precision < 0.956 THEN 'precision' END, CASE WHEN recall < 0.94 THEN 'recall' END, CASE WHEN f1 < 0.948 THEN 'f1' END, CASE WHEN fp > 34 THEN 'fp' END, CASE WHEN fn > 48 THEN 'fn' END], lambda x: x IS NOT NULL), ';') AS failures FROM (SELECT *, {D.scores()} FROM (SELECT lang, {D.counts('truth', 'pred')} FROM e GROUP BY lang))")
def a37(spark, sf):
    return report.gates(M.binary(D.spark_frame(spark, sf, D.EVAL), "truth", "pred", ["lang"])).select("lang", "failures")


@query("a38_report_facts", f"WITH e AS ({_E}) SELECT count(*) AS rows, count(*) FILTER ({D.binary('pred')} = 1) AS positive, count(*) FILTER ({D.binary('pred')} = 0) AS negative, count(DISTINCT {D.text('decision_source')}) AS sources, round(avg(CASE WHEN {D.present('decision_explanation')} THEN 1.0 ELSE 0.0 END), 6) AS explained FROM e")
def a38(spark, sf):
    return report.facts(D.spark_frame(spark, sf, D.EVAL), "pred", "decision_source", "decision_explanation")


_EV = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS total, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN event_type = 'error' AND value < 10 THEN 1.0 ELSE 0.0 END) AS e, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS f FROM events GROUP BY 1"
_WARN = "array_to_string(list_filter([CASE WHEN p <= 0.01 THEN 'predicted_positive_rate_near_zero' END, CASE WHEN e > 0 THEN 'empty_response_detected' END, CASE WHEN f >= 0.2 THEN 'high_parse_fallback_rate' END], lambda x: x IS NOT NULL), ';')"


def _rates():
    error = F.col("event_type") == "error"
    return {"positive": F.col("event_type") == "purchase", "empty": error & (F.col("value") < 10), "fallback": error}


@query("t01_window_guardrails", f"SELECT w AS window_start, total, round(p, 6) AS positive_rate, round(e, 6) AS empty_rate, round(f, 6) AS fallback_rate, {_WARN} AS warnings FROM ({_EV})")
def t01(spark, sf):
    return G.windowed(read(spark, sf, "events"), **_rates()).drop("window_end")


@query("t02_stream_guardrails", f"SELECT w AS window_start, total, round(p, 6) AS positive_rate, {_WARN} AS warnings FROM ({_EV})")
def t02(spark, sf):
    """The same over a stream that is run to its end: batch and stream agree. Complete mode holds back no window."""
    path = f"{sf}/events.parquet"
    table = spark.read.parquet(path)
    src = spark.readStream.schema(table.schema).parquet(f"{sf}/events*.parquet")
    name = f"guardrails_{uuid.uuid4().hex}"
    q = G.windowed(src, **_rates()).writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "total", "positive_rate", "warnings")


@query("t03_sequence_guardrails", "SELECT CAST(floor(event_id / 500) + 1 AS INTEGER) AS chunk, count(*) AS total, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM events GROUP BY 1")
def t03(spark, sf):
    return G.by_sequence(read(spark, sf, "events"), "event_id", 500, **_rates()).select("chunk", "total", "positive_rate")


@query("a36_metric_lookup", f"WITH e AS ({_E}) SELECT 'pred' AS file, 'target' AS metric, accuracy FROM (SELECT *, {D.scores()} FROM (SELECT {D.counts('truth', 'pred')} FROM e))")
def a36(spark, sf):
    from quillgrid.plans.metric_queries import three_runs

    return report.metric_of(three_runs(spark, sf), "target", "pred", "accuracy")


@query("f69_first_matching", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3' ORDER BY doc_id LIMIT 1")
def f69(spark, sf):
    return report.first_matching(read(spark, sf, "documents"), {"lang": "de", "source": "src3"}, "doc_id").select("doc_id")


def _spatial(spark, sf):
    from quillgrid.functions import parse

    d = read(spark, sf, "documents").select("doc_id", F.lit("Renewal in Old Harbour").alias("title"), F.lit("A policy of the UK ministry").alias("abstract"))
    body = F.when(F.col("doc_id") % 5 == 0, "no object").when(F.col("doc_id") % 5 == 1, 'Here: {"Is_Spatial_Research": false, "Confidence": "High"} done').when(F.col("doc_id") % 5 == 2, '{"Is_Spatial_Research": "yes", "Specific_Study_Area": "the district", "Spatial_Scale_Level": "8"}')
    body = body.when(F.col("doc_id") % 5 == 3, '{"Is_Spatial_Research": true, "Specific_Study_Area": "Old Harbour", "Spatial_Scale_Level": "8. District"}').otherwise('{"Is_Spatial_Research": true, "Specific_Study_Area": "United Kingdom (implicit)", "Spatial_Scale_Level": "3"}')
    return d.select("doc_id", parse.spatial(body, "title", "abstract").alias("s"))


@query("f40_spatial_answer", "SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'accepted' WHEN 4 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'not_spatial' END AS status, CASE doc_id % 5 WHEN 0 THEN 'default_non_spatial' WHEN 1 THEN 'model_non_spatial' WHEN 2 THEN 'placeholder_or_generic_area' WHEN 3 THEN 'explicit_area_evidence' ELSE 'implicit_country_region_evidence' END AS reason, CASE doc_id % 5 WHEN 3 THEN '8. District / County Scale' WHEN 4 THEN '3. National / Single-country Scale' ELSE 'Not mentioned' END AS level FROM documents")
def f40(spark, sf):
    return _spatial(spark, sf).select("doc_id", F.col("s.status").alias("status"), F.col("s.reason").alias("reason"), F.col("s.level").alias("level"))


@query("f13_spatial_level", f"WITH e AS ({_E}) SELECT doc_id, CASE level_truth WHEN '3. National' THEN 3 WHEN '全国' THEN 3 WHEN 'City-wide 7' THEN 7 WHEN 'level 4 of 9' THEN 4 WHEN 'Street grid' THEN 9 WHEN 'Global' THEN 1 ELSE -1 END AS level FROM e")
def f13(spark, sf):
    return D.spark_frame(spark, sf, D.EVAL).select("doc_id", cells.level("level_truth").alias("level"))


# --- errors, projections and small helpers ---

_PROSE = "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Urban renewal policy' WHEN 1 THEN 'A deep learning model' WHEN 2 THEN 'regeneration only' WHEN 3 THEN 'Historic street' WHEN 4 THEN 'contaminated soil' WHEN 5 THEN NULL ELSE 'social housing' END AS t, doc_id % 3 AS k FROM {documents}"
_PR = D.duck(_PROSE)


def prose(spark, sf):
    return D.spark_frame(spark, sf, _PROSE)


@query("f33_anchor_terms", f"SELECT doc_id, CASE t WHEN 'Urban renewal policy' THEN 'urban_renewal' WHEN 'regeneration only' THEN 'urban_regeneration' ELSE '' END AS anchors FROM ({_PR})")
def f33(spark, sf):
    from quillgrid.operators import errors

    return prose(spark, sf).select("doc_id", F.array_join(errors.anchor_terms(F.coalesce("t", F.lit(""))), ";").alias("anchors"))


@query("f34_error_kind", f"SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'governance_program_law_under_renewal' WHEN 1 THEN 'method_design_evaluation_under_renewal' WHEN 2 THEN 'explicit_renewal_wording_but_other_object' WHEN 3 THEN 'heritage_adaptive_reuse_public_realm' WHEN 4 THEN 'contamination_risk_history_with_renewal_area_wording' WHEN 5 THEN 'other' ELSE 'health_social_effects_under_regeneration' END AS kind FROM ({_PR})")
def f34(spark, sf):
    from quillgrid.operators import errors

    return prose(spark, sf).select("doc_id", errors.error_kind(F.coalesce("t", F.lit(""))).alias("kind"))


_ED = f"WITH e AS ({_E}), w AS (SELECT *, {D.binary('truth')} AS tb, {D.binary('pred')} AS pb FROM e)"


@query("j21_error_analysis", f"{_ED}, f AS (SELECT source AS title, arg_min(coalesce(parse_reason, ''), _row_id) AS parse_reason FROM e GROUP BY 1) SELECT source AS title, CASE WHEN tb = 1 THEN 'FN' ELSE 'FP' END AS error_type, f.parse_reason FROM w JOIN f ON f.title = w.source WHERE tb <> pb AND tb IN (0, 1) AND pb IN (0, 1)")
def j21_analysis(spark, sf):
    from quillgrid.operators import errors

    e = D.spark_frame(spark, sf, D.EVAL).withColumn("title", F.col("source")).withColumn("abstract", F.lit(""))
    return errors.analysis(e, e, "truth", "pred").select("title", "error_type", "parse_reason")


@query("h46_spatial_row", f"WITH e AS ({_E}) SELECT doc_id, CASE WHEN {D.text('level_truth')} = '' THEN 'Not mentioned' ELSE level_truth END AS spatial_level, CASE WHEN {D.text('area_truth')} = '' THEN 'Not mentioned' ELSE area_truth END AS spatial_desc, '0' AS is_spatial, 'Low' AS confidence FROM e")
def h46(spark, sf):
    from quillgrid.operators import errors

    e = D.spark_frame(spark, sf, D.EVAL).select("doc_id", F.col("level_truth").alias("spatial_level"), F.col("area_truth").alias("spatial_desc"))
    return errors.with_defaults(e, errors.SPATIAL_DEFAULTS)


@query("h45_target_row", f"WITH e AS ({_E}) SELECT doc_id, CASE WHEN {D.text('pred_b')} = '' THEN '0' ELSE pred_b END AS final_label, CASE WHEN {D.text('parse_reason')} = '' THEN 'missing_parse_reason' ELSE parse_reason END AS parse_reason FROM e")
def h45(spark, sf):
    from quillgrid.operators import errors

    e = D.spark_frame(spark, sf, D.EVAL).select("doc_id", F.col("pred_b").alias("final_label"), "parse_reason")
    return errors.with_defaults(e, {"final_label": "0", "parse_reason": "missing_parse_reason"})


@query("j10_review_frame", f"WITH t AS ({_T}) SELECT _row_id, title, lang, label AS predicted, '' AS notes FROM t")
def j10(spark, sf):
    from quillgrid.operators import errors

    t = D.spark_frame(spark, sf, D.TITLED)
    return errors.review_frame(t.select("_row_id", "title", "abstract", "label"), t.select("_row_id", "title", "abstract", "lang"), ["title", "lang"], {"predicted": ["final_label", "label"], "notes": ["nothing"]})


@query("f15_same_level", f"WITH e AS ({_E}) SELECT doc_id, CASE WHEN doc_id % 8 = 0 AND doc_id % 7 = 0 THEN true ELSE NULL END AS both_national FROM e")
def f15(spark, sf):
    e = D.spark_frame(spark, sf, D.EVAL)
    both = (F.col("doc_id") % 8 == 0) & (F.col("doc_id") % 7 == 0)
    return e.select("doc_id", F.when(both, cells.same_level("level_truth", "level_pred")).alias("both_national"))


@query("f53_redacted", "SELECT doc_id, 'write to [REDACTED] with [REDACTED] now' AS note FROM documents")
def f53(spark, sf):
    from quillgrid.functions import text

    note = F.lit("write to some.one@example.org with sk-abcdef123456 now")
    return read(spark, sf, "documents").select("doc_id", text.redacted(note).alias("note"))


@query("f62_without_implicit", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'China' ELSE 'Hong Kong area' END AS area FROM documents")
def f62(spark, sf):
    from quillgrid.functions import parse

    raw = F.when(F.col("doc_id") % 2 == 0, "China (implicit country)").otherwise("implicitly Hong Kong area.")
    return read(spark, sf, "documents").select("doc_id", parse.without_implicit(raw).alias("area"))


@query("f64_country_scale", "SELECT doc_id, doc_id % 3 <> 2 AS is_country, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 END AS scale, CASE doc_id % 3 WHEN 0 THEN false ELSE true END AS mismatch FROM documents")
def f64(spark, sf):
    from quillgrid.functions import parse

    k = F.col("doc_id") % 3
    area, level = F.when(k == 2, "Old Harbour").otherwise("China"), F.when(k == 0, "3. National / Single-country Scale").when(k == 1, "7. Single-city / Municipal Scale").otherwise("none")
    return read(spark, sf, "documents").select("doc_id", parse.is_country(area).alias("is_country"), parse.scale_number(level).alias("scale"), parse.scale_mismatch(area, level).alias("mismatch"))


@query("f47_area_fragments", "SELECT doc_id, 'Bergen|Oslo|Norway' AS parts FROM documents")
def f47(spark, sf):
    from quillgrid.functions import parse

    return read(spark, sf, "documents").select("doc_id", F.array_join(parse.fragments(F.lit("Bergen and Oslo in Norway")), "|").alias("parts"))


@query("f30_legacy_topic", f"WITH m AS ({_M}) SELECT doc_id, CASE {D.topic('label')} WHEN 'U3' THEN 'U2' WHEN 'N10' THEN 'N2' ELSE '' END AS legacy FROM m")
def f30(spark, sf):
    legacy = {"U3": "U2", "N10": "N2"}
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", cells.looked_up(cells.topic("label"), legacy, "").alias("legacy"))
