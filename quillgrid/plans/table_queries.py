"""Queries of joins (J01 to J25), cross-tabs (P01 to P10), windows and samples (X01 to X06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import cells, text
from quillgrid.operators import align as J
from quillgrid.operators import crosstab as P
from quillgrid.operators import metrics as M
from quillgrid.operators import sampling as X
from quillgrid.plans import frames as D
from quillgrid.plans.registry import query

_T, _R, _E, _X = D.duck(D.TITLED), D.duck(D.REVIEW), D.duck(D.EVAL), D.duck(D.CROSSED)
_KEY = "regexp_replace(lower(trim(coalesce(title, 'nan'))), '\\s+', ' ', 'g')"
_ONE_EACH = f"(SELECT *, {_KEY} AS _key, row_number() OVER (PARTITION BY {_KEY} ORDER BY _row_id) AS n FROM {{}}) WHERE n = 1"
_SIDES = f"x AS ({_X}), a AS (SELECT * FROM {_ONE_EACH.format('t')}), b AS (SELECT * FROM {_ONE_EACH.format('x')})"
_MK = "lower(trim(coalesce(CAST(title AS VARCHAR), ''))) || chr(31) || lower(trim(coalesce(CAST(abstract AS VARCHAR), '')))"


def titled(spark, sf):
    return D.spark_frame(spark, sf, D.TITLED)


def crossed(spark, sf):
    return D.spark_frame(spark, sf, D.CROSSED)


def review(spark, sf):
    return P.normalize(D.spark_frame(spark, sf, D.REVIEW), "publication_year", "topic", "spatial_flag", "level", "detail")


def tq(name: str, sql: str | None):
    return query(name, None if sql is None else f"WITH t AS ({_T}) {sql}")


def _sides(spark, sf):
    return titled(spark, sf), crossed(spark, sf)


def _aligned(spark, sf):
    return J.align(*_sides(spark, sf))


@tq("j01_align_truth_pred", f", {_SIDES} SELECT a._key, a.doc_id AS doc_id_truth, b.doc_id AS doc_id_pred, a.label AS label_truth, b.label AS label_pred FROM a JOIN b USING (_key)")
def j01(spark, sf):
    return _aligned(spark, sf).merged.select("_key", "doc_id_truth", "doc_id_pred", "label_truth", "label_pred")


@tq("j01_unmatched", f", {_SIDES} SELECT 'truth' AS side, _key, doc_id FROM a WHERE _key NOT IN (SELECT _key FROM b) UNION ALL SELECT 'pred', _key, doc_id FROM b WHERE _key NOT IN (SELECT _key FROM a)")
def j01b(spark, sf):
    r = _aligned(spark, sf)
    side = lambda df, s: df.select(F.lit(s).alias("side"), "_key", "doc_id")
    return side(r.truth_unmatched, "truth").unionByName(side(r.pred_unmatched, "pred"))


@tq("j01_alignment_summary", f", {_SIDES} SELECT *, match_count / CAST(truth_count AS DOUBLE) AS truth_coverage, match_count / CAST(pred_count AS DOUBLE) AS pred_coverage FROM (SELECT (SELECT count(*) FROM a) AS truth_count, (SELECT count(*) FROM b) AS pred_count, (SELECT count(*) FROM a JOIN b USING (_key)) AS match_count)")
def j01c(spark, sf):
    return _aligned(spark, sf).summary


@tq("j02_duplicate_rows", f", k AS (SELECT *, {_KEY} AS _key FROM t) SELECT doc_id, _key FROM k WHERE _key IN (SELECT _key FROM k GROUP BY 1 HAVING count(*) > 1)")
def j02(spark, sf):
    return J.keep_first(titled(spark, sf).withColumn("_key", text.key("title")), "_key")[1].select("doc_id", "_key")


@tq("j02_keep_first", f", k AS (SELECT *, {_KEY} AS _key FROM t) SELECT _key, min(doc_id) AS doc_id FROM k GROUP BY 1")
def j02b(spark, sf):
    return J.keep_first(titled(spark, sf).withColumn("_key", text.key("title")), "_key")[0].select("_key", "doc_id")


@tq("j03_rename_aliases", "SELECT doc_id, label AS is_target, lang FROM t")
def j03(spark, sf):
    df = titled(spark, sf).select("doc_id", F.col("label").alias("is_target_local_v2"), "lang")
    return J.rename_aliases(df, {"is_target": ["is_target_local_v2", "is_target_local"], "lang": ["language"]})


@tq("j04_resolve_column", f", {_SIDES} SELECT a.label AS value, count(*) AS n FROM a JOIN b USING (_key) GROUP BY 1")
def j04(spark, sf):
    m = _aligned(spark, sf).merged
    return m.groupBy(F.col(J.resolve(m, ["gold", "label"], "truth")).alias("value")).agg(F.count("*").alias("n"))


_OCC = f"SELECT *, {_MK} AS mk, row_number() OVER (PARTITION BY {_MK} ORDER BY _row_id) - 1 AS dup FROM t"


@tq("j05_occurrence_join", f", x AS ({_X}), l AS ({_OCC}), r AS ({_OCC.replace('FROM t', 'FROM x')}) SELECT l._row_id, r.doc_id, r.n_chars FROM l LEFT JOIN r ON l.mk = r.mk AND l.dup = r.dup")
def j05(spark, sf):
    right = crossed(spark, sf).select("_row_id", "title", "abstract", "doc_id", "n_chars")
    return J.by_occurrence(titled(spark, sf).select("_row_id", "title", "abstract"), right, ["title", "abstract"]).select("_row_id", "doc_id", "n_chars")


_YEAR = f"y AS (SELECT {_MK} AS mk, coalesce(arg_min(publication_year, _row_id) FILTER (publication_year IS NOT NULL), '') AS year FROM t GROUP BY 1)"


@tq("j06_year_lookup", f", {_YEAR} SELECT mk AS _merge_key, year AS publication_year FROM y")
def j06(spark, sf):
    return J.first_value(titled(spark, sf), ["title", "abstract"], "publication_year")


@tq("j07_fill_year", f", {_YEAR} SELECT doc_id, CASE WHEN trim(coalesce(publication_year, '')) = '' THEN year ELSE publication_year END AS publication_year FROM (SELECT *, {_MK} AS mk FROM t) JOIN y USING (mk)")
def j07(spark, sf):
    t = titled(spark, sf)
    return J.fill_blank(t, J.first_value(t, ["title", "abstract"], "publication_year"), ["title", "abstract"], "publication_year").select("doc_id", "publication_year")


@tq("j08_alignment_keys", f"SELECT doc_id, mk AS _merge_key, CAST(dup AS INTEGER) AS _dup_index FROM ({_OCC})")
def j08(spark, sf):
    return J.with_occurrence(titled(spark, sf), ["title", "abstract"]).select("doc_id", "_merge_key", "_dup_index")


@tq("j09_first_existing", "SELECT doc_id, label AS value, '' AS missing FROM t")
def j09(spark, sf):
    t = titled(spark, sf)
    return t.select("doc_id", J.first_existing(t, ["final_label", "label"]).alias("value"), J.first_existing(t, ["nothing"]).alias("missing"))


@tq("j11_positional_merge", "SELECT _row_id, title, n_chars, lang, n_chars + 1 AS n_chars_spatial FROM t")
def j11(spark, sf):
    t = titled(spark, sf)
    return J.by_position(t.select("_row_id", "title", "n_chars"), t.select("_row_id", "lang", (F.col("n_chars") + 1).alias("n_chars")))


_LT = "lower(trim(coalesce(title, '')))"


@tq("j12_title_merge", f", x AS ({_X}), l AS (SELECT *, {_LT} AS k FROM t), r AS (SELECT *, {_LT} AS k FROM x) SELECT l.doc_id, r.doc_id AS doc_id_right FROM l LEFT JOIN r USING (k)")
def j12(spark, sf):
    return J.by_title(titled(spark, sf).select("doc_id", "title"), crossed(spark, sf).select("doc_id", "title")).select("doc_id", "doc_id_right")


@tq("j13_side_by_side", f", x AS ({_X}) SELECT coalesce(a._row_id, b._row_id) AS _row_id, a.lang AS \"[ONE] lang\", b.n_chars AS \"[TWO] n_chars\" FROM t AS a FULL JOIN x AS b USING (_row_id)")
def j13(spark, sf):
    return J.side_by_side({"one": titled(spark, sf).select("_row_id", "lang"), "two": crossed(spark, sf).select("_row_id", "n_chars")})


@tq("j14_unknown_review_join", f", e AS ({_E}) SELECT t.doc_id, t.title, e.truth FROM t LEFT JOIN e ON t.doc_id = e.doc_id WHERE t.label = '0'")
def j14(spark, sf):
    return titled(spark, sf).where("label = '0'").join(D.spark_frame(spark, sf, D.EVAL).select("doc_id", "truth"), "doc_id", "left").select("doc_id", "title", "truth")


@tq("j17_reused_predictions", "SELECT _row_id, title, n_chars FROM t")
def j17(spark, sf):
    t = titled(spark, sf)
    return J.reused(t, t, "n_chars")


_FLAG = "r AS (SELECT doc_id, CASE WHEN {t} = {a} THEN 1 ELSE 0 END AS a, CASE WHEN {t} = {b} THEN 1 ELSE 0 END AS b FROM e)".format(t=D.binary("truth"), a=D.binary("pred_b"), b=D.binary("pred_c"))


@query("j18_discordant_pairs", f"WITH e AS ({_E}), {_FLAG} SELECT count(*) FILTER (a = 1 AND b = 0) AS b, count(*) FILTER (a = 0 AND b = 1) AS c FROM r")
def j18(spark, sf):
    e = D.spark_frame(spark, sf, D.EVAL)
    one = lambda p, n: e.select("doc_id", (cells.binary("truth") == cells.binary(p)).cast("int").alias(n))
    return one("pred_b", "a").join(one("pred_c", "b"), "doc_id").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("b"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("c"))


@query("j20_semi_and_anti", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'unlabelled' END AS side FROM documents")
def j20(spark, sf):
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet").select("doc_id") for t in ("documents", "labels"))
    side = lambda how, s: d.join(lab, "doc_id", how).select("doc_id", F.lit(s).alias("side"))
    return side("left_semi", "labelled").unionByName(side("left_anti", "unlabelled"))


_BT, _BP = D.binary("truth"), D.binary("pred")


@query("j21_error_rows", f"WITH e AS ({_E}) SELECT doc_id, CASE WHEN {_BT} = 1 THEN 'FN' ELSE 'FP' END AS error_type, parse_reason FROM e WHERE {_BT} <> {_BP} AND {_BT} IN (0, 1) AND {_BP} IN (0, 1)")
def j21(spark, sf):
    e = D.spark_frame(spark, sf, D.EVAL)
    t, p = cells.binary("truth"), cells.binary("pred")
    wrong = e.where((t != p) & t.isin(0, 1) & p.isin(0, 1)).select("doc_id", F.when(t == 1, "FN").otherwise("FP").alias("error_type"))
    return wrong.join(e.select("doc_id", "parse_reason"), "doc_id", "left")


# --- cross-tabs ---

_N = f"""WITH s AS ({_R}), v AS (SELECT _row_id, CAST(try_cast(publication_year AS DOUBLE) AS INTEGER) AS year_number, trim(coalesce(topic, '')) AS topic_name,
  CASE WHEN lower(trim(coalesce(spatial_flag, ''))) IN ('1', '1.0', 'true', 'spatial') THEN 'Spatial' WHEN lower(trim(coalesce(spatial_flag, ''))) IN ('0', '0.0', 'false', 'non-spatial', 'nonspatial', '') THEN 'Non-spatial' ELSE lower(trim(spatial_flag)) END AS flag_name,
  CASE WHEN trim(coalesce(level, '')) = '' THEN 'Not mentioned' WHEN level = '9. Micro / Neighborhood / Block' THEN '9. Micro / Neighborhood / Block Scale' ELSE trim(level) END AS level_name, CASE WHEN trim(coalesce(detail, '')) = '' THEN 'Not mentioned' ELSE trim(detail) END AS detail_name FROM s),
n AS (SELECT *, year_number IS NOT NULL AS has_year, flag_name = 'Spatial' AS is_spatial, detail_name <> 'Not mentioned' AS has_detail FROM v), sp AS (SELECT * FROM n WHERE is_spatial), de AS (SELECT * FROM sp WHERE has_detail)"""


@query("p01_normalize_review", f"{_N} SELECT _row_id, year_number, topic_name, flag_name, level_name, detail_name, has_year, is_spatial, has_detail FROM n")
def p01(spark, sf):
    return review(spark, sf).select("_row_id", "year_number", "topic_name", "flag_name", "level_name", "detail_name", "has_year", "is_spatial", "has_detail")


@query("p03_count_pivot", f"{_N}, l AS (SELECT year_number, topic_name, count(*) AS c FROM n WHERE has_year GROUP BY 1, 2) SELECT y.year_number AS year_number, t.topic_name AS topic_name, coalesce(c, 0) AS count FROM (SELECT DISTINCT year_number FROM l) AS y CROSS JOIN (SELECT DISTINCT topic_name FROM n) AS t LEFT JOIN l ON l.year_number = y.year_number AND l.topic_name = t.topic_name")
def p03(spark, sf):
    r = review(spark, sf)
    order = P.ordered_values(r, "topic_name")
    wide = P.pivot(r.where("has_year"), "year_number", "topic_name", order)
    named = wide.toDF("year_number", *(f"c{i}" for i in range(len(order))))
    args = ", ".join(f"'{c}', c{i}" for i, c in enumerate(order))
    return named.selectExpr("year_number", f"stack({len(order)}, {args}) as (topic_name, count)")


@query("p04_totals", f"{_N}, g AS (SELECT level_name, detail_name FROM de) SELECT CASE WHEN grouping(level_name) = 1 THEN 'Total' ELSE level_name END AS row, CASE WHEN grouping(detail_name) = 1 THEN 'Total' ELSE detail_name END AS col, count(*) AS count FROM g GROUP BY CUBE (level_name, detail_name)")
def p04(spark, sf):
    return P.long_table(review(spark, sf).where("is_spatial and has_detail"), "level_name", "detail_name").select("row", "col", "count")


@query("p05_shares", f"{_N}, g AS (SELECT CASE WHEN grouping(level_name) = 1 THEN 'Total' ELSE level_name END AS row, CASE WHEN grouping(topic_name) = 1 THEN 'Total' ELSE topic_name END AS col, count(*) AS count FROM sp GROUP BY CUBE (level_name, topic_name)) SELECT g.row, g.col, g.count, g.count / CAST(w.count AS DOUBLE) AS share FROM g JOIN (SELECT row, count FROM g WHERE col = 'Total') AS w USING (row)")
def p05(spark, sf):
    return P.long_table(review(spark, sf).where("is_spatial"), "level_name", "topic_name")


@query("p06_ordered_values", f"{_N} SELECT topic_name AS value, row_number() OVER (ORDER BY count(*) DESC, topic_name) AS place FROM n GROUP BY 1")
def p06(spark, sf):
    return spark.createDataFrame(list(zip(P.ordered_values(review(spark, sf), "topic_name"), range(1, 10**6))), "value string, place long")


@query("p02_flags_by_year", f"{_N}, g AS (SELECT CASE WHEN grouping(year_number) = 1 THEN 'Total' ELSE CAST(year_number AS VARCHAR) END AS year_number, count(*) FILTER (flag_name = 'Spatial') AS yes, count(*) FILTER (flag_name = 'Non-spatial') AS no FROM n WHERE has_year GROUP BY ROLLUP (year_number)) SELECT *, yes + no AS total_count, {D.share('yes', 'yes + no')} AS yes_share, {D.share('no', 'yes + no')} AS no_share FROM g")
def p02(spark, sf):
    return P.flags_by_year(review(spark, sf).where("has_year"), "year_number", "flag_name")


@query("p02_level_share", f"{_N} SELECT level_name, count(*) AS count, count(*) / CAST((SELECT count(*) FROM n) AS DOUBLE) AS share_all, count(*) / CAST((SELECT count(*) FROM sp) AS DOUBLE) AS share_in FROM sp GROUP BY 1")
def p02b(spark, sf):
    return P.level_share(review(spark, sf), "level_name", "is_spatial")


@query("p02_ranked_spaces", f"{_N} SELECT detail_name, count(*) AS count, min(year_number) AS first_year, max(year_number) AS last_year, CAST(row_number() OVER (ORDER BY count(*) DESC, detail_name) AS INTEGER) AS overall_rank, count(*) / CAST((SELECT count(*) FROM n) AS DOUBLE) AS share_all, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share_in FROM de GROUP BY 1")
def p02c(spark, sf):
    r = review(spark, sf)
    return P.ranked(r.where("is_spatial and has_detail"), "detail_name", "year_number", r.count())


@query("p02_top_spaces_per_topic", f"{_N}, o AS (SELECT detail_name, CAST(row_number() OVER (ORDER BY count(*) DESC, detail_name) AS INTEGER) AS overall_rank FROM de GROUP BY 1), g AS (SELECT topic_name, detail_name, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY topic_name) AS BIGINT) AS group_total, row_number() OVER (PARTITION BY topic_name ORDER BY count(*) DESC, detail_name) AS r FROM de GROUP BY 1, 2) SELECT topic_name, detail_name, count, count / CAST(group_total AS DOUBLE) AS share_within, group_total, overall_rank FROM g JOIN o USING (detail_name) WHERE r <= 10")
def p02d(spark, sf):
    return P.top_per_group(review(spark, sf).where("is_spatial and has_detail"), "topic_name", "detail_name", 10)


@query("p07_kpis", f"{_N} SELECT metric, value FROM (SELECT CAST(count(*) AS VARCHAR) AS \"Total Samples\", min(year_number) || '-' || max(year_number) AS \"Year Range\", CAST(count(DISTINCT topic_name) AS VARCHAR) AS \"Distinct Topics\", CAST(count(*) FILTER (is_spatial) AS VARCHAR) AS \"Spatial Studies\", CAST(count(*) FILTER (NOT is_spatial) AS VARCHAR) AS \"Non-spatial Studies\", CAST(count(DISTINCT detail_name) FILTER (has_detail AND is_spatial) AS VARCHAR) AS \"Distinct Detailed Spaces\", CAST(count(*) FILTER (NOT has_detail) AS VARCHAR) AS \"Not Mentioned Count\", CAST(round(avg(CASE WHEN has_detail THEN 0.0 ELSE 1.0 END), 6) AS VARCHAR) AS \"Not Mentioned Share\" FROM n) UNPIVOT (value FOR metric IN (\"Total Samples\", \"Year Range\", \"Distinct Topics\", \"Spatial Studies\", \"Non-spatial Studies\", \"Distinct Detailed Spaces\", \"Not Mentioned Count\", \"Not Mentioned Share\"))")
def p07(spark, sf):
    return P.kpis(review(spark, sf))


@query("p08_topic_trend", f"{_N}, b AS (SELECT year_number, topic_name, count(*) / CAST(sum(count(*)) OVER (PARTITION BY year_number) AS DOUBLE) AS s FROM n WHERE has_year GROUP BY 1, 2), g AS (SELECT topic_name, {D.share('sum(CASE WHEN year_number <= 1994 THEN s ELSE 0 END)', '(SELECT count(DISTINCT year_number) FROM b WHERE year_number <= 1994)')} AS early_share, {D.share('sum(CASE WHEN year_number >= 1996 THEN s ELSE 0 END)', '(SELECT count(DISTINCT year_number) FROM b WHERE year_number >= 1996)')} AS late_share FROM b GROUP BY 1) SELECT topic_name, round(early_share, 9) AS early_share, round(late_share, 9) AS late_share, round(late_share - early_share, 9) AS delta_share FROM g")
def p08(spark, sf):
    t = P.trend(review(spark, sf), "year_number", "topic_name", 1994, 1996)
    return t.select("topic_name", *(F.round(c, 9).alias(c) for c in ("early_share", "late_share", "delta_share")))


@query("p10_top_or_other", f"{_N}, k AS (SELECT detail_name FROM n GROUP BY 1 ORDER BY count(*) DESC, detail_name LIMIT 5) SELECT CASE WHEN detail_name IN (SELECT detail_name FROM k) THEN detail_name ELSE 'Other' END AS detail_name, count(*) AS count FROM n GROUP BY 1")
def p10(spark, sf):
    return P.with_other(review(spark, sf), "detail_name", 5).groupBy("detail_name").agg(F.count("*").alias("count"))


# --- windows ---


@query("w01_margin_to_next", f"{_N}, g AS (SELECT topic_name, detail_name, count(*) AS c FROM de GROUP BY 1, 2) SELECT topic_name, detail_name, c - coalesce(lead(c) OVER (PARTITION BY topic_name ORDER BY c DESC, detail_name), 0) AS margin FROM g QUALIFY row_number() OVER (PARTITION BY topic_name ORDER BY c DESC, detail_name) = 1")
def w01(spark, sf):
    from pyspark.sql import Window

    g = review(spark, sf).where("is_spatial and has_detail").groupBy("topic_name", "detail_name").agg(F.count("*").alias("c"))
    w = Window.partitionBy("topic_name").orderBy(F.desc("c"), "detail_name")
    return g.withColumns({"margin": F.col("c") - F.coalesce(F.lead("c").over(w), F.lit(0)), "r": F.row_number().over(w)}).where("r = 1").select("topic_name", "detail_name", "margin")


@query("w02_positions", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS _position FROM events")
def w02(spark, sf):
    return M.with_position(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), "event_id").select("event_id", "_position")


# --- samples ---

_CLEAN = "c AS (SELECT *, row_number() OVER (PARTITION BY trim(coalesce(title, '')), body ORDER BY _row_id) AS n FROM (SELECT *, lang || ' ' || repeat('x', CAST(doc_id % 40 AS INTEGER)) AS body FROM t) WHERE trim(coalesce(title, '')) <> '' AND length(trim(body)) >= 20)"


def _bodied(spark, sf):
    return titled(spark, sf).withColumn("body", F.concat("lang", F.lit(" "), F.expr("repeat('x', cast(doc_id % 40 as int))")))


@tq("x01_clean_sample", f", {_CLEAN} SELECT doc_id FROM c WHERE n = 1 ORDER BY md5('7:' || CAST(_row_id AS VARCHAR)), _row_id LIMIT 100")
def x01(spark, sf):
    return X.clean_sample(_bodied(spark, sf), 100, 7, abstract="body").select("doc_id")


@tq("x02_allocation_total", "SELECT CAST(100 AS BIGINT) AS allocated, count(DISTINCT lang || source) AS strata FROM documents")
def x02(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("stratum", F.concat("lang", "source"))
    s = X.stratified(d, "stratum", 100, 7, "doc_id")
    return s.agg(F.count("*").alias("allocated"), F.count_distinct("stratum").alias("strata"))


_QUOTA = "c AS (SELECT lang, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS q FROM documents GROUP BY lang), r AS (SELECT lang, floor(q) + CASE WHEN row_number() OVER (ORDER BY q - floor(q) DESC, n DESC) <= 100 - sum(floor(q)) OVER () THEN 1 ELSE 0 END AS k FROM c)"


@query("x03_stratified_sample", f"WITH {_QUOTA} SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) JOIN r USING (lang) WHERE n <= k")
def x03(spark, sf):
    return X.stratified(spark.read.parquet(f"{sf}/documents.parquet"), "lang", 100, 7, "doc_id").select("doc_id", "lang")


@tq("x04_run_order", "SELECT doc_id, row_number() OVER (ORDER BY lower(trim(coalesce(title, ''))), _row_id) AS place FROM t")
def x04(spark, sf):
    keyed = titled(spark, sf).select("doc_id", F.lower(cells.text_of("title")).alias("key"), "_row_id")
    return M.numbered(keyed, ["key", "_row_id"]).select("doc_id", F.col("_position").alias("place"))


@tq("x06_clean_columns", "SELECT doc_id, trim(coalesce(title, '')) AS title, trim(abstract) AS abstract FROM t")
def x06(spark, sf):
    return X.clean_columns(titled(spark, sf), ["title", "abstract"]).select("doc_id", "title", "abstract")
