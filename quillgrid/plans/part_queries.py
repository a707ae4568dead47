"""Queries of the parts that larger operators are made of: checks of study areas, the gate's pieces, hints, names and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import cells, parse, text
from quillgrid.operators import classify as C
from quillgrid.operators import gate as G
from quillgrid.operators import phrases as P
from quillgrid.operators import topics as T
from quillgrid.plans import frames as D
from quillgrid.plans import model_queries as M
from quillgrid.plans.registry import query
from quillgrid.plans.scalar_queries import multi, norm, tr

# --- study areas and their levels ---

#: Areas of every kind beside levels and source texts.
SITES = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'the study area' WHEN 1 THEN 'Old Town of Bergen' WHEN 2 THEN 'China (implicit)' WHEN 3 THEN 'Global' WHEN 4 THEN 'Not mentioned.' WHEN 5 THEN 'Oslo, Norway' WHEN 6 THEN NULL ELSE 'the selected City' END AS area,
  CASE doc_id % 7 WHEN 0 THEN '3. National' WHEN 1 THEN '7' WHEN 2 THEN 'District / County Scale' WHEN 3 THEN 'none' WHEN 4 THEN 'a global scale' WHEN 5 THEN NULL ELSE '12' END AS level,
  CASE doc_id % 5 WHEN 0 THEN 'Bergen and its old town' WHEN 1 THEN 'Housing in Oslo,  Norway' WHEN 2 THEN 'Chinese government policy' WHEN 3 THEN '' ELSE 'global trends of China' END AS title FROM {documents}"""
_IN = lambda names: "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"
_LOW = "lower(coalesce(area, ''))"
_ANCHOR = f"len(list_filter(regexp_extract_all(coalesce(area, ''), '\\b[A-Z][A-Za-z-]+\\b'), lambda x: lower(x) NOT IN {_IN(parse.NO_ANCHOR)})) > 0"
_GENERIC = f"(regexp_matches({_LOW}, '{parse.BOUNDARY_WORDS}') AND NOT {_ANCHOR})"
_N = f"CASE WHEN trim(lower(coalesce(level, '')), ' .;:') IN {_IN(parse.EMPTY_AREAS)} THEN '' ELSE lower(level) END"
_SCALE = f"CASE WHEN regexp_extract({_N}, '^([1-9])(?:\\.|\\b)', 1) <> '' THEN {_IN(parse.SCALES).replace('(', '[', 1)[:-1]}][CAST(regexp_extract({_N}, '^([1-9])(?:\\.|\\b)', 1) AS INTEGER)] " + " ".join(f"WHEN contains({_N}, '{s.split('.', 1)[1].strip().lower()}') THEN '{s}'" for s in parse.SCALES) + " END"
_S = f"WITH s AS (SELECT *, {_SCALE} AS canon, trim(regexp_replace(coalesce(area, ''), '\\([^)]*implicit[^)]*\\)', ''), ' .;:,') AS core, lower(regexp_replace(title, '\\s+', ' ', 'g')) AS source FROM ({D.duck(SITES)}))"
_NUMBER = "CAST(nullif(regexp_extract(canon, '^([1-9])\\.', 1), '') AS INTEGER)"
_PARTS = "list_filter(list_transform(regexp_split_to_array(regexp_replace(core, '\\b(in|within|of)\\b', ',', 'g'), '\\s*(?:,|;|/|&|\\band\\b)\\s*'), lambda x: trim(x, ' .;:,')), lambda x: x <> '')"
_WORDS = "CASE lower(core) " + " ".join(f"WHEN '{c}' THEN {_IN(w).replace('(', '[', 1)[:-1]}]" for c, w in parse.COUNTRIES.items()) + " END"
_IMPLIED = f"CASE WHEN regexp_matches(source, '{parse.POLICY_WORDS}') THEN list_filter({_WORDS}, lambda w: contains(source, w))[1] END"


def sites(spark, sf):
    return D.spark_frame(spark, sf, SITES)


@query("f42_placeholder_area", f"{_S} SELECT doc_id, area IS NULL OR trim({_LOW}, ' .;:') IN {_IN(parse.EMPTY_AREAS)} OR {_GENERIC} AS placeholder FROM s")
def f42(spark, sf):
    return sites(spark, sf).select("doc_id", parse.is_placeholder(F.col("area")).alias("placeholder"))


@query("f43_generic_boundary", f"{_S} SELECT doc_id, {_GENERIC} AS generic FROM s")
def f43(spark, sf):
    return sites(spark, sf).select("doc_id", parse.is_generic(F.coalesce("area", F.lit(""))).alias("generic"))


@query("f44_scale_level", f"{_S} SELECT doc_id, canon AS scale FROM s")
def f44(spark, sf):
    return sites(spark, sf).select("doc_id", parse.scale("level").alias("scale"))


@query("f45_scale_mismatch", f"{_S}, n AS (SELECT *, {_NUMBER} AS n FROM s) SELECT doc_id, n IS NULL OR (contains({_LOW}, 'implicit') AND n >= 6) OR (lower(core) IN {_IN(parse.COUNTRIES)} AND n >= 6) OR ({_LOW} IN ('global', 'world', 'worldwide') AND n <> 1) AS mismatch FROM n")
def f45(spark, sf):
    return sites(spark, sf).select("doc_id", parse.scale_mismatch(F.col("area"), parse.scale("level")).alias("mismatch"))


@query(
    "f46_area_support",
    f"{_S} SELECT doc_id, CASE WHEN source = '' THEN 'missing_source_text' WHEN core <> '' AND contains(source, lower(core)) THEN 'explicit_area_evidence' WHEN len({_PARTS}) >= 2 AND len(list_filter({_PARTS}, lambda p: NOT contains(source, lower(p)))) = 0 THEN 'explicit_area_fragment_evidence' WHEN contains({_LOW}, 'implicit') AND {_IMPLIED} IS NOT NULL THEN 'implicit_country_region_evidence' ELSE 'area_not_supported_by_title_or_abstract' END AS reason FROM s",
)
def f46(spark, sf):
    return sites(spark, sf).select("doc_id", parse.support(F.col("area"), "title", F.lit(""))["reason"].alias("reason"))


@query("f48_implied_country", f"{_S} SELECT doc_id, {_IMPLIED} AS word FROM s")
def f48(spark, sf):
    return sites(spark, sf).select("doc_id", parse.implied_country(F.col("area"), parse.matched("title")).alias("word"))


@query("f65_scale_number", f"{_S} SELECT doc_id, {_NUMBER} AS number FROM s")
def f65(spark, sf):
    return sites(spark, sf).select("doc_id", parse.scale_number(parse.scale("level")).alias("number"))


_DESC = lambda c: f"regexp_replace(regexp_replace(lower({tr(f'coalesce({c}, ' + repr('nan') + ')')}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')".replace("{{", "{").replace("}}", "}")
_BAG = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))"


@query(
    "f16_same_description",
    f"WITH e AS ({D.duck(D.EVAL)}), d AS (SELECT doc_id, {_DESC('area_truth')} AS x, {_DESC('area_pred')} AS y FROM e), w AS (SELECT *, {_BAG('x')} AS a, {_BAG('y')} AS b FROM d) SELECT doc_id, CASE WHEN x = 'not mentioned' OR y = 'not mentioned' OR len(a) = 0 OR len(b) = 0 THEN x = y ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) >= 0.6 END AS same FROM w",
)
def f16(spark, sf):
    return D.spark_frame(spark, sf, D.EVAL).select("doc_id", cells.same_description("area_truth", "area_pred").alias("same"))


LOCAL_NAMES = {"U3": "第三", "N10": "第十", "N2": "第二"}


@query("f29_local_topic_name", f"WITH m AS ({D.duck(D.MESSY)}) SELECT doc_id, CASE {D.topic('label')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LOCAL_NAMES.items()) + " ELSE '未知' END AS name FROM m")
def f29(spark, sf):
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", cells.looked_up(cells.topic("label"), LOCAL_NAMES, "未知").alias("name"))


# --- scores and the gate ---

_P = "CAST((doc_id * 17) % 101 AS DOUBLE) / 100"


@query(
    "l12_aligned_scores",
    f"WITH {M._X}, {M._LONG}, n AS (SELECT doc_id, label, round(score + 1.5 * greatest(CASE WHEN label LIKE 'U%' THEN 1 ELSE -1 END * ({_P} - 0.5) * 2, 0), 4) AS s FROM l) SELECT doc_id, string_agg(label, '>' ORDER BY s DESC, label) AS labels FROM n GROUP BY doc_id",
)
def l12(spark, sf):
    p = ((F.col("doc_id") * 17) % 101).cast("double") / 100
    return M.scored(spark, sf).select("doc_id", F.array_join(F.transform(C.aligned(F.col("topics"), p), lambda x: x["label"]), ">").alias("labels"))


_PLAIN = f"{M._K}, f AS (SELECT *, replace(CASE WHEN abstract = '' THEN title ELSE title || ' [sep] ' || abstract END, '-', ' ') AS x FROM c)"


@query("l16_phrase_hits", f"{_PLAIN} SELECT doc_id, CAST({M._COUNT(P.EXISTING_OBJECTS)} AS DOUBLE) AS objects, CAST({M._COUNT(P.MECHANISMS)} AS DOUBLE) AS mechanisms FROM f")
def l16(spark, sf):
    f = F.col("features")
    return G.features(G.with_defaults(M.cases(spark, sf))).select("doc_id", f["object_hit_count"].alias("objects"), f["mechanism_hit_count"].alias("mechanisms"))


@query("l19_fitted_gate", None)
def l19(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    df = G.features(G.with_defaults(M.cases(spark, sf)))
    model = G.fit(df.join(labels.where("quality IS NOT NULL"), "doc_id"), "quality")
    g = F.col("gate")
    return G.gate(G.predict(df, model), "gate_probability").select("doc_id", g["probability"].alias("probability"), g["family"].alias("family"), g["source"].alias("source"))


@query("l21_gate_confidence", f"{M._Z} SELECT doc_id, fa AS rule_family, round(abs(1 / (1 + exp(-z)) - 0.5) * 2, 4) AS confidence, 'family_gate_heuristic' AS source FROM z")
def l21(spark, sf):
    g = F.col("gate")
    return G.gate(G.features(G.with_defaults(M.cases(spark, sf)))).select("doc_id", g["rule_family"].alias("rule_family"), g["confidence"].alias("confidence"), g["source"].alias("source"))


@query("l22_family_of_group", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'urban' WHEN 1 THEN 'nonurban' ELSE 'unknown' END AS family FROM documents")
def l22(spark, sf):
    m = F.col("doc_id") % 4
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("grp", F.when(m == 0, " Urban").when(m == 1, "NONURBAN ").when(m == 2, "other"))
    return d.select("doc_id", cells.family_of_group("grp").alias("family"))


@query("l23_no_hint", "SELECT doc_id, false AS available, false AS outlier, 0 AS count, 0.0::DOUBLE AS purity, '' AS label FROM documents")
def l23(spark, sf):
    h = F.col("hint")
    return G.with_defaults(M.cases(spark, sf)).select("doc_id", *(h[c].alias(c) for c in ("available", "outlier", "count", "purity", "label")))


@query("h42_external_hint", f"WITH m AS ({D.duck(D.MESSY)}), t AS (SELECT doc_id, regexp_replace({D.text('flag')}, '\\.0$', '') AS t FROM m) SELECT doc_id, CASE WHEN t IN ('0', '1') THEN t ELSE '' END AS hint FROM t")
def h42(spark, sf):
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", G.llm_hint("flag").alias("hint"))


# --- models, hints and clusters ---


@query("m03_odds_probability", "SELECT doc_id, round(1 / (1 + exp(-least(greatest((n_chars - 900) / 40.0, -12), 12))), 9) AS probability FROM documents")
def m03(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.round(C.probability((F.col("n_chars") - 900) / 10.0), 9).alias("probability"))


_STATUS = f"CASE doc_id % 4 WHEN 0 THEN '{T.STATUSES[0]}' WHEN 1 THEN '{T.STATUSES[1]}' WHEN 2 THEN '{T.STATUSES[2]}' ELSE 'needs_review' END"
_KEYS = "CASE CAST(floor(doc_id / 4) AS BIGINT) % 3 WHEN 0 THEN 'Urban Renewal; parks' WHEN 1 THEN 'brown-field; x' ELSE 'water' END"
CLUSTERS = f"SELECT doc_id, {_STATUS} AS status, {_KEYS} AS keys, CASE CAST(floor(doc_id / 12) AS BIGINT) % 3 WHEN 0 THEN 'U1' WHEN 1 THEN 'N3' ELSE '' END AS candidate FROM {{documents}}"
_C = f"WITH c AS (SELECT *, replace(replace(lower(keys), '-', '_'), ' ', '_') AS named FROM ({D.duck(CLUSTERS)}))"
_ANCHORED = "(" + " OR ".join(f"contains(named, '{a}')" for a in P.CLUSTER_ANCHORS) + ")"


@query("m14_candidate_label", f"{_C} SELECT doc_id, CASE WHEN status = '{T.STATUSES[1]}' THEN '1' WHEN status = '{T.STATUSES[2]}' THEN '0' WHEN status = '{T.STATUSES[0]}' AND candidate LIKE 'U%' AND {_ANCHORED} THEN '1' WHEN status = '{T.STATUSES[0]}' AND candidate LIKE 'N%' THEN '0' ELSE '' END AS label FROM c")
def m14(spark, sf):
    return D.spark_frame(spark, sf, CLUSTERS).select("doc_id", T.candidate_label(F.col("candidate"), F.col("status"), F.col("keys")).alias("label"))


@query("f68_cluster_anchor", f"{_C} SELECT doc_id, {_ANCHORED} AS anchored FROM c")
def f68(spark, sf):
    named = F.replace(F.replace(text.phrase("keys"), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return D.spark_frame(spark, sf, CLUSTERS).select("doc_id", text.contains_any(named, P.CLUSTER_ANCHORS).alias("anchored"))


@query("m15_cluster_name", f"{_C} SELECT doc_id, CASE WHEN contains(keys, 'water') THEN 'rivers' WHEN status = '{T.STATUSES[0]}' AND candidate <> '' THEN CASE WHEN candidate LIKE 'U%' THEN 'urban: ' ELSE 'nonurban: ' END || candidate ELSE 'cluster: ' || replace(keys, '; ', ', ') END AS name FROM c")
def m15(spark, sf):
    return D.spark_frame(spark, sf, CLUSTERS).select("doc_id", T.cluster_name(text.multi("keys"), F.col("candidate"), F.col("status"), [("water", "rivers")]).alias("name"))


@query("m22_mapping_overrides", "SELECT lang AS topic, CASE WHEN lang = 'en' THEN 'N2' ELSE 'U1' END AS mapped_label, CASE WHEN lang = 'en' THEN 'manual_topic_mapping' ELSE 'auto' END AS mapping_source FROM (SELECT DISTINCT lang FROM documents)")
def m22(spark, sf):
    auto = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("lang").alias("topic")).distinct().withColumns({"mapped_label": F.lit("U1"), "mapping_source": F.lit("auto")})
    return T.with_overrides(auto, spark.createDataFrame([("en", "N2")], "topic string, mapped_label string"), "topic")


@query(
    "m27_topic_document",
    f"WITH m AS ({D.duck(D.MESSY)}) SELECT doc_id, concat_ws('{text.SEPARATOR}', nullif({norm('t')}, ''), nullif({norm('kw1')}, ''), CASE WHEN len({multi('kw2')}) > 0 THEN 'keywords: ' || array_to_string(({multi('kw2')})[1:20], '; ') END) AS document FROM m",
)
def m27(spark, sf):
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", T.document("t", "kw1", text.multi("kw2")).alias("document"))


_PRIMARY = "doc_id % 3 <> 0 AND b <> '' AND doc_id % 50 >= 35 AND lc >= 0.8 AND p >= 0.5"


def _hinted(spark, sf):
    h = F.struct((F.col("doc_id") % 3 != 0).alias("available"), F.lit(False).alias("outlier"), (F.col("doc_id") % 50).alias("count"), F.col("lc").alias("purity"), F.lit(0.9).alias("share"), F.col("p").alias("probability"), F.col("b").alias("label"), cells.family("b").alias("group"))
    return M.cases(spark, sf).withColumn("hint", h)


@query("m30_aligned_hint", f"{M._K} SELECT doc_id, {_PRIMARY} AND (a = b OR fa = fb) AS aligned FROM c")
def m30(spark, sf):
    return _hinted(spark, sf).select("doc_id", T.aligned_hint(F.col("a"), cells.family("a")).alias("aligned"))


@query("m31_conflicting_hint", f"{M._K} SELECT doc_id, {_PRIMARY} AND (a <> b OR fa <> fb) AS conflicting FROM c")
def m31(spark, sf):
    return _hinted(spark, sf).select("doc_id", T.conflicting_hint(F.col("a"), cells.family("a")).alias("conflicting"))
