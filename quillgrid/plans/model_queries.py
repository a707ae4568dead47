"""Queries of lexicon scoring (L), models and clusters (M), and the decision chain (H)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from quillgrid.functions import cells, text
from quillgrid.operators import classify as C
from quillgrid.operators import decide as H
from quillgrid.operators import gate as G
from quillgrid.operators import lexicon as L
from quillgrid.operators import phrases as P
from quillgrid.operators import refine as R
from quillgrid.operators import stats
from quillgrid.operators import topic_model as TM
from quillgrid.operators import topics as T
from quillgrid.plans import frames as D
from quillgrid.plans.registry import query
from quillgrid.sources import tables as S

#: A lexicon of words that the driver's texts have.
WORDS = L.Taxonomy(
    (
        L.Topic("U1", cells.IN, "first", ("the tion", "that"), ("with", "ing"), ("and", "for")),
        L.Topic("U9", cells.IN, "ninth", ("que", "de la"), ("los",), (), (("que", "de"),), ("der",)),
        L.Topic("U12", cells.IN, "twelfth", ("renewal",), ("ment",), ("le", "les"), anchors=("tion",), anchor_penalty=1.95),
        L.Topic("N1", cells.OUT, "first out", ("und", "der die"), ("ung",), excludes=("the",)),
        L.Topic("N8", cells.OUT, "eighth out", ("on", "ea"), ("er", "th"), ("edblean", "ing"), excludes=("que", "und")),
    )
)
#: Whole documents: the first line is the title, all after it the abstract.
DOCS = "SELECT doc_id, doc_id AS _row_id, split_part(text, chr(10), 1) AS title, regexp_replace(text, concat('^[^', chr(10), ']*', chr(10), '?'), '') AS abstract, text, lang, source, n_chars FROM {documents}"
_D = D.duck(DOCS)
_SQ = "replace(regexp_replace(lower(trim({c})), '\\s+', ' ', 'g'), '-', ' ')"
_X = f"x AS (SELECT doc_id, {_SQ.replace('{c}', 'title')} AS t, {_SQ.replace('{c}', 'abstract')} AS a FROM ({_D})), y AS (SELECT *, concat_ws(' ', nullif(t, ''), nullif(a, '')) AS b FROM x)"


def _has(col: str, term: str) -> str:
    return f"contains({col}, '{term}')"


def _terms(terms, base: float) -> str:
    return " + ".join(f"(CASE WHEN {_has('t', s)} THEN {base * 1.35} ELSE 0 END + CASE WHEN {_has('a', s)} THEN {base} ELSE 0 END)" for s in terms) or "0"


def topic_sql(t: L.Topic) -> str:
    """A topic's score in SQL."""
    any_term = " OR ".join(f"{_has('t', s)} OR {_has('a', s)}" for s in t.context_terms) or "false"
    anchor = " OR ".join(_has("b", s) for s in t.context_anchors)
    context = f"(CASE WHEN ({any_term}) AND ({anchor}) THEN {_terms(t.context_terms, 1.0)} + {t.context_bonus} ELSE 0 END)" if anchor else f"({_terms(t.context_terms, 1.0)})"
    combo = "".join(f" + CASE WHEN {' AND '.join(_has('b', s) for s in c)} THEN 4.0 ELSE 0 END" for c in t.combos)
    out = "".join(f" - CASE WHEN {_has('b', s)} THEN 3.0 ELSE 0 END" for s in t.excludes)
    missing = f" - CASE WHEN NOT ({' OR '.join(_has('b', s) for s in t.anchors)}) THEN {t.anchor_penalty} ELSE 0 END" if t.anchors and t.anchor_penalty else ""
    return f"round(CAST(({_terms(t.seeds, 3.0)}) + {context}{combo}{out}{missing} AS DOUBLE), 4)"


_LONG = "l AS (" + " UNION ALL ".join(f"SELECT doc_id, '{t.label}' AS label, {i} AS place, {topic_sql(t)} AS score FROM y" for i, t in enumerate(WORDS.topics)) + ")"


def docs(spark, sf):
    return D.spark_frame(spark, sf, DOCS)


def spread_docs(spark, sf):
    """Documents for stages that take long for a row: one small file is dealt to all cores."""
    return S.spread(docs(spark, sf))


def scored(spark, sf):
    return L.score_topics(L.fields(spread_docs(spark, sf)), WORDS)


@query("l01_match_phrases", f"WITH {_X} SELECT doc_id, array_to_string(list_filter(['the', 'que', 'und', 'tion of'], lambda p: contains(b, p)), '|') AS hits FROM y")
def l01(spark, sf):
    return L.fields(docs(spark, sf)).select("doc_id", F.array_join(L.hits(F.col("_both"), ["the", "que", "und", "tion of"]), "|").alias("hits"))


@query("l02_metadata_audit", f"WITH m AS ({D.duck(D.MESSY)}) SELECT doc_id, CASE WHEN kw1 LIKE '%alpha%' THEN 'alpha' ELSE '' END AS related FROM m")
def l02(spark, sf):
    d = text.domains("kw1", "kw2")
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", F.array_join(F.array_sort(F.array_intersect(d, F.array(F.lit("alpha"), F.lit("physics")))), ";").alias("related"))


@query("l04_weighted_terms", f"WITH {_X} SELECT doc_id, CAST({_terms(WORDS.topics[4].context_terms, 1.0)} AS DOUBLE) AS score FROM y")
def l04(spark, sf):
    s, _ = L.weighted(F.col("_t"), F.col("_a"), WORDS.topics[4].context_terms, 1.0)
    return L.fields(docs(spark, sf)).select("doc_id", s.alias("score"))


@query("l05_topic_scores", f"WITH {_X}, {_LONG} SELECT doc_id, label, score FROM l")
def l05(spark, sf):
    return scored(spark, sf).select("doc_id", F.explode_outer("topics").alias("x")).select("doc_id", F.col("x.label").alias("label"), F.col("x.score").alias("score"))


@query("l06_topic_order", f"WITH {_X}, {_LONG} SELECT doc_id, string_agg(label, '>' ORDER BY score DESC, place) AS labels FROM l GROUP BY doc_id")
def l06(spark, sf):
    return scored(spark, sf).select("doc_id", F.array_join(F.transform("topics", lambda x: x["label"]), ">").alias("labels"))


_BEST = "b2 AS (SELECT doc_id, arg_max(label, (score, -place)) AS label, max(score) AS score, list(score ORDER BY score DESC, place)[2] AS second FROM l GROUP BY doc_id)"


@query("l07_best_topic", f"WITH {_X}, {_LONG}, {_BEST} SELECT doc_id, CASE WHEN score <= 0 THEN 'Unknown' ELSE label END AS label, score, round(greatest(score - second, 0), 4) AS margin FROM b2")
def l07(spark, sf):
    df = scored(spark, sf)
    best, second = F.col("topics")[0], F.col("topics")[1]
    return df.select("doc_id", F.when(best["score"] <= 0, "Unknown").otherwise(best["label"]).alias("label"), best["score"].alias("score"), F.round(F.greatest(best["score"] - second["score"], F.lit(0.0)), 4).alias("margin"))


def first(spark, sf):
    return L.first_stage(scored(spark, sf))


def staged(spark, sf):
    return C.second_stage(first(spark, sf))


_COMBO = "label = 'U9' AND contains(b, 'que') AND contains(b, 'de')"
#: The first stage over texts that have none of the phrases it looks for: topics alone decide.
_FIRST = f"""o AS (SELECT l.doc_id, label, place, score, {_COMBO} AS combo, row_number() OVER (PARTITION BY l.doc_id ORDER BY score DESC, place) AS r FROM l JOIN y ON y.doc_id = l.doc_id),
f AS (SELECT doc_id, max(label) FILTER (r = 1) AS top, max(label) FILTER (r = 2) AS next, max(score) FILTER (r = 1) AS score, bool_or(combo) FILTER (r = 1) AS combo, round(greatest(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 0), 4) AS margin, string_agg(label || ':' || printf('%.2f', score), '; ' ORDER BY r) FILTER (r <= 3) AS top3 FROM o GROUP BY doc_id),
g AS (SELECT *, CASE WHEN score <= 0 THEN 'Unknown' ELSE top END AS label, ((score >= 6 AND margin >= 3) OR (score >= 5 AND combo)) AND score >= 4 AND margin >= 2 AS strong, CASE WHEN top[1] <> next[1] THEN 1 ELSE 0 END AS conflict FROM f),
first AS (SELECT *, {D.family('label')} AS "group", CASE WHEN strong THEN 'rule_topic_' || lower(label) ELSE 'uncertain_pass' END AS reason, CASE WHEN label = 'Unknown' THEN 'rule_unknown' WHEN conflict = 1 THEN 'rule_group_conflict' WHEN margin < 2 THEN 'rule_low_margin' WHEN score < 4 THEN 'rule_low_score' ELSE '' END AS review_reason FROM g)"""


@query("l11_first_stage", f"WITH {_X}, {_LONG}, {_FIRST} SELECT doc_id, 'uncertain' AS route, reason, label, \"group\", score, margin, conflict, CASE WHEN review_reason <> '' THEN 1 ELSE 0 END AS review_flag, review_reason, top3, '' AS risk_tags FROM first")
def l11(spark, sf):
    r = F.col("rule")
    return first(spark, sf).select("doc_id", *(r[c].alias(c) for c in ("route", "reason", "label", "group", "score", "margin", "conflict", "review_flag", "review_reason")), F.array_join(r["top3"], "; ").alias("top3"), F.array_join(r["risk_tags"], "; ").alias("risk_tags"))


def _exact(score: str, margin: str, p: str, matched: str, unknown: str, tokens: str) -> str:
    """The second stage's confidence in SQL, in decimals throughout."""
    d = lambda x: f"CAST({x} AS DECIMAL(4,3))"
    part = lambda x, each, most: f"least(greatest(CAST({x} AS DECIMAL(14,6)) * {d(each)}, 0), {d(most)})"
    c = f"({d('0.16')} + {part(score, '0.045', '0.36')} + {part(margin, '0.055', '0.22')} + {part(f'abs(CAST({p} AS DECIMAL(14,6)) - {d(0.5)})', '0.32', '0.16')} + CASE WHEN {matched} THEN {d('0.05')} ELSE {d('0')} END)"
    c = f"CASE WHEN {unknown} THEN least({c}, {d('0.49')}) ELSE {c} END"
    c = f"CASE WHEN {tokens} < 8 THEN least({c}, {d('0.45')}) WHEN {tokens} < 18 THEN least({c}, {d('0.68')}) ELSE {c} END"
    return f"CAST(round(least(greatest({c}, {d('0.2')}), {d('0.99')}), 4) AS DOUBLE)"


def _weak() -> str:
    """When the second stage's best topic is too weak to stand, at an even probability."""
    own = [f"(top = '{n}' AND (score < {a} OR margin < {b} OR {'0.5 >= ' + str(floor) if floor is not None else f'(0.5 <= {ceiling} AND score < {below})'}))" for n, (a, b, floor, ceiling, below) in P.UNKNOWN_POLICIES.items()]
    return " OR ".join(["score < 2.4", "margin < 1.1", *own])


def _matched() -> str:
    """Whether anything speaks for or against the best topic."""
    own = []
    for t in WORDS.topics:
        near = " OR ".join(_has("b", x) for x in t.context_anchors) or "true"
        context = " OR ".join(_has(c, x) for x in t.context_terms for c in ("t", "a")) or "false"
        marks = [_has(c, x) for x in t.seeds for c in ("t", "a")] + [_has("b", x) for x in t.excludes] + [f"(({context}) AND ({near}))"]
        if t.anchors and t.anchor_penalty:
            marks.append("NOT (" + " OR ".join(_has("b", x) for x in t.anchors) + ")")
        own.append(f"(top = '{t.label}' AND ({' OR '.join(marks)}))")
    return " OR ".join(own)


_SECOND = f"""o AS (SELECT l.*, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM l),
f AS (SELECT doc_id, max(label) FILTER (r = 1) AS top, max(score) FILTER (r = 1) AS score, round(greatest(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 0), 4) AS margin, string_agg(label || ':' || printf('%.2f', score), '; ' ORDER BY r) FILTER (r <= 3) AS top3 FROM o GROUP BY doc_id),
n AS (SELECT doc_id, greatest(2 * len(regexp_extract_all(lower(concat_ws(' [SEP] ', nullif(trim(coalesce(title, '')), ''), nullif(trim(coalesce(abstract, '')), ''))), '[a-z0-9]+')) - 1, 0) AS n FROM ({_D})),
w AS (SELECT f.*, {_weak()} AS weak, {_matched()} AS matched FROM f JOIN y USING (doc_id)),
c AS (SELECT * FROM w JOIN n USING (doc_id))"""


@query("l15_second_stage", f"WITH {_X}, {_LONG}, {_SECOND} SELECT doc_id, label, {D.family('label')} AS \"group\", {_exact('score', 'margin', '0.5', 'matched', 'weak', 'n')} AS confidence, margin, 0.5::DOUBLE AS p, top3 FROM (SELECT *, CASE WHEN weak THEN 'Unknown' ELSE top END AS label FROM c)")
def l15(spark, sf):
    lo = F.col("local")
    return staged(spark, sf).select("doc_id", *(lo[c].alias(c) for c in ("label", "group", "margin", "p")), lo["confidence"].alias("confidence"), F.array_join(lo["top3"], "; ").alias("top3"))


# --- token odds ---

_TOK = f"WITH d AS ({_D}), k AS (SELECT d.doc_id, quality, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[a-z0-9]+'))) AS token FROM d JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM (SELECT DISTINCT doc_id, quality FROM k)), c AS (SELECT token, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM k GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT token, ln((pos + 1) / (p + 2.0)) - ln((neg + 1) / (n + 2.0)) AS weight FROM c, n)"


def labelled_tokens(spark, sf):
    d = docs(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return C.document_tokens(d, "doc_id", text.unigrams("text"), ("quality",))


@query("a39_token_documents", f"{_TOK} SELECT token, pos, neg FROM c")
def a39(spark, sf):
    from quillgrid.operators.metrics import token_documents

    return token_documents(labelled_tokens(spark, sf), "quality")


@query("m01_token_odds", f"{_TOK} SELECT token, round(weight, 9) AS weight FROM w")
def m01(spark, sf):
    return C.fit_odds(labelled_tokens(spark, sf), "doc_id", "quality")[0].select("token", F.round("weight", 9).alias("weight"))


@query("m02_odds_score", f"{_TOK}, t2 AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[a-z0-9]+'))) AS token FROM d) SELECT doc_id, round(sum(coalesce(weight, 0)) + max(ln((p + 1) / (n + 1.0))), 6) AS odds, round(1 / (1 + exp(-least(greatest((sum(coalesce(weight, 0)) + max(ln((p + 1) / (n + 1.0)))) / 4, -12), 12))), 6) AS probability FROM t2 LEFT JOIN w USING (token), n GROUP BY doc_id")
def m02(spark, sf):
    w, bias = C.fit_odds(labelled_tokens(spark, sf), "doc_id", "quality")
    tokens = C.document_tokens(spread_docs(spark, sf), "doc_id", text.unigrams("text"))
    return C.odds_score(tokens, "doc_id", w, bias).select("doc_id", F.round("odds", 6).alias("odds"), F.round("probability", 6).alias("probability"))


# --- the decision chain on rows made of ids ---

CASES = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'U1' WHEN 1 THEN 'U9' WHEN 2 THEN 'U12' WHEN 3 THEN 'N3' WHEN 4 THEN 'N8' WHEN 5 THEN 'Unknown' ELSE 'N4' END AS a, CASE (doc_id / 7) % 6 WHEN 0 THEN 'U1' WHEN 1 THEN 'U12' WHEN 2 THEN 'N3' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'N4' ELSE 'U9' END AS b,
  CAST((doc_id * 13) % 90 AS DOUBLE) / 10 AS score, CAST((doc_id * 7) % 50 AS DOUBLE) / 10 AS margin, (doc_id * 13) % 90 >= 50 AS strong, CAST(20 + (doc_id * 11) % 80 AS DOUBLE) / 100 AS lc, CAST((doc_id * 3) % 40 AS DOUBLE) / 10 AS lm, CAST((doc_id * 17) % 101 AS DOUBLE) / 100 AS p, CASE doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END AS llm,
  CASE doc_id % 5 WHEN 0 THEN 'urban renewal of the old town' WHEN 1 THEN 'a model of mobility' WHEN 2 THEN 'city housing without renewal' WHEN 3 THEN 'new town on farmland' ELSE 'neutral words' END AS title, CASE doc_id % 4 WHEN 0 THEN 'policy for existing buildings' WHEN 1 THEN 'relocation and compensation' ELSE '' END AS abstract,
  doc_id % 11 = 0 AS greenfield, doc_id % 6 = 0 AS technical FROM {documents}""".replace("(doc_id / 7)", "CAST(floor(doc_id / 7) AS BIGINT)")
_CASES = D.duck(CASES)


def cases(spark, sf):
    df = D.spark_frame(spark, sf, CASES)
    tags = F.array_compact(F.array(F.when(F.col("greenfield"), P.GREENFIELD_RISK), F.when(F.col("technical"), P.TECHNICAL_RISK)))
    none = F.array().cast("array<string>")
    rule = F.struct(F.lit("uncertain").alias("route"), F.lit("uncertain_pass").alias("reason"), F.col("a").alias("label"), cells.family("a").alias("group"), "score", "margin", F.array(F.format_string("%s:%.2f", "a", "score")).alias("top3"), none.alias("matches"), none.alias("signals"), tags.alias("risk_tags"), F.lit(0).alias("conflict"), "strong", (F.col("margin") < 2).cast("int").alias("review_flag"), F.when(F.col("margin") < 2, "rule_low_margin").otherwise("").alias("review_reason"))
    local = F.struct(F.col("b").alias("label"), cells.family("b").alias("group"), F.col("lc").alias("confidence"), F.col("lm").alias("margin"), "p", none.alias("matches"), F.array(F.lit("x")).alias("top3"), F.array(F.struct(F.col("b").alias("label"), (F.col("lc") * 8).alias("score"))).alias("scored"))
    return L.fields(df).withColumns({"rule": rule, "local": local})


_RC = "round(least(greatest(0.18 + 0.48 * least(greatest(score / 8, 0), 1) + 0.24 * least(greatest(margin / 4, 0), 1) + CASE WHEN strong THEN 0.08 ELSE 0 END, 0.2), 0.99), 4)"
_FA, _FB = D.family("a"), D.family("b")
_K = f"WITH c AS (SELECT *, {_RC} AS rc, {_FA} AS fa, {_FB} AS fb, round(lc, 4) AS lcr FROM ({_CASES}))"


@query("h06_rule_confidence", f"{_K} SELECT doc_id, rc AS confidence FROM c")
def h06(spark, sf):
    return cases(spark, sf).select("doc_id", H.rule_confidence().alias("confidence"))


_U = "'Unknown'"
_FUSE = f"""CASE WHEN a = b AND a <> {_U} THEN 1 WHEN a = {_U} AND b = {_U} THEN 2 WHEN strong AND a <> {_U} AND b = {_U} THEN 3 WHEN strong AND a <> {_U} AND b <> {_U} AND fa = fb AND rc >= lc + 0.05 THEN 4 WHEN strong AND a <> {_U} AND b <> {_U} AND fa = fb THEN 5 WHEN strong AND a <> {_U} AND rc >= lc + 0.18 THEN 6
  WHEN strong AND a <> {_U} AND lc >= rc + 0.18 AND lm >= 1.5 THEN 7 WHEN strong AND a <> {_U} THEN 8 WHEN b = {_U} AND rc >= 0.62 AND a <> {_U} THEN 9 WHEN b = {_U} THEN 10 WHEN a <> {_U} AND fa = fb AND lc >= 0.45 THEN 11 WHEN a <> {_U} AND fa = fb THEN 12 WHEN a = {_U} THEN 13 WHEN lc >= 0.72 AND lm >= 1.6 THEN 14 WHEN rc >= 0.72 AND margin >= 2.5 THEN 15 ELSE 16 END"""


@query("h07_fusion", f"{_K}, k AS (SELECT *, {_FUSE} AS n FROM c) SELECT doc_id, CASE WHEN n IN (3, 4, 6, 9, 12, 15) THEN a WHEN n IN (1, 5, 7, 11, 13, 14) THEN b ELSE {_U} END AS topic, CASE WHEN n IN (1, 3, 4, 6, 9, 12, 15) THEN 'rule_model_fusion' WHEN n IN (5, 7, 11, 13, 14) THEN 'stage2_classifier' ELSE 'unknown_review' END AS source, CASE WHEN n IN (1, 2, 8, 10, 16) THEN greatest(rc, lcr) WHEN n IN (3, 4, 6, 9, 12, 15) THEN rc ELSE lcr END AS confidence FROM k")
def h07(spark, sf):
    d = F.col("decision")
    return H.fuse(H.signals(cases(spark, sf))).select("doc_id", d["topic"].alias("topic"), d["source"].alias("source"), d["confidence"].alias("confidence"))


@query("h05_cluster_quality", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unavailable' WHEN doc_id % 4 = 1 THEN 'outlier' WHEN n_chars >= 3500 THEN 'high' WHEN n_chars >= 1000 AND doc_id % 10 >= 6 THEN 'medium' ELSE 'low' END AS quality FROM documents")
def h05(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = F.floor(F.col("n_chars") / 100)
    high = F.col("n_chars") >= 3500
    h = F.struct((F.col("doc_id") % 4 != 0).alias("available"), (F.col("doc_id") % 4 == 1).alias("outlier"), n.alias("count"), F.when(high, 0.9).otherwise((F.col("doc_id") % 10) / 10).alias("purity"), F.when(high, 0.9).otherwise(0.1).alias("share"))
    return d.withColumn("hint", h).select("doc_id", H.hint_quality().alias("quality"))


@query("h29_family_votes", f"{_K}, v AS (SELECT *, CASE fa WHEN 'urban' THEN 1.0 WHEN 'nonurban' THEN 0.0 ELSE 0.5 END AS va, CASE fb WHEN 'urban' THEN 1.0 WHEN 'nonurban' THEN 0.0 ELSE 0.5 END AS vb FROM c) SELECT doc_id, round((va + vb + vb + 0.5 + va) / 5, 6) AS votes FROM v")
def h29(spark, sf):
    df = G.with_defaults(cases(spark, sf)).withColumn("inner", F.struct(F.col("b").alias("label")))
    return df.select("doc_id", F.round(H.vote(F.col("a")).cast("double"), 6).alias("votes"))


@query("h34_risk_adjustment", f"{_K} SELECT doc_id, round(CASE WHEN technical THEN -0.06 ELSE 0 END + CASE WHEN greenfield THEN -0.12 ELSE 0 END, 6) AS adjustment FROM c")
def h34(spark, sf):
    return cases(spark, sf).select("doc_id", F.round(H.risk_adjustment(F.col("rule.risk_tags")), 6).alias("adjustment"))


@query("h28_negated_context", f"{_K} SELECT doc_id, contains(title, 'without renewal') AS negated, contains(title, 'urban renewal') AS core FROM c")
def h28(spark, sf):
    return H.signals(cases(spark, sf)).select("doc_id", F.col("sig.negated").alias("negated"), (F.size("sig.core") > 0).alias("core"))


@query("h38_evidence_balance", f"{_K} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'hard_negative' WHEN doc_id % 4 = 0 THEN CASE WHEN llm = '1' THEN 'conflict_positive' ELSE 'conflict_negative' END WHEN llm = '1' THEN CASE WHEN lc >= 0.75 THEN 'strong_positive' WHEN lc >= 0.6 THEN 'positive' ELSE 'low_confidence_positive' END WHEN llm = '0' THEN CASE WHEN lc >= 0.75 THEN 'strong_negative' WHEN lc >= 0.6 THEN 'negative' ELSE 'low_confidence_negative' END ELSE 'unknown' END AS balance FROM c")
def h38(spark, sf):
    return cases(spark, sf).select("doc_id", H.balance(F.col("llm"), F.col("lc"), F.col("doc_id") % 9 == 0, F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("balance"))


def _accross(a: str, b: str, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} IN {ins if len(ins) > 1 else f'({chr(39)}{ins[0]}{chr(39)})'} AND {b} IN {outs} THEN '{name}'" for ins, outs, name in P.BOUNDARIES) + f" ELSE '{rest}' END"


@query("l20_conflict_bucket", f"{_K} SELECT doc_id, a || '_vs_' || b AS pattern, CASE WHEN fa = 'unknown' AND fb = 'unknown' THEN 'double_unknown' WHEN fa = 'urban' AND fb = 'nonurban' THEN {_accross('a', 'b', 'urban_rule_nonurban_local')} WHEN fa = 'nonurban' AND fb = 'urban' THEN {_accross('b', 'a', 'nonurban_rule_urban_local')} WHEN contains(a || '_vs_' || b, 'U10') OR contains(a || '_vs_' || b, 'N8') THEN 'method_boundary' ELSE 'same_family_or_single_source' END AS bucket FROM c")
def l20(spark, sf):
    a, b = F.col("a"), F.col("b")
    return cases(spark, sf).select("doc_id", G.conflict_pattern(a, b).alias("pattern"), G.boundary(a, b, cells.family(a), cells.family(b)).alias("bucket"))


_COUNT = lambda terms: "(" + " + ".join(f"CAST(contains(x, '{t}') AS INTEGER)" for t in dict.fromkeys(t.replace("-", " ") for t in terms)) + ")"
_Z = f"""{_K}, f AS (SELECT *, replace(CASE WHEN abstract = '' THEN title ELSE title || ' [sep] ' || abstract END, '-', ' ') AS x FROM c),
n AS (SELECT *, least({_COUNT(P.COMMON_ANCHORS)}, 3) AS an, least({_COUNT(P.EXISTING_OBJECTS)}, 3) AS ob, least({_COUNT(P.MECHANISMS)}, 3) AS me, CAST(greenfield AS INTEGER) + CAST(technical AS INTEGER) AS ri, CASE fa WHEN 'urban' THEN 1 WHEN 'nonurban' THEN -1 ELSE 0 END AS sa, CASE fb WHEN 'urban' THEN 1 WHEN 'nonurban' THEN -1 ELSE 0 END AS sb FROM f),
z AS (SELECT *, ((p - 0.5) * 3.6 + sa * least(score / 6.5, 1) + sb * lc * 1.3 + an * 0.12 + ob * 0.12 + me * 0.14 - ri * 0.1) * CASE WHEN sa * sb = -1 THEN 0.82 ELSE 1 END + CASE WHEN llm = '1' AND (sa = 1 OR sb = 1) THEN 0.2 ELSE 0 END - CASE WHEN llm = '0' AND (sa = -1 OR sb = -1) THEN 0.2 ELSE 0 END AS z FROM n)"""


@query("l18_gate_probability", f"{_Z} SELECT doc_id, round(1 / (1 + exp(-z)), 6) AS probability, CASE WHEN 1 / (1 + exp(-z)) >= 0.72 THEN 'urban' WHEN 1 / (1 + exp(-z)) <= 0.28 THEN 'nonurban' ELSE 'unknown' END AS family FROM z")
def l18(spark, sf):
    df = G.gate(G.features(G.with_defaults(cases(spark, sf))))
    return df.select("doc_id", F.col("gate.probability").alias("probability"), F.col("gate.family").alias("family"))


@query("l17_gate_features", f"{_Z} SELECT doc_id, an AS anchor_hits, CAST(ri AS DOUBLE) AS risk_tags, CASE WHEN sa * sb = -1 THEN 1.0 ELSE 0.0 END AS conflict FROM z")
def l17(spark, sf):
    df = G.features(G.with_defaults(cases(spark, sf)))
    f = F.col("features")
    return df.select("doc_id", F.least(f["anchor_hit_count"], F.lit(3.0)).cast("int").alias("anchor_hits"), f["risk_tag_count"].alias("risk_tags"), f["cross_group_conflict"].alias("conflict"))


@query("l13_unknown_policy", f"{_K} SELECT doc_id, score < 2.4 OR (lm < 1.1 AND abs(p - 0.5) < 0.12) OR (score <= 0 AND abs(p - 0.5) < 0.12) OR (b IN ('N3') AND (score < 2.9 OR lm < 1.35 OR p >= 0.53)) OR (b = 'N4' AND (score < 2.9 OR lm < 1.35 OR p >= 0.55)) AS unknown FROM c")
def l13(spark, sf):
    return cases(spark, sf).select("doc_id", C.is_unknown(F.col("b"), F.col("score"), F.col("lm"), F.col("p")).alias("unknown"))


@query("l14_local_confidence", f"{_K} SELECT doc_id, {_exact('score', 'lm', 'p', 'strong', chr(40) + 'b = ' + repr('Unknown') + chr(41), '(doc_id % 30)')} AS confidence FROM c")
def l14(spark, sf):
    return cases(spark, sf).select("doc_id", C.confidence(F.col("score"), F.col("lm"), F.col("p"), F.col("strong"), F.col("b") == "Unknown", F.col("doc_id") % 30).alias("confidence"))


@lru_cache(maxsize=2)
def decided(spark, sf):
    """The chain's plan is the same for all its queries; building it takes longer than small tables do."""
    return H.decide(cases(spark, sf))


@query("h01_decision_chain", None)
def h01(spark, sf):
    return H.final_columns(decided(spark, sf), ("doc_id",))


@query("h39_explanations", None)
def h39(spark, sf):
    e = F.col("explanation")
    return decided(spark, sf).select("doc_id", *(e[c].alias(c) for c in ("text", "positive", "negative", "balance", "stack")))


@query("c06_classify_documents", None)
def c06(spark, sf):
    """Both stages and the chain over documents, end to end."""
    return H.final_columns(H.decide(staged(spark, sf)), ("doc_id",))


# --- clusters ---

_E = D.duck(D.EVAL)
_POOL = f"p AS (SELECT *, CASE WHEN lower({D.text('topic_final')}) = 'unknown' OR lower({D.text('decision_source')}) = 'unknown_review' THEN 'unknown_pool' WHEN pred IN ('0', '0.0') AND ({D.flag('review_flag')} > 0 OR regexp_matches(lower(coalesce(review_reason, '')), 'unknown|open_set|near_threshold|conflict|inconsistency|uncertain')) THEN 'nonurban_review_pool' WHEN {D.flag('review_flag')} > 0 OR regexp_matches(lower(coalesce(review_reason, '')), 'unknown|open_set|near_threshold|conflict|inconsistency|uncertain') THEN 'review_pool' ELSE '' END AS pool FROM e)"


def pooled(spark, sf):
    e = D.spark_frame(spark, sf, D.EVAL).drop("source_pool").withColumns({"none": F.lit("")})
    return T.pools(e, topic="topic_final", group="none", coverage="none", reason="review_reason", source="decision_source", label="pred", flag="review_flag")


@query("m12_source_pools", f"WITH e AS ({_E}), {_POOL} SELECT doc_id, pool AS source_pool FROM p")
def m12(spark, sf):
    return pooled(spark, sf).select("doc_id", "source_pool")


_STOP = ", ".join(f"'{w}'" for w in T.STOP)
_TERM = f"""g AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[a-z][a-z0-9_+-]{{2,}}') AS w FROM ({_D})),
u AS (SELECT doc_id, w[i] AS term, 1 AS n FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM g) WHERE w[i] NOT IN ({_STOP}) UNION ALL SELECT doc_id, w[i] || '_' || w[i + 1], 2 FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM g) WHERE w[i] NOT IN ({_STOP}) AND w[i + 1] NOT IN ({_STOP}))"""


@query("m08_keyword_terms", f"WITH {_TERM}, s AS (SELECT doc_id, term, CAST(sum(n) AS BIGINT) AS weight FROM u GROUP BY 1, 2) SELECT doc_id, term, weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 10")
def m08(spark, sf):
    return T.top_terms(spread_docs(spark, sf), "doc_id", "text", unique=True)


_BUCKET = "b AS (SELECT d.doc_id, coalesce(term, 'document_' || d.doc_id) AS bucket FROM documents AS d LEFT JOIN (SELECT doc_id, term FROM (SELECT doc_id, term, sum(n) AS weight FROM u GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) = 1) USING (doc_id))"


@query("m07_keyword_clusters", f"WITH {_TERM}, {_BUCKET} SELECT doc_id, bucket FROM b")
def m07(spark, sf):
    return T.by_keyword(spread_docs(spark, sf), "doc_id", "text")


@query("m09_cluster_ids", f"WITH {_TERM}, {_BUCKET} SELECT bucket, count(*) AS size, 'DUR_' || CASE WHEN r < 10000 THEN lpad(CAST(r AS VARCHAR), 4, '0') ELSE CAST(r AS VARCHAR) END AS cluster FROM (SELECT bucket, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS r FROM b GROUP BY 1) JOIN b USING (bucket) GROUP BY bucket, r")
def m09(spark, sf):
    return T.name_clusters(T.by_keyword(spread_docs(spark, sf), "doc_id", "text"), "doc_id")


@query("m11_cluster_confidence", "SELECT doc_id, round(0.45 * least(1, n_chars / 2000.0) + 0.35 * least(1, (doc_id % 10) / 10.0 / 0.35) + 0.2 * least(1, (doc_id % 12) / 8.0), 6) AS confidence FROM documents")
def m11(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", T.confidence(F.col("n_chars") / 100, (F.col("doc_id") % 10) / 10, F.col("doc_id") % 12).alias("confidence"))


@query("m10_map_to_fixed", None)
def m10(spark, sf):
    k = T.row_keywords(spread_docs(spark, sf), "doc_id", "text")
    m = F.col("mapping")
    return T.map_to_fixed(k, "keywords", T.seed_tokens(WORDS)).select("doc_id", m["candidate"].alias("candidate"), m["status"].alias("status"), m["score"].alias("score"))


_CAND = "CASE WHEN mapping_status = 'candidate_new_urban_topic' THEN '1' WHEN mapping_status = 'candidate_new_nonurban_topic' THEN '0' WHEN mapping_status = 'mapped_to_fixed' AND {f} = 'nonurban' THEN '0' ELSE '' END".replace("{f}", D.family("topic_final"))
_NOW = D.text("pred")


@query("m13_binary_candidates", f"WITH e AS ({_E}), k AS (SELECT doc_id, {_CAND} AS c, CASE WHEN {_NOW} IN ('0', '1') THEN {_NOW} ELSE '' END AS n, coalesce(try_cast(cluster_confidence AS DOUBLE), 0) >= 0.7 AS sure FROM e) SELECT doc_id, c AS candidate_label, CASE WHEN c <> '' AND c = n THEN 'supports_current_label' WHEN c = '1' AND n = '0' THEN 'possible_false_negative_cluster' WHEN c = '0' AND n = '1' THEN 'possible_false_positive_cluster' ELSE 'needs_review' END AS candidate_action, CASE WHEN c <> '' AND c = n THEN 'low' WHEN (c = '1' AND n = '0') OR (c = '0' AND n = '1') THEN CASE WHEN sure THEN 'high' ELSE 'medium' END ELSE 'medium' END AS review_priority FROM k")
def m13(spark, sf):
    e = D.spark_frame(spark, sf, D.EVAL).withColumns({"topic_final": cells.topic("topic_final"), "cc": F.col("cluster_confidence").try_cast("double")})
    return T.candidates(e, label="pred", candidate="topic_final", status="mapping_status", keywords="lang", confidence_="cc").select("doc_id", "candidate_label", "candidate_action", "review_priority")


@query("m16_enrich_clusters", None)
def m16(spark, sf):
    p = pooled(spark, sf).select("doc_id", "source_pool").join(docs(spark, sf), "doc_id")
    return T.enrich(p, "doc_id", "text", WORDS).select("doc_id", "source_pool", "cluster", "cluster_size", "cluster_keywords", "mapping_status")


@query("m06_kmeans_clusters", None)
def m06(spark, sf):
    return T.by_kmeans(spread_docs(spark, sf), "doc_id", "text", T.Config(min_size=100))


REFINE = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '' END AS final_label, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE 'N3' END AS topic_final, 'covered' AS coverage, CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END AS candidate_label, CAST((doc_id % 10) / 10.0 AS STRING) AS cluster_confidence, CAST(doc_id % 40 AS STRING) AS cluster_size, 'DUR_1' AS cluster,
  CASE doc_id % 3 WHEN 0 THEN 'U1' WHEN 1 THEN 'N2' ELSE '' END AS fixed_candidate, 'mapped_to_fixed' AS mapping_status, CASE doc_id % 2 WHEN 0 THEN 'keep_0' ELSE '' END AS guard_action, '1' AS review_flag, '0.4' AS score, '0.45' AS threshold, CASE WHEN doc_id % 7 < 4 THEN 'urban renewal now' WHEN doc_id % 7 = 5 THEN 'rural urban renewal' ELSE 'words' END AS title, '' AS abstract FROM {documents}"""


@query("m17_refine_labels", f"WITH r AS (SELECT *, final_label NOT IN ('0', '1') OR topic_final = 'Unknown' AS unknown FROM ({D.duck(REFINE)})), h AS (SELECT *, candidate_label IN ('0', '1') AND CAST(cluster_confidence AS DOUBLE) >= 0.72 AND CAST(cluster_size AS DOUBLE) >= 20 AND NOT (candidate_label = '0' AND final_label = '1') AND unknown AND (candidate_label <> '1' OR (contains(title, 'urban renewal') AND NOT contains(title, 'rural'))) AS hit FROM r) SELECT doc_id, CAST(hit AS INTEGER) AS override_applied, CASE WHEN hit THEN candidate_label ELSE final_label END AS final_label, CASE WHEN NOT hit THEN topic_final WHEN candidate_label = '1' THEN CASE WHEN fixed_candidate = 'U1' THEN 'U1' ELSE 'Urban_Renewal_Other' END ELSE CASE WHEN fixed_candidate = 'N2' THEN 'N2' ELSE 'Nonurban_Other' END END AS topic_final FROM h")
def m17(spark, sf):
    return R.refine(D.spark_frame(spark, sf, REFINE)).select("doc_id", "override_applied", "final_label", "topic_final")


# --- topic model tables ---


_ZERO = "z AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


def zero_topics(spark, sf):
    """A given topic for each label: the mean of its vectors."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector")).select(F.format_string("%02d", "label").alias("topic"), "vector")


@query("m18_nearest_topic", f"WITH {_ZERO}, s AS (SELECT vec_id, z.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), z.v) AS s FROM embeddings, z) SELECT vec_id, CAST(arg_max(label, s) AS INTEGER) AS topic, max(s) >= 0.68 AS zero_shot FROM s GROUP BY vec_id")
def m18(spark, sf):
    """The nearest given topic of each vector."""
    zero = sorted((int(r["topic"]), r["vector"]) for r in zero_topics(spark, sf).collect())
    found = TM.assign(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", TM.whole([v for _, v in zero]))
    return found.select("vec_id", F.get(F.array(*(F.lit(t) for t, _ in zero)), F.col("topic")).alias("topic"), (F.col("similarity") >= TM.Config().similarity).alias("zero_shot"))


def embedded(spark, sf):
    """Documents that have a vector, with it."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").join(e, "doc_id")


@query("m19_topic_model", None)
def m19_model(spark, sf):
    """Half of the labels are given topics; the rest is clustered."""
    zero = zero_topics(spark, sf).where(F.col("topic").cast("int") % 2 == 0)
    return TM.fit(embedded(spark, sf), "doc_id", "embedding", "text", zero)


_GRAMS = f"""t AS (SELECT doc_id, lang AS topic, list_filter(regexp_extract_all(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({', '.join(f"'{w}'" for w in T.STOP)})) AS w FROM documents),
p AS (SELECT *, unnest(generate_series(1, len(w))) AS i FROM t), g AS (SELECT doc_id, topic, w[i] AS term FROM p UNION ALL SELECT doc_id, topic, w[i] || ' ' || w[i + 1] FROM p WHERE i + 1 <= len(w) UNION ALL SELECT doc_id, topic, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM p WHERE i + 2 <= len(w)),
c AS (SELECT topic, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY 1, 2), o AS (SELECT term, sum(tf) AS all_tf, sum(df) AS all_df FROM c GROUP BY 1), k AS (SELECT c.*, all_tf FROM c JOIN o USING (term) WHERE all_df >= 3 AND all_df <= 0.92 * (SELECT count(*) FROM documents)),
s AS (SELECT topic, term, round(tf / CAST(sum(tf) OVER (PARTITION BY topic) AS DOUBLE) * ln(1 + (SELECT sum(tf) / CAST(count(DISTINCT topic) AS DOUBLE) FROM k) / CAST(all_tf AS DOUBLE)), 9) AS score FROM k)"""


@query("m19_class_terms", f"WITH {_GRAMS} SELECT topic, term, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) <= 10")
def m19_terms(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("lang").alias("topic"), "text")
    return TM.class_terms(S.spread(d), "topic", "text")


@query("m19_topic_stats", "WITH n AS (SELECT label % 5 AS topic, label, count(*) AS n, sum(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) AS p FROM embeddings GROUP BY 1, 2) SELECT topic, label AS majority, count, round(n / CAST(count AS DOUBLE), 6) AS purity, round(pos / CAST(count AS DOUBLE), 6) AS pos_rate FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY topic) AS BIGINT) AS count, sum(p) OVER (PARTITION BY topic) AS pos FROM n) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, label) = 1")
def m19(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumns({"topic": F.col("label") % 5, "pos": (F.col("vec_id") % 3 == 0).cast("int")})
    return T.topic_stats(e, "topic", "label", "pos")


@query("m21_auto_mapping", "WITH d AS (SELECT source AS topic, lang AS label, count(*) AS n FROM documents GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY topic) AS total FROM d), s AS (SELECT topic, label, n / CAST(total AS DOUBLE) AS share FROM c) SELECT topic, CASE WHEN share >= 0.3 THEN label ELSE '' END AS mapped_label, CASE WHEN share >= 0.3 THEN 'auto_combined_majority_seed_mapping' ELSE 'low_consensus_unknown' END AS mapping_source, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(share * 5, 9) DESC, label) = 1")
def m21(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("topic"), F.col("lang").alias("label"))
    none = spark.createDataFrame([], "topic string, label string, seed int")
    return T.auto_mapping(d, "topic", "label", none, 0.3, 0.3)


@query("m23_sample_titles", "WITH f AS (SELECT lang AS topic, trim(split_part(text, chr(10), 1)) AS t, min(doc_id) AS o FROM documents WHERE trim(split_part(text, chr(10), 1)) <> '' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY o) AS r FROM f) SELECT topic, string_agg(t, ' | ' ORDER BY r) AS sample_titles FROM k WHERE r <= 5 GROUP BY 1")
def m23(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("topic"), F.btrim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("t"))
    return T.sample_titles(d, "topic", "t", "doc_id")


@query("m24_source_split", "SELECT lang AS topic, string_agg(source || ':' || n, '; ' ORDER BY n DESC, source) AS source_split FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def m24(spark, sf):
    return T.source_split(spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "topic"), "topic", "source")


@query("m29_last_probability", "SELECT label AS topic, max(embedding[1]) FILTER (vec_id = m) AS probability FROM (SELECT *, max(vec_id) OVER (PARTITION BY label) AS m FROM (SELECT vec_id, label, [list_max(embedding)] AS embedding FROM embeddings)) GROUP BY 1")
def m29(spark, sf):
    return T.last_probability(spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("label", "topic"), "topic", "embedding", "vec_id")


@query("m25_primary_hint", "SELECT vec_id, vec_id % 3 <> 0 AND vec_id % 50 >= 35 AND (vec_id % 10) / 10.0 >= 0.8 AS primary_hint FROM embeddings")
def m25(spark, sf):
    v = F.col("vec_id")
    h = F.struct((v % 3 != 0).alias("available"), F.lit(False).alias("outlier"), F.lit("U1").alias("label"), F.lit("urban").alias("group"), (v % 50).alias("count"), ((v % 10) / 10).alias("purity"), F.lit(0.9).alias("probability"), F.lit(0.9).alias("share"))
    return spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("hint", h).select("vec_id", T.is_primary().alias("primary_hint"))


# --- statistics ---


@query("a21_bootstrap_intervals", None)
def a21(spark, sf):
    return stats.bootstrap(D.spark_frame(spark, sf, D.EVAL), "truth", "pred", ["lang"])


_MB, _MC = (f"CASE WHEN {D.binary('truth')} = {D.binary(p)} THEN 1 ELSE 0 END" for p in ("pred", "pred_c"))


@query("a22_mcnemar_counts", f"WITH e AS ({_E}), r AS (SELECT {_MB} AS x, {_MC} AS y FROM e), n AS (SELECT count(*) FILTER (x = 1 AND y = 0) AS b, count(*) FILTER (x = 0 AND y = 1) AS c FROM r) SELECT least(b, c) AS fewer, greatest(b, c) AS more, round(CASE WHEN b + c > 0 THEN (abs(b - c) - 1) ** 2 / (b + c) ELSE 0 END, 6) AS statistic FROM n")
def a22(spark, sf):
    m = stats.mcnemar(D.spark_frame(spark, sf, D.EVAL), "truth", ["pred", "pred_c"])
    return m.select(F.least("b", "c").alias("fewer"), F.greatest("b", "c").alias("more"), "statistic")
