"""Queries of discovery, contracts, strategies, tasks and evaluation (S, U, C, J, M, P): small literal frames, and whole tables where an operator takes one."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import functions as F

from quillgrid.functions import text
from quillgrid.operators import align as J
from quillgrid.operators import classify as C
from quillgrid.operators import crosstab as X
from quillgrid.operators import decide as H
from quillgrid.operators import lexicon as L
from quillgrid.operators import errors, runs
from quillgrid.operators import gate as G
from quillgrid.operators import phrases as P
from quillgrid.operators import topics as T
from quillgrid.plans import frames as D
from quillgrid.plans import model_queries as MQ
from quillgrid.plans import other_queries as OQ
from quillgrid.plans.registry import query
from quillgrid.sources import bundle, workbooks
from quillgrid.sources import manifest as U
from quillgrid.sources import tables as S
from quillgrid.streaming import resumable, sessions

_T, _E, _M = D.duck(D.TITLED), D.duck(D.EVAL), D.duck(D.MESSY)


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("s13_binary_model", f"WITH t AS ({_T}), k AS (SELECT doc_id, label, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(trim(title)), '\\s+', ' ', 'g'), '[a-z0-9]+'))) AS token FROM t), n AS (SELECT count(*) FILTER (label = '1') AS p, count(*) FILTER (label <> '1') AS n FROM (SELECT DISTINCT doc_id, label FROM k)) SELECT token, round(ln((count(*) FILTER (label = '1') + 1) / (max(p) + 2.0)) - ln((count(*) FILTER (label <> '1') + 1) / (max(n) + 2.0)), 9) AS weight FROM k, n GROUP BY token HAVING count(*) >= 2")
def s13(spark, sf):
    tokens = C.document_tokens(D.spark_frame(spark, sf, D.TITLED), "doc_id", text.unigrams("title"), ("label",))
    return C.fit_odds(tokens, "doc_id", "label")[0].select("token", F.round("weight", 9).alias("weight"))


# --- evaluation ---

_FILES = ("pred", "pred_b", "pred_c")
_BY_FILE = " UNION ALL ".join(f"SELECT '{p}.xlsx' AS file, * FROM (SELECT *, {D.scores()} FROM (SELECT {D.counts('truth', p)} FROM e))" for p in _FILES)


def evaluated(spark, sf):
    e = D.spark_frame(spark, sf, D.EVAL)
    return runs.evaluate(e, {f"{p}.xlsx": e.select("doc_id", F.col(p).alias("label"), "decision_source") for p in _FILES}, "doc_id", "truth", "label", "decision_source")


@query("c13_evaluate", f"WITH e AS ({_E}) SELECT file, total, tp, tn, fp, fn, accuracy, f1 FROM ({_BY_FILE})")
def c13(spark, sf):
    return evaluated(spark, sf)["metrics"].select("file", "total", "tp", "tn", "fp", "fn", "accuracy", "f1")


@query("s19_evaluate_file", f"WITH e AS ({_E}) SELECT file, precision, recall FROM ({_BY_FILE}) WHERE file = 'pred_b.xlsx'")
def s19(spark, sf):
    e = D.spark_frame(spark, sf, D.EVAL)
    return runs.evaluate(e, {"pred_b.xlsx": e.select("doc_id", F.col("pred_b").alias("label"))}, "doc_id", "truth", "label")["metrics"].select("file", "precision", "recall")


_SRC = f"(CASE WHEN {D.present('decision_source')} THEN {D.text('decision_source')} ELSE 'unknown_source' END)"


@query("s21_evaluation_run", f"WITH e AS ({_E}) SELECT file, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT DISTINCT '{p}.xlsx' AS file, {D.text('decision_source')} AS s FROM e" for p in _FILES) + ") GROUP BY file")
def s21(spark, sf):
    return evaluated(spark, sf)["sources"].groupBy("file").agg(F.count("*").alias("n"))


@query("s20_summary_tables", f"WITH e AS ({_E}) SELECT 'metrics' AS name, 3 AS n UNION ALL SELECT 'unknown', 3 UNION ALL SELECT 'sources', 3 * count(DISTINCT {D.text('decision_source')}) FROM e")
def s20(spark, sf):
    """All tables of an evaluation in one commit, read back."""
    folder = S.scratch(spark, "summary")
    bundle.write(evaluated(spark, sf), folder)
    return reduce(lambda a, b: a.union(b), [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n") for name, df in bundle.read(spark, folder).items()])


_BOOK = "SELECT doc_id, nullif(text, '') AS text, lang, n_chars FROM documents"


@query("s01_workbook_rows", _BOOK)
def s01(spark, sf):
    """Documents as workbooks of several sheets, one for each task, read back sheet by sheet."""
    folder = S.scratch(spark, "workbooks")
    workbooks.write(S.spread(read(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")), folder, sheet_rows=500)
    return workbooks.read(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.col("n_chars").cast("long").alias("n_chars"))


@query("s03_workbook_without_header", "SELECT doc_id, lang FROM documents")
def s03(spark, sf):
    folder = S.scratch(spark, "workbooks")
    workbooks.write(read(spark, sf, "documents").select("doc_id", "lang"), folder, header=False, sheet_rows=700)
    return workbooks.read(spark, folder, header=False).select(F.col("c1").cast("long").alias("doc_id"), F.col("c2").alias("lang"))


@query("x05_resumable_run", f"WITH {MQ._X}, {MQ._LONG}, {MQ._BEST} SELECT doc_id, CASE WHEN score <= 0 THEN 'Unknown' ELSE label END AS label FROM b2")
def x05(spark, sf):
    """Documents classified in batches; a second run finds them all entered. Tests stop it between batches."""
    docs = MQ.docs(spark, sf).select("doc_id", "title", "abstract")
    source, folder = S.scratch(spark, "input"), S.scratch(spark, "run")
    resumable.stage(docs, source, max(resumable.interval(docs.count()), 1000))
    best = lambda batch: L.score_topics(L.fields(batch), MQ.WORDS).select("doc_id", F.when(F.col("topics")[0]["score"] <= 0, "Unknown").otherwise(F.col("topics")[0]["label"]).alias("label"))
    for _ in range(2):
        resumable.run(spark, source, docs.schema, best, folder, files=8)
    return resumable.result(spark, folder)


@query("s22_review_tables", f"WITH r AS ({D.duck(D.REVIEW)}) SELECT topic, count(*) AS n FROM r WHERE trim(coalesce(topic, '')) <> '' GROUP BY topic")
def s22(spark, sf):
    r = X.normalize(D.spark_frame(spark, sf, D.REVIEW), "publication_year", "topic", "spatial_flag", "level", "detail")
    folder = S.scratch(spark, "review")
    S.write_tables({"topics": r.where(F.trim("topic") != "").groupBy("topic").agg(F.count("*").alias("n"))}, folder)
    return S.read_tables(spark, folder, ["topics"])["topics"]


@query("s23_table_exports", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s23(spark, sf):
    folder = S.scratch(spark, "exports")
    S.write_tables({"a long name, cut as the names of sheets are": read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))}, folder)
    return spark.read.parquet(f"{folder}/a_long_name_cut_as_the_names_of")


@query("p09_report_tables", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def p09(spark, sf):
    folder = S.scratch(spark, "tables")
    S.write_tables({"by source": read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))}, folder)
    return S.read_tables(spark, folder, ["by source"])["by source"]


def _stored(spark, value):
    path = f"{S.scratch(spark, 'manifest')}/manifest.json"
    S.write_json(spark, path, value)
    return S.read_json(spark, path)


@query("s26_run_summary", "SELECT count(*) AS rows, count(DISTINCT lang) AS langs FROM documents")
def s26(spark, sf):
    n = read(spark, sf, "documents").agg(F.count("*").alias("rows"), F.count_distinct("lang").alias("langs")).first().asDict()
    back = _stored(spark, n)
    return spark.createDataFrame([(back["rows"], back["langs"])], "rows long, langs long")


# --- strategies ---


def answers(spark, sf):
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", F.col("doc_id").alias("_row_id"), F.col("t").alias("title"), F.lit("").alias("abstract"), "answer", F.reverse("answer").alias("answer_2"), "lang")


_SIMPLE = "CASE answer_kind WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '1' WHEN 5 THEN '1' WHEN 6 THEN '0' WHEN 7 THEN '0' WHEN 8 THEN '1' WHEN 9 THEN '0' END"
_ANS = f"a AS (SELECT *, doc_id % 10 AS answer_kind FROM ({_M}))"


@query("u03_strategy_frames", f"WITH {_ANS} SELECT doc_id, {_SIMPLE} AS single, {_SIMPLE} AS stepwise FROM a")
def u03(spark, sf):
    """Both strategies (also U04, U05), resolved by name (U14)."""
    return answers(spark, sf).select("doc_id", *(runs.STRATEGIES[n]("answer").alias(n) for n in ("single", "stepwise")))


@query("u08_reflection_strategy", f"WITH {_ANS} SELECT doc_id, CASE WHEN answer_kind = 8 THEN '0' END AS target, CASE WHEN answer_kind = 8 THEN '7. City' END AS level, CASE WHEN answer_kind = 8 THEN 'Old town' END AS area FROM a")
def u08(spark, sf):
    second = F.when(F.col("doc_id") % 10 == 8, F.concat(F.lit("0\t0\t"), F.lit("7. City\tOld town"))).otherwise("")
    r = F.col("r")
    return answers(spark, sf).withColumn("answer_2", second).select("doc_id", runs.reflection().alias("r")).select("doc_id", r["target"].alias("target"), r["level"].alias("level"), r["area"].alias("area"))


@query("u12_step_prompt", "SELECT doc_id, 'Title: ' || lang || chr(10) || CASE WHEN doc_id % 3 <> 0 THEN '[TITLE_ABSTRACT_ONLY MODE]' || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'lang=' || lang || chr(10) ELSE '' END || 'Step 1: Urban renewal study? Output only 1 or 0.' AS prompt FROM documents")
def u12(spark, sf):
    d = read(spark, sf, "documents")
    hints = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("lang="), "lang")).otherwise("")
    return d.select("doc_id", runs.step_prompt(U.prompt({"Title": "lang"}), F.col("doc_id") % 3 == 0, hints, 1).alias("prompt"))


@query("u07_session_stream", OQ._WALK.replace("{rows}", "3").replace("{chars}", "900"))
def u07(spark, sf):
    """The sessions arrive in three parts, by turn; the stream is started anew for each, from its checkpoint."""
    c = read(spark, sf, "conversations")
    come, out, checkpoint = (S.scratch(spark, f"sessions-{x}") for x in ("in", "out", "state"))
    for part in ("turn < 2 or turn is null", "turn between 2 and 3", "turn > 3"):
        c.where(part).write.mode("append").parquet(come)
        stream = spark.readStream.schema(c.schema).parquet(come)
        sessions.run(sessions.context_windows(stream, "conv_id", "turn", "text", 3, 900), out, checkpoint)
    return spark.read.parquet(out).where("event = 'row'").select("conv_id", "turn", "context")


@query("u19_saved_sessions", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def u19(spark, sf):
    folder = S.scratch(spark, "sessions")
    read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").write.json(folder)
    back = spark.read.schema("conv_id long, turn long, role string, text string").json(folder)
    return back.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


# --- the first stage's parts ---

_STAGE = f"WITH {MQ._X}, {MQ._LONG}, {MQ._FIRST}"


def _rule(spark, sf, *names):
    r = F.col("rule")
    return MQ.first(spark, sf).select("doc_id", *(r[n].alias(n) for n in names))


@query("l08_stage_conflict", f"{_STAGE} SELECT doc_id, conflict FROM first")
def l08(spark, sf):
    return _rule(spark, sf, "conflict")


@query("l09_review_signal", f"{_STAGE} SELECT doc_id, CASE WHEN review_reason <> '' THEN 1 ELSE 0 END AS review_flag, review_reason FROM first")
def l09(spark, sf):
    return _rule(spark, sf, "review_flag", "review_reason")


@query("l10_route_reason", f"{_STAGE} SELECT doc_id, 'uncertain' AS route, reason FROM first")
def l10(spark, sf):
    return _rule(spark, sf, "route", "reason")


# --- guards ---

_TEXT = f"{MQ._Z}, b AS (SELECT *, CASE WHEN greenfield THEN 'risk_tag={P.GREENFIELD_RISK}' WHEN contains(title, 'farmland') THEN 'text=farmland' ELSE '' END AS block, contains(title, 'without renewal') AS negated FROM z)"


@query("h23_block_reason", f"{_TEXT} SELECT doc_id, block FROM b")
def h23(spark, sf):
    return H.signals(MQ.cases(spark, sf)).select("doc_id", H.block_reason(F.col("a")).alias("block"))


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(v, '{t.replace('-', ' ')}')" for t in dict.fromkeys(terms)) + ")"


_WORDED = f"{MQ._K}, v AS (SELECT *, title || ' ' || abstract AS v FROM c)"


@query("h30_anchor_evidence", f"{_WORDED} SELECT doc_id, CASE WHEN {_any(P.CORE_ANCHORS)} AND NOT {_any(P.NEGATIONS)} THEN 0.75 WHEN {_any(P.COMMON_ANCHORS)} AND NOT {_any(P.NEGATIONS)} THEN 0.65 WHEN {_any(P.EXISTING_OBJECTS)} THEN 0.65 WHEN {_any(P.MECHANISMS)} THEN 0.65 WHEN technical AND a = 'N8' THEN 0.45 ELSE 0.5 END AS p FROM v")
def h30(spark, sf):
    return H.signals(MQ.cases(spark, sf)).select("doc_id", H.anchor_evidence(F.col("a"))["p"].alias("p"))


@query("h48_anchor_signal", f"{_WORDED} SELECT doc_id, {_any(P.CORE_ANCHORS)} AS core, {_any(P.COMMON_ANCHORS)} AS broad, {_any(P.EXISTING_OBJECTS)} AS object, {_any(P.MECHANISMS)} AS mechanism, {_any(P.NEGATIONS)} AS negated FROM v")
def h48(spark, sf):
    sg = F.col("sig")
    return H.signals(MQ.cases(spark, sf)).select("doc_id", (F.size(sg["core"]) > 0).alias("core"), (F.size(sg["broad"]) > 0).alias("broad"), sg["object"].alias("object"), sg["mechanism"].alias("mechanism"), sg["negated"].alias("negated"))


_INSIDE = f"""{MQ._K}, w AS (SELECT *, CASE WHEN fb = 'urban' THEN lc * 8 END AS x, CASE WHEN fa = 'urban' AND a <> 'Unknown' THEN score END AS v FROM c),
t AS (SELECT *, greatest(x, v) AS top, CASE WHEN a <> b AND x IS NOT NULL AND v IS NOT NULL THEN least(x, v) ELSE 0 END AS next, CASE WHEN v IS NULL OR (x IS NOT NULL AND (x > v OR (x = v AND b < a))) THEN b ELSE a END AS best FROM w)"""


@query("h18_topic_within_family", f"{_INSIDE} SELECT doc_id, CASE WHEN top >= 2.8 AND round(greatest(top - next, 0), 4) >= 1 THEN best ELSE 'Unknown' END AS label, coalesce(round(top, 4), 0) AS score, CASE WHEN top IS NULL THEN 0 ELSE round(greatest(top - next, 0), 4) END AS margin FROM t")
def h18(spark, sf):
    w = F.col("within_in")
    return H.signals(MQ.cases(spark, sf)).select("doc_id", w["label"].alias("label"), w["score"].alias("score"), w["margin"].alias("margin"))


#: Labels of the cases are U1, U9, U12, N3, N4, N8; their rules have no marks and there is no topic-model hint, so rules that ask for those never hold.
_OFFLINE = f"""off AS (SELECT *, CASE WHEN a = 'U12' AND b = 'Unknown' AND margin >= 2 THEN 1 WHEN {' OR '.join(f"(a = '{a}' AND b = '{b}' AND lc >= {c} AND lm >= {m} AND p >= {q})" for (a, b), (c, m, q) in P.OFFLINE_LOCAL.items())} THEN 2 END AS n FROM c)"""


@query("h09_offline_resolution", f"{MQ._K}, {_OFFLINE} SELECT doc_id, CASE n WHEN 1 THEN a WHEN 2 THEN b END AS topic, CASE n WHEN 1 THEN 'unknown_offline_curated_rule' WHEN 2 THEN 'unknown_offline_curated_local' END AS path, CASE n WHEN 1 THEN greatest(rc, 0.66) WHEN 2 THEN greatest(lcr, 0.68) END AS confidence FROM off")
def h09(spark, sf):
    r = F.col("r")
    return H.fuse(H.signals(MQ.cases(spark, sf))).select("doc_id", H.offline().alias("r")).select("doc_id", r["topic"].alias("topic"), r["path"].alias("path"), r["confidence"].alias("confidence"))


_PAIRED = lambda table, test: "(" + " OR ".join(f"(a = '{a}' AND b = '{b}' AND {test(v)})" for (a, b), v in table.items()) + ")"
_HINTED = f"""hin AS (SELECT *, CASE WHEN a <> 'Unknown' AND b = 'Unknown' AND fa = 'nonurban' AND llm = '0' AND rc >= 0.24 THEN 1
  WHEN a <> 'Unknown' AND b = 'Unknown' AND llm = '1' AND ({' OR '.join(f"(a = '{a}' AND rc >= {v})" for a, v in P.WEAK_RULES.items())}) THEN 2 WHEN a <> 'Unknown' AND b = 'Unknown' AND fa = 'urban' AND llm = '1' AND rc >= 0.35 THEN 3
  WHEN fa = 'urban' AND fb = 'nonurban' AND llm = '1' AND {_PAIRED(P.RULE_TO_TOPIC, lambda v: f"rc >= {v}")} THEN 4 WHEN fa = 'nonurban' AND fb = 'urban' AND llm = '1' AND {_PAIRED(P.RULE_TO_LOCAL, lambda v: f"lc >= {v[0]} AND lm >= {v[1]}")} THEN 5 END AS h FROM c)"""


@query("h13_hinted_resolution", f"{MQ._K}, {_HINTED} SELECT doc_id, CASE WHEN h <= 4 THEN a WHEN h = 5 THEN b END AS topic, CASE WHEN h IS NOT NULL THEN 'unknown_hint_resolution' END AS path, CASE WHEN h <= 2 THEN greatest(rc, 0.60) WHEN h <= 4 THEN greatest(rc, 0.62) WHEN h = 5 THEN greatest(lcr, 0.68) END AS confidence FROM hin")
def h13(spark, sf):
    r = F.col("r")
    return H.fuse(H.signals(MQ.cases(spark, sf))).select("doc_id", H.hinted().alias("r")).select("doc_id", r["topic"].alias("topic"), r["path"].alias("path"), r["confidence"].alias("confidence"))


#: The best label within the family that the hint names, and whether enough sources bear it out.
_AGREED = f"""wi AS (SELECT *, CASE llm WHEN '1' THEN 'urban' WHEN '0' THEN 'nonurban' END AS fam FROM c), wx AS (SELECT *, CASE WHEN fb = fam AND b <> 'Unknown' THEN lc * 8 END AS x, CASE WHEN fa = fam AND a <> 'Unknown' THEN score END AS v FROM wi),
wt AS (SELECT *, greatest(x, v) AS top, CASE WHEN a <> b AND x IS NOT NULL AND v IS NOT NULL THEN least(x, v) ELSE 0 END AS nxt, CASE WHEN v IS NULL OR (x IS NOT NULL AND (x > v OR (x = v AND b < a))) THEN b ELSE a END AS best FROM wx),
ws AS (SELECT *, round(greatest(top - nxt, 0), 4) AS wm, round(top, 4) AS wsc FROM wt), con AS (SELECT *, coalesce(fam IS NOT NULL AND top >= 2.8 AND wm >= 1 AND fa = fam AND wsc >= CASE WHEN best = a THEN 4.8 ELSE 3.4 END AND (best = a OR best = b), false) AS agreed FROM ws)"""
_RESOLVING = f"""k AS (SELECT *, {MQ._FUSE} AS fn FROM c), fu AS (SELECT doc_id, CASE WHEN fn IN (3, 4, 6, 9, 12, 15) THEN a WHEN fn IN (1, 5, 7, 11, 13, 14) THEN b ELSE 'Unknown' END AS topic, CASE WHEN fn IN (1, 3, 4, 6, 9, 12, 15) THEN 'rule_model_fusion' WHEN fn IN (5, 7, 11, 13, 14) THEN 'stage2_classifier' ELSE 'unknown_review' END AS source FROM k), {_OFFLINE}, {_HINTED}, {_AGREED},
res AS (SELECT fu.doc_id, fu.topic, fu.source, CASE WHEN fu.topic <> 'Unknown' THEN 'not_triggered' WHEN off.n = 1 THEN 'unknown_offline_curated_rule' WHEN off.n = 2 THEN 'unknown_offline_curated_local' WHEN hin.h IS NOT NULL THEN 'unknown_hint_resolution' WHEN con.agreed THEN 'unknown_hint_consensus' ELSE 'retained_unknown' END AS path,
  CASE WHEN fu.topic <> 'Unknown' THEN fu.topic WHEN off.n = 1 THEN off.a WHEN off.n = 2 THEN off.b WHEN hin.h <= 4 THEN hin.a WHEN hin.h = 5 THEN hin.b WHEN con.agreed THEN con.best ELSE 'Unknown' END AS now FROM fu JOIN off USING (doc_id) JOIN hin USING (doc_id) JOIN con USING (doc_id))"""


@query("h08_unknown_resolution", f"{MQ._K}, {_RESOLVING} SELECT doc_id, path, now AS topic FROM res")
def h08(spark, sf):
    df = H.resolve_unknown(H.fuse(H.signals(MQ.cases(spark, sf))))
    return df.select("doc_id", F.col("recovery.path").alias("path"), F.col("decision.topic").alias("topic"))


#: The gate's family, and the best label within it; then whether an unknown topic takes it.
_GATED = f"""{MQ._Z}, {_RESOLVING}, gp AS (SELECT doc_id, 1 / (1 + exp(-z)) AS gp FROM z), gf AS (SELECT *, CASE WHEN gp >= 0.72 THEN 'urban' WHEN gp <= 0.28 THEN 'nonurban' ELSE 'unknown' END AS gfam, round(abs(gp - 0.5) * 2, 4) AS gc FROM gp),
ix AS (SELECT c.*, gfam, gc, gp, now, path, source, CASE WHEN fb = gfam AND b <> 'Unknown' THEN lc * 8 END AS x, CASE WHEN fa = gfam AND a <> 'Unknown' THEN CASE WHEN now = a THEN greatest(score, lc * 8) ELSE score END END AS v FROM c JOIN gf USING (doc_id) JOIN res USING (doc_id)),
iy AS (SELECT *, greatest(x, v) AS top, CASE WHEN a <> b AND x IS NOT NULL AND v IS NOT NULL THEN least(x, v) ELSE 0 END AS nxt, CASE WHEN v IS NULL OR (x IS NOT NULL AND (x > v OR (x = v AND b < a))) THEN b ELSE a END AS best FROM ix),
iz AS (SELECT *, round(greatest(top - nxt, 0), 4) AS im, round(top, 4) AS isc FROM iy), inn AS (SELECT *, CASE WHEN gfam <> 'unknown' AND top >= 2.8 AND im >= 1 THEN best ELSE 'Unknown' END AS within FROM iz),
rec AS (SELECT *, coalesce(now = 'Unknown' AND within <> 'Unknown' AND isc >= 4 AND im >= 1 AND gc >= 0.82 AND gfam = CASE llm WHEN '1' THEN 'urban' WHEN '0' THEN 'nonurban' END AND fa = gfam, false) AS recovers FROM inn),
dec AS (SELECT *, CASE WHEN recovers THEN within ELSE now END AS topic, CASE WHEN recovers THEN 'family_gate_recovery' ELSE path END AS way, CASE WHEN recovers THEN 'family_gate_recovery' WHEN path LIKE 'unknown%' THEN 'unknown_hint_resolution' ELSE source END AS src FROM rec)"""


@query("h19_family_gate", f"{_GATED} SELECT doc_id, way AS path, within, src AS source FROM dec")
def h19(spark, sf):
    df = G.gate(G.features(H.resolve_unknown(H.fuse(H.signals(MQ.cases(spark, sf))))))
    return H.apply_gate(df).select("doc_id", F.col("recovery.path").alias("path"), F.col("inner.label").alias("within"), F.col("decision.source").alias("source"))


_BUCKET = f"CASE WHEN fa = 'unknown' AND fb = 'unknown' THEN 'double_unknown' WHEN fa = 'urban' AND fb = 'nonurban' THEN {MQ._accross('a', 'b', 'urban_rule_nonurban_local')} WHEN fa = 'nonurban' AND fb = 'urban' THEN {MQ._accross('b', 'a', 'nonurban_rule_urban_local')} ELSE 'other' END"
#: The only core anchor of the cases' texts is "urban renewal", and of what blocks a promotion only the greenfield tag stands beside it.
_GUARDED = f"""{_GATED}, {_INSIDE[_INSIDE.index("w AS (SELECT"):].replace("w AS (SELECT", "gw AS (SELECT", 1).replace("FROM w)", "FROM gw)").replace("t AS (SELECT", "gi AS (SELECT")},
gu AS (SELECT d.*, gi.best AS wl, round(gi.top, 4) AS ws, round(greatest(gi.top - gi.next, 0), 4) AS wm, {_BUCKET.replace("fa ", "d.fa ").replace("fb ", "d.fb ").replace(" a IN", " d.a IN").replace(" b IN", " d.b IN")} AS bucket, gi.top >= 2.8 AND round(greatest(gi.top - gi.next, 0), 4) >= 1 AS wok FROM dec d JOIN gi USING (doc_id)),
gv AS (SELECT *, CASE WHEN within LIKE 'U%' AND within <> 'Unknown' THEN within WHEN b LIKE 'U%' AND b <> 'Unknown' THEN b END AS given, coalesce(wok AND ws >= 3.6 AND wm >= 1, false) AS good FROM gu),
gx AS (SELECT *, coalesce(given, CASE WHEN good THEN wl END) AS cand, concat_ws('; ', CASE WHEN given IS NULL AND good THEN printf('urban_within_candidate:%s@%.2f/%.2f', wl, ws, wm) END, 'urban_candidate:' || coalesce(given, CASE WHEN good THEN wl END), CASE WHEN round(gp, 6) >= 0.40 THEN 'family_probability_urban>=0.40' END, CASE WHEN p >= 0.50 THEN 'topic_binary_probability>=0.50' END, CASE WHEN bucket IN ({', '.join(f"'{x}'" for x in P.GUARD_BUCKETS)}) THEN 'boundary_bucket:' || bucket END) AS marks,
  topic LIKE 'N%' AND contains(title, 'urban renewal') AS applies FROM gv)"""


@query("h21_anchor_guard", f"{_GUARDED} SELECT doc_id, CASE WHEN NOT applies THEN '' WHEN greenfield THEN 'blocked_nonurban_risk' WHEN cand IS NOT NULL AND marks <> '' THEN 'promote' ELSE 'review' END AS action, CASE WHEN NOT applies THEN '' WHEN greenfield THEN 'risk_tag={P.GREENFIELD_RISK}' WHEN cand IS NOT NULL AND marks <> '' THEN marks WHEN marks <> '' THEN 'support_without_urban_candidate;' || marks ELSE 'core_anchor_without_support' END AS reason FROM gx")
def h21(spark, sf):
    df = G.gate(G.features(H.resolve_unknown(H.fuse(H.signals(MQ.cases(spark, sf))))))
    return H.anchor_guard(H.apply_gate(df)).select("doc_id", F.col("guard.action").alias("action"), F.col("guard.reason").alias("reason"))


_DOUBTED = f"""{_GUARDED}, ga AS (SELECT *, CASE WHEN NOT applies THEN '' WHEN greenfield THEN 'blocked_nonurban_risk' WHEN cand IS NOT NULL AND marks <> '' THEN 'promote' ELSE 'review' END AS ga FROM gx),
da AS (SELECT ga.*, topic LIKE 'N%' AND margin < 2 AND fn IN (1, 6) AND src = 'rule_model_fusion' AND ga IN ('', 'blocked_nonurban_risk') AS doubts, coalesce(within LIKE 'U%' AND within <> 'Unknown' AND isc >= 3.4 AND im >= 1, false) AS by_inner, b LIKE 'U%' AND b <> 'Unknown' AND lc >= 0.62 AND lm >= 1.2 AS by_local, round(gp, 6) >= 0.52 AND bucket IN ({', '.join(f"'{x}'" for x in P.PROMOTE_BUCKETS)}) AS by_family FROM ga JOIN (SELECT doc_id, fn FROM k) USING (doc_id)),
db AS (SELECT *, by_family AND NOT by_inner AND NOT by_local AND coalesce(wok, false) AS falls FROM da),
dc AS (SELECT *, CASE WHEN by_inner THEN within WHEN by_local THEN b WHEN falls THEN wl END AS promoted, concat_ws('; ', CASE WHEN by_inner THEN printf('within_family:%s@%.2f/%.2f', within, isc, im) END, CASE WHEN by_local THEN printf('local_urban:%s@%.2f/%.2f', b, lc, lm) END, CASE WHEN by_family THEN printf('family_prob_bucket:%.2f:%s', round(gp, 6), bucket) END, CASE WHEN falls THEN printf('fallback_within:%s@%.2f/%.2f', wl, ws, wm) END) AS why,
  CASE WHEN greenfield THEN 'risk_tag={P.GREENFIELD_RISK}' WHEN contains(title, 'farmland') THEN 'text=farmland' WHEN NOT contains(title, 'renewal') THEN 'missing_renewal_anchor' ELSE '' END AS stop, CASE WHEN contains(title, 'urban renewal') THEN 'core_anchor:urban renewal' WHEN contains(title, 'renewal') THEN 'broad_anchor:renewal' END AS meaning FROM db)"""


@query("h24_uncertain_guard", f"{_DOUBTED} SELECT doc_id, CASE WHEN NOT doubts THEN '' WHEN promoted IS NOT NULL AND stop <> '' THEN 'blocked_nonurban_risk' WHEN promoted IS NOT NULL THEN 'promote' WHEN a IN {P.HIGH_RISK_RULES} OR (a = 'N8' AND meaning IS NOT NULL) THEN 'review' ELSE 'keep_0' END AS action, CASE WHEN NOT doubts THEN '' WHEN promoted IS NOT NULL AND stop <> '' THEN stop WHEN promoted IS NOT NULL THEN why WHEN a IN {P.HIGH_RISK_RULES} OR (a = 'N8' AND meaning IS NOT NULL) THEN concat_ws('; ', 'high_risk_rule:' || a, meaning) ELSE 'rule=' || a || ' not in high_risk_bucket' END AS reason FROM dc")
def h24(spark, sf):
    df = G.gate(G.features(H.resolve_unknown(H.fuse(H.signals(MQ.cases(spark, sf))))))
    return H.uncertain_guard(H.anchor_guard(H.apply_gate(df))).select("doc_id", F.col("doubt.action").alias("action"), F.col("doubt.reason").alias("reason"))


#: What is decided after both guards. Of the cases' texts only the titles with "urban renewal" bear an open-set topic out.
_OPENED = f"""{_DOUBTED}, oa AS (SELECT *, CASE WHEN NOT doubts THEN '' WHEN promoted IS NOT NULL AND stop <> '' THEN 'blocked' WHEN promoted IS NOT NULL THEN 'promote' WHEN a IN {P.HIGH_RISK_RULES} OR (a = 'N8' AND meaning IS NOT NULL) THEN 'review' ELSE 'keep' END AS du FROM dc),
ob AS (SELECT *, CASE WHEN ga = 'promote' THEN cand WHEN du = 'promote' THEN promoted ELSE topic END AS t2, CASE WHEN ga = 'promote' THEN 'anchor_guard_promotion' WHEN ga = 'review' THEN 'anchor_guard_review' WHEN du = 'promote' THEN 'uncertain_nonurban_promotion' WHEN du = 'review' THEN 'uncertain_nonurban_review' ELSE src END AS s2 FROM oa),
oc AS (SELECT *, t2 <> 'Unknown' AND NOT (t2 LIKE 'N%' AND s2 IN ('uncertain_nonurban_review', 'anchor_guard_review')) AS covered, contains(title, 'urban renewal') AND NOT greenfield AS borne FROM ob)"""


@query("h26_open_set", f"{_OPENED} SELECT doc_id, CASE WHEN covered OR NOT borne THEN 0 ELSE 1 END AS flag, CASE WHEN covered THEN 'covered' WHEN borne THEN 'open_set' WHEN t2 = 'Unknown' THEN 'unknown' ELSE 'covered' END AS coverage, CASE WHEN NOT covered AND borne THEN 'core_renewal_anchor' ELSE '' END AS reason FROM oc")
def h26(spark, sf):
    df = G.gate(G.features(H.resolve_unknown(H.fuse(H.signals(MQ.cases(spark, sf))))))
    df = H.open_set(H.rule_review(H.uncertain_guard(H.anchor_guard(H.apply_gate(df)))))
    return df.select("doc_id", F.col("open.flag").alias("flag"), F.col("open.coverage").alias("coverage"), F.col("open.reason").alias("reason"))


def _said(terms) -> str:
    return _any(terms).replace("contains(v,", "contains(txt,")


_VOTE = lambda c: f"CASE WHEN {c} = 'Urban_Renewal_Other' THEN 1.0 WHEN {c} LIKE 'U%' AND {c} <> 'Unknown' THEN 1.0 WHEN {c} LIKE 'N%' THEN 0.0 ELSE 0.5 END"
_INSIDE_OF = lambda c: f"({c} LIKE 'U%' AND {c} <> 'Unknown')"
_PROMOTED = ", ".join(f"'{x}'" for x in H.PROMOTIONS)
_SCORED = f"""{_OPENED}, od AS (SELECT oc.*, title || ' ' || abstract AS txt, h, off.n AS curated, fu.topic AS fused, CASE WHEN NOT covered AND borne THEN 'Urban_Renewal_Other' ELSE t2 END AS t3, CASE WHEN NOT covered AND borne THEN 'open_set_recovery' ELSE s2 END AS s3 FROM oc JOIN (SELECT doc_id, h FROM hin) USING (doc_id) JOIN (SELECT doc_id, n FROM off) AS off USING (doc_id) JOIN (SELECT doc_id, topic FROM fu) AS fu USING (doc_id)),
oe AS (SELECT *, {_said(P.NEGATIONS)} AS neg, {_said(P.CORE_ANCHORS)} AND NOT {_said(P.NEGATIONS)} AS core, {_said(P.COMMON_ANCHORS)} AND NOT {_said(P.NEGATIONS)} AS broad, {_said(P.EXISTING_OBJECTS)} AS obj, {_said(P.MECHANISMS)} AS mech, {_said(P.CONTEXT)} AS ctx, {_INSIDE_OF('a')} OR {_INSIDE_OF('b')} OR {_INSIDE_OF('within')} OR {_INSIDE_OF('t3')} AS topical FROM od),
og AS (SELECT *, round(least(greatest(0.40 * round(gp, 6) + 0.25 * p + 0.20 * round(({_VOTE('a')} + {_VOTE('b')} + {_VOTE('within')} + 0.5 + {_VOTE('t3')}) / 5, 6) + 0.10 * CASE WHEN core THEN 0.75 WHEN broad OR obj OR mech THEN 0.65 WHEN technical AND t3 = 'N8' THEN 0.45 ELSE 0.5 END + 0.05 * CASE llm WHEN '1' THEN 1.0 WHEN '0' THEN 0.0 ELSE 0.5 END
  + CASE WHEN technical THEN -0.06 ELSE 0 END + CASE WHEN greenfield THEN -0.12 ELSE 0 END + CASE WHEN s3 IN ({_PROMOTED}) THEN 0.16 WHEN s3 = 'unknown_hint_resolution' AND fused = 'Unknown' AND curated IS NULL AND h = 1 THEN -0.10 ELSE 0 END, 0.02), 0.98), 6) AS raw FROM oe),
oh AS (SELECT *, (technical AND t3 = 'N8' AND NOT (core OR broad OR obj)) OR (greenfield AND NOT (core OR broad)) AS blocked, CASE WHEN s3 IN ({_PROMOTED}) THEN 6 WHEN core THEN 5 WHEN {_INSIDE_OF('t3')} THEN 4 WHEN broad AND (ctx OR topical OR obj) THEN 3 WHEN topical AND (obj OR mech OR ctx) THEN 2 WHEN raw >= 0.067 AND (ctx OR topical OR obj OR mech) AND NOT neg THEN 1 END AS rank_ FROM og),
oi AS (SELECT *, CASE rank_ WHEN 6 THEN 0.62 WHEN 5 THEN 0.58 WHEN 4 THEN 0.56 WHEN 3 THEN 0.52 WHEN 2 THEN 0.50 WHEN 1 THEN 0.46 END AS floor FROM oh),
oj AS (SELECT *, CASE WHEN blocked OR rank_ IS NULL OR floor <= raw THEN raw ELSE floor END AS bscore, CASE WHEN blocked THEN 'blocked' WHEN rank_ IS NULL OR floor <= raw THEN 'none' ELSE ['context_relevance_floor', 'urban_evidence_context_floor', 'broad_anchor_context_floor', 'final_topic_urban_floor', 'core_anchor_floor', 'guard_promotion_floor'][rank_] END AS tier FROM oi),
ok AS (SELECT *, CASE WHEN bscore >= 0.45 THEN '1' ELSE '0' END AS blabel, CASE WHEN t3 = 'Unknown' THEN 'unknown' WHEN t3 LIKE 'U%' THEN 'urban' ELSE 'nonurban' END AS tfam FROM oj)"""


def _chain(spark, sf):
    df = G.gate(G.features(H.resolve_unknown(H.fuse(H.signals(MQ.cases(spark, sf))))))
    return H.binary_decision(H.open_set(H.rule_review(H.uncertain_guard(H.anchor_guard(H.apply_gate(df))))))


@query("h31_binary_decision", f"{_SCORED} SELECT doc_id, CAST(bscore AS DOUBLE) AS score, blabel AS label, tier FROM ok")
def h31(spark, sf):
    b = F.col("binary")
    return _chain(spark, sf).select("doc_id", b["score"].alias("score"), b["label"].alias("label"), b["recall"]["tier"].alias("tier"))


_AUDIT = """CASE WHEN blabel = '1' AND tfam <> 'urban' THEN 'positive_binary_conflict_audit' WHEN blabel = '0' AND tfam <> 'nonurban' THEN 'negative_binary_conflict_audit' ELSE 'covered' END"""
_WHY = """concat_ws(';', CASE WHEN abs(bscore - 0.45) <= 0.005 THEN 'binary_near_threshold' END, CASE WHEN tfam = 'unknown' OR (blabel = '1' AND tfam <> 'urban') OR (blabel = '0' AND tfam = 'urban') THEN 'binary_topic_inconsistency' END, CASE WHEN tier = 'blocked' AND blabel = '1' THEN 'risk_blocked_positive' END, CASE WHEN ga = 'review' AND marks = '' THEN 'anchor_guard_core_anchor_without_support' WHEN ga = 'review' THEN 'anchor_guard_support_without_urban_candidate' END, CASE WHEN du = 'review' THEN 'uncertain_nonurban_review' END)"""


@query("h36_binary_audit", f"{_SCORED} SELECT doc_id, {_AUDIT} AS action, CASE WHEN {_WHY} = '' THEN 0 ELSE 1 END AS flag, {_WHY} AS reason FROM ok")
def h36(spark, sf):
    return H.audit(_chain(spark, sf)).select("doc_id", F.col("audit.action").alias("action"), F.col("review.flag").alias("flag"), F.col("review.reason").alias("reason"))


# --- tasks ---

_LABEL = "CASE answer_kind WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '1' WHEN 4 THEN '0' WHEN 5 THEN '1' WHEN 6 THEN '0' WHEN 7 THEN '0' WHEN 8 THEN '1' ELSE '0' END"


@query("h44_answered_rows", f"WITH {_ANS} SELECT doc_id, {_LABEL} AS final_label, 'pure_llm_api' AS decision_source, CASE WHEN answer_kind = 4 THEN 'empty_text' ELSE 'other' END AS reason, 1 AS llm_used FROM a")
def h44(spark, sf):
    out = runs.answered(answers(spark, sf), "answer")
    return out.select("doc_id", "final_label", "decision_source", F.when(F.col("decision_reason") == "empty_text", "empty_text").otherwise("other").alias("reason"), "llm_used")


def _spatial_answers(spark, sf):
    k = F.col("doc_id") % 3
    body = F.when(k == 0, '{"Is_Spatial_Research": true, "Specific_Study_Area": "Old Harbour", "Spatial_Scale_Level": "8. District", "Reasoning": "r", "Confidence": "High"}').when(k == 1, '{"Is_Spatial_Research": false}').otherwise("nothing")
    title = F.when(F.col("doc_id") % 4 == 0, F.col("title")).otherwise("Renewal in Old Harbour")
    return answers(spark, sf).withColumns({"answer": body, "title": title}).withColumn("title", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("title")))


_SPATIAL = f"""p AS (SELECT doc_id, doc_id % 3 AS k, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 4 = 0 THEN t ELSE 'Renewal in Old Harbour' END AS title FROM ({_M})),
q AS (SELECT *, k = 0 AND contains(lower(coalesce(title, '')), 'old harbour') AS ok FROM p WHERE coalesce(title, '') <> '')"""


@query("c07_spatial_task", f"WITH {_SPATIAL} SELECT doc_id, CASE WHEN ok THEN '1' ELSE '0' END AS is_spatial, CASE WHEN ok THEN '8. District / County Scale' ELSE 'Not mentioned' END AS spatial_level, CASE WHEN ok THEN 'Old Harbour' ELSE 'Not mentioned' END AS spatial_desc FROM q")
def c07(spark, sf):
    return runs.spatial(_spatial_answers(spark, sf)).select(F.col("_row_id").alias("doc_id"), "is_spatial", "spatial_level", "spatial_desc")


def _target(df):
    return runs.answered(runs.not_blank(df), "title").select("_row_id", "title", "final_label")


_YES = "CASE WHEN contains(title, 'Old Harbour') THEN '0' END"


@query("c08_both_tasks", f"WITH {_SPATIAL} SELECT doc_id, CASE WHEN ok THEN '1' ELSE '0' END AS is_spatial, 'pure' AS method FROM q")
def c08(spark, sf):
    src = _spatial_answers(spark, sf)
    both = runs.both(_target(src), runs.spatial(src, keep=("_row_id",)))
    return both.select(F.col("_row_id").alias("doc_id"), "is_spatial", F.lit("pure").alias("method"))


@query("c05_run_by_task", f"WITH {_SPATIAL} SELECT 'spatial' AS task, doc_id FROM q UNION ALL SELECT 'urban_renewal', doc_id FROM q UNION ALL SELECT 'both', doc_id FROM q")
def c05(spark, sf):
    src = _spatial_answers(spark, sf)
    out = None
    for task in ("spatial", "urban_renewal", "both"):
        one = runs.run(src, task, _target, lambda d: runs.spatial(d, keep=("_row_id",))).select(F.lit(task).alias("task"), F.col("_row_id").alias("doc_id"))
        out = one if out is None else out.unionByName(one)
    return out


@query("c10_batch_of_strategies", f"WITH {_ANS} SELECT doc_id, {_SIMPLE} AS single_label, {_LABEL} AS stepwise_long_label FROM a WHERE coalesce(t, '') <> ''")
def c10(spark, sf):
    return runs.batch(answers(spark, sf), {"single": "answer", "stepwise_long": "answer"}).select("doc_id", "single_label", "stepwise_long_label")


@query("c11_parallel_predictions", f"WITH {_ANS} SELECT doc_id, {_SIMPLE.replace('END', chr(69) + 'LSE NULL END')} AS label FROM a")
def c11(spark, sf):
    return U.replay(answers(spark, sf).select("doc_id"), answers(spark, sf).select("doc_id", runs.single().alias("answer")), "doc_id").select("doc_id", F.col("answer").alias("label"))


@query("c09_postprocess", None)
def c09(spark, sf):
    """What is open among all documents is clustered, and firm clusters correct its labels."""
    open_ = F.col("doc_id") % 2 == 0
    d = MQ.docs(spark, sf).withColumns({"source_pool": F.when(open_, "unknown_pool").otherwise(""), "final_label": F.when(open_, "").otherwise("1"), "topic_final": F.when(open_, "Unknown").otherwise("U1"), "coverage": F.when(open_, "unknown").otherwise("covered"), "guard_action": F.lit(""), "review_flag": open_.cast("string"), "score": F.lit("0.4"), "threshold": F.lit("0.45")})
    out = runs.postprocess(d, "doc_id", "text", MQ.WORDS, discover=True, refined=True, settings={"least_size": "2", "least_confidence": "0.3"})
    return out.select("doc_id", "cluster", "mapping_status", "candidate_label", "override_applied", "final_label", "topic_final")


# --- labels, metadata, reports ---


@query("j15_label_frame", f"WITH t AS ({_T}) SELECT coalesce(lower(trim(title)), 'nan') AS _key, min(doc_id) AS doc_id, CAST(arg_min(label, doc_id) AS INTEGER) AS truth FROM t GROUP BY 1")
def j15(spark, sf):
    return runs.label_frame(D.spark_frame(spark, sf, D.TITLED), "label").select("_key", F.col("_row_id").alias("doc_id"), "truth")


@query("j16_spatial_frame", f"WITH t AS ({_T}) SELECT coalesce(lower(trim(title)), 'nan') AS _key, CAST(arg_min(label, doc_id) AS INTEGER) AS spatial_pred, arg_min(lang, doc_id) AS spatial_level_pred FROM t GROUP BY 1")
def j16(spark, sf):
    t = D.spark_frame(spark, sf, D.TITLED).select("_row_id", "title", F.col("label").alias("is_spatial"), F.col("lang").alias("spatial_level"), F.col("lang").alias("spatial_desc"))
    return runs.spatial_frame(t).select("_key", "spatial_pred", "spatial_level_pred")


@query("j23_review_input", f"WITH t AS ({_T}) SELECT _row_id, title, lang, label AS predicted FROM t")
def j23(spark, sf):
    t = D.spark_frame(spark, sf, D.TITLED)
    return errors.review_frame(t, None, ["title", "lang"], {"predicted": ["final_label", "label"]})


@query("p12_export_tables", "SELECT 'langs' AS \"table\", lang AS label, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang UNION ALL SELECT 'facts', 'rows', CAST(count(*) AS DOUBLE) FROM documents")
def p12(spark, sf):
    d = read(spark, sf, "documents")
    out = runs.export_tables(d.agg(F.count("*").alias("rows")), {"langs": d.groupBy("lang").agg(F.count("*").alias("n"))}, {"langs": "n"})
    folder = S.scratch(spark, "exports")
    bundle.write(out, folder)
    out = bundle.read(spark, folder)
    return out["langs"].unionByName(out["facts"].select(F.lit("facts").alias("table"), F.col("fact").alias("label"), F.col("value").cast("double").alias("value")))


# --- models ---


@query("m05_saved_model", f"{MQ._TOK} SELECT token, round(weight, 9) AS weight, 'odds' AS kind FROM w")
def m05(spark, sf):
    folder = S.scratch(spark, "model")
    runs.save_bundle(C.fit_odds(MQ.labelled_tokens(spark, sf), "doc_id", "quality")[0], folder, {"kind": "odds", "rows": "all"})
    model, settings = runs.load_bundle(spark, folder)
    return model.select("token", F.round("weight", 9).alias("weight"), F.lit(settings["kind"]).alias("kind"))


@query("m26_intact_bundle", "SELECT * FROM (VALUES ('documents', true), ('labels', false), ('pages', false)) AS v(name, intact)")
def m26(spark, sf):
    bundle = {n: read(spark, sf, n) for n in ("documents", "labels", "pages")}
    kept = runs.fingerprint(bundle["documents"]).select(F.lit("documents").alias("name"), "*").unionByName(runs.fingerprint(bundle["labels"].where("quality = 1")).select(F.lit("labels").alias("name"), "*"))
    return runs.intact(bundle, kept)


_SEEDS = {t.label: sorted({w for x in (t.name, *t.seeds, *t.context_terms) for w in x.lower().replace("-", " ").split() if len(w) >= 3}) for t in MQ.WORDS.topics}
_SEED_ROWS = ", ".join(f"('{k}', '{w}')" for k, v in _SEEDS.items() for w in v)


@query("m20_seed_overlap", f"WITH {MQ._TERM}, s AS (SELECT DISTINCT doc_id, unnest(string_split(term, '_')) AS word FROM u), k AS (SELECT * FROM (VALUES {_SEED_ROWS}) AS v(label, word)) SELECT doc_id, label, count(*) AS overlap FROM s JOIN k USING (word) GROUP BY 1, 2")
def m20(spark, sf):
    return T.seed_words(MQ.spread_docs(spark, sf), "doc_id", "text", T.seed_tokens(MQ.WORDS)).distinct().groupBy("doc_id", "label").agg(F.count("*").alias("overlap"))


@query("m04_gate_training", "SELECT doc_id, quality AS label FROM labels WHERE quality IN (0, 1)")
def m04(spark, sf):
    """The rows that the gate's fit takes: labelled ones, a label each. ``l19_fitted_gate`` fits it."""
    return J.keep_first(read(spark, sf, "labels").withColumn("_row_id", F.col("doc_id")).where(F.col("quality").isin(0, 1)), "doc_id")[0].select("doc_id", F.col("quality").alias("label"))


@query("a40_topic_artifacts", "WITH n AS (SELECT d.lang AS topic, l.quality AS label, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2), t AS (SELECT topic, sum(n) AS count, arg_max(label, (n, -label)) AS majority, max(n) AS top, sum(n) FILTER (label = 1) AS pos FROM n GROUP BY 1), s AS (SELECT lang AS topic, string_agg(source || ':' || n, '; ' ORDER BY n DESC, source) AS source_split FROM (SELECT lang, source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) GROUP BY 1) SELECT topic, majority, CAST(count AS BIGINT) AS count, round(top / CAST(count AS DOUBLE), 6) AS purity, round(coalesce(pos, 0) / CAST(count AS DOUBLE), 6) AS pos_rate, source_split FROM t JOIN s USING (topic)")
def a40(spark, sf):
    """A topic table: majority label, purity, rate of positives, and where its rows come from."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("topic"), F.col("quality").alias("label"), "source")
    stats = T.topic_stats(d.withColumn("pos", F.col("label")), "topic", "label", "pos")
    return stats.join(T.source_split(d, "topic", "source"), "topic").select("topic", "majority", "count", "purity", "pos_rate", "source_split")


@query("f58_record_columns", f"WITH m AS ({_M}) SELECT doc_id, CASE WHEN lower(trim(coalesce(kw1, ''))) = 'nan' THEN '' ELSE trim(coalesce(kw1, '')) END AS author_keywords, '' AS research_areas FROM m")
def f58(spark, sf):
    m = D.spark_frame(spark, sf, D.MESSY).select("doc_id", F.col("t").alias("title"), F.lit("").alias("abstract"), F.col("kw1").alias("author_keywords"))
    filled = m.withColumns({c: F.lit("") for c in S.OPTIONAL if c not in m.columns})
    return S.normalised(filled).select("doc_id", "author_keywords", "research_areas")

