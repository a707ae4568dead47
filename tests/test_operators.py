"""Behaviour of operators on small frames of our own."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import cells, parse, text
from quillgrid.operators import align as J
from quillgrid.operators import crosstab, gate, metrics, refine, report, sampling, stats
from quillgrid.operators import classify as C
from quillgrid.operators import decide as H
from quillgrid.operators import lexicon as L
from quillgrid.operators import runs as R
from quillgrid.operators import topics as T
from quillgrid.sources import manifest as U
from quillgrid.sources import tables as S
from quillgrid.streaming import guardrails as G


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [("1", 1), (" 0 ", 0), ("1.0", 1), ("1.00", -1), (None, -1), ("", -1), ("yes", -1)])
def test_binary(spark, value, want):
    assert one(spark, value, cells.binary) == want


@pytest.mark.parametrize(("value", "want"), [("全国", 3), ("National park", 3), ("level 7", 7), ("nothing", -1), (None, -1), ("EU wide", 2), ("12", -1)])
def test_level(spark, value, want):
    assert one(spark, value, cells.level) == want


@pytest.mark.parametrize(("value", "want"), [("", ("0", "empty_text")), ("Step 1: x\n 1 ", ("1", "single_digit_line")), ("it is 0.", ("0", "fallback_first_digit")), ("Yes!", ("1", "fallback_boolean_yes")), ("maybe 10", ("0", "no_label_detected")), ("最终答案：1", ("1", "explicit_answer_pattern"))])
def test_answer(spark, value, want):
    assert tuple(one(spark, value, parse.answer)) == want


def test_tokens_of_short_texts(spark):
    assert one(spark, "", text.tokens) == [] and one(spark, "One", text.tokens) == ["one"] and one(spark, "a b", text.tokens) == ["a", "b", "a_b"]


def test_strict_alignment_rejects_repeats(spark):
    t = spark.createDataFrame([(1, "A"), (2, " a ")], "_row_id long, title string")
    with pytest.raises(ValueError, match="repeated"):
        J.align(t, t, strict=True)
    with pytest.raises(ValueError, match="missing"):
        J.align(t.drop("title"), t)


def test_alignment_of_nothing(spark):
    e = spark.createDataFrame([], "_row_id long, title string")
    s = J.align(e, e).summary.first()
    assert s["match_count"] == 0 and s["truth_coverage"] == 0.0


def test_positions_need_equal_lengths(spark):
    a = spark.range(3).withColumnRenamed("id", "_row_id")
    with pytest.raises(ValueError, match="unequal"):
        J.by_position(a, a.limit(2))


def test_counts_add_up(spark):
    df = spark.createDataFrame([("1", "1"), ("0", "1"), ("x", "1"), (None, "0"), ("1.0", "0")], "t string, p string")
    r = metrics.binary(df, "t", "p").first()
    assert (r.tp, r.tn, r.fp, r.fn, r.total) == (1, 0, 1, 1, 5) and r.accuracy == 20.0


def test_metrics_of_nothing(spark):
    r = metrics.binary(spark.createDataFrame([], "t string, p string"), "t", "p").first()
    assert r.total == 0 and r.accuracy == 0.0 and r.f1 == 0.0


def test_chunks_hold_their_size(spark):
    df = spark.range(250).select(F.col("id").alias("_row_id"), F.lit("1").alias("t"), F.lit("1").alias("p")).repartition(7)
    assert [r.total for r in metrics.chunked(df, "t", "p", 100).orderBy("chunk").collect()] == [100, 100, 50]
    with pytest.raises(ValueError):
        metrics.with_chunk(df, 0)


def test_bounds_of_accuracy(spark):
    with pytest.raises(ValueError):
        metrics.check_accuracy(spark.createDataFrame([(101.0,)], "accuracy double"), "here")


def test_totals_and_shares(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "i string, c string")
    wide = crosstab.pivot(df, "i", "c", ["x", "y"])
    total = {r["i"]: r["Total"] for r in crosstab.with_totals(wide).collect()}
    assert total == {"a": 2, "b": 1, "Total": 3}
    shares = {r["i"]: (r["x"], r["Total"]) for r in crosstab.shares(wide).collect()}
    assert shares["a"] == (0.5, 1.0) and shares["Total"][1] == 1.0


@pytest.mark.parametrize(("counts", "n"), [({"a": 10, "b": 1, "c": 0}, 5), ({"a": 3, "b": 3}, 100), ({"a": 1, "b": 1, "c": 98}, 3), ({"x": 7, "y": 5, "z": 5}, 11)])
def test_allocation(counts, n):
    got = sampling.allocate(counts, n)
    assert sum(got.values()) == min(n, sum(counts.values()))
    assert all(got[k] <= counts[k] for k in counts)
    if n >= sum(c > 0 for c in counts.values()):
        assert all(got[k] >= 1 for k in counts if counts[k])


def test_sample_is_the_same_however_dealt(spark):
    df = spark.range(500).select(F.col("id").alias("_row_id"), (F.col("id") % 3).cast("string").alias("s"))
    a, b = (sorted(r[0] for r in sampling.stratified(x, "s", 30, 7).select("_row_id").collect()) for x in (df, df.repartition(9)))
    assert a == b and len(a) == 30


def test_bootstrap_interval_holds_the_estimate(spark):
    df = spark.createDataFrame([("1", "1")] * 40 + [("0", "1")] * 10 + [("0", "0")] * 50, "t string, p string")
    for r in stats.bootstrap(df, "t", "p").collect():
        assert r.ci_lower <= r.point_estimate <= r.ci_upper


def test_mcnemar_p():
    assert stats.mcnemar_p(0) == 1.0 and abs(stats.mcnemar_p(3.841459) - 0.05) < 1e-4


def stage(spark, title, abstract="", taxonomy=L.SAMPLE):
    df = spark.createDataFrame([(title, abstract)], "title string, abstract string")
    return C.second_stage(L.first_stage(L.score_topics(L.fields(df), taxonomy)))


RECORDS = {
    "math": ("Urban renewal of dimer tiling", ""),
    "rural": ("Rural regeneration", ""),
    "core": ("Estate renewal and old housing", "Urban regeneration policy for residents of the old town"),
    "neutral": ("Nothing here", ""),
    "null": (None, None),
}


@pytest.fixture(scope="module")
def decided(spark):
    """All records in one run of the chain, by name."""
    df = spark.createDataFrame([(k, *v) for k, v in RECORDS.items()], "name string, title string, abstract string")
    df = C.second_stage(L.first_stage(L.score_topics(L.fields(df), L.SAMPLE)))
    return {r.name: r for r in H.final_columns(H.decide(df), ("name",)).collect()}


def test_hard_negatives_end_the_chain(decided):
    r = decided["math"]
    assert (r.metadata_route, r.topic_final, r.final_label, r.evidence_balance) == ("hard_negative", "N8", "0", "hard_negative")
    assert (decided["rural"].topic_final, decided["rural"].metadata_route_reason) == ("N9", "rural_nonurban")


def test_core_anchor_in_scope(decided):
    r = decided["core"]
    assert r.final_label == "1" and r.probability_score >= 0.58


def test_neutral_text_is_unknown_and_reviewed(decided):
    r = decided["neutral"]
    assert r.topic_final == "Unknown" and r.unknown_recovery_path == "retained_unknown" and r.review_flag_raw == 1


def test_null_records(decided):
    assert decided["null"].topic_final == "Unknown"


def test_penalties_and_combos(spark):
    x = stage(spark, "urban regeneration policy").select(F.explode("topics").alias("t")).where("t.label = 'U9'").first()["t"]
    assert x.score == 1.0 * 1.35 + 1.5 + 4.0 and x.combos == ["urban regeneration+policy"]


def test_gate_fit_separates(spark):
    rows = [(f"estate renewal of old housing {i}", 1) for i in range(6)] + [(f"an algorithm {i}", 0) for i in range(6)]
    df = spark.createDataFrame(rows, "title string, y int").withColumn("abstract", F.lit(""))
    f = gate.features(gate.with_defaults(C.second_stage(L.first_stage(L.score_topics(L.fields(df), L.SAMPLE))).withColumn("y", F.col("y"))))
    p = gate.predict(f, gate.fit(f, "y")).select("y", "gate_probability").collect()
    assert min(r[1] for r in p if r[0]) > max(r[1] for r in p if not r[0])


def test_refiner_never_takes_a_positive_away(spark):
    names = "final_label topic_final coverage candidate_label cluster_confidence cluster_size cluster fixed_candidate mapping_status guard_action review_flag score threshold title abstract".split()
    row = lambda label, cand: (label, "Unknown", "unknown", cand, "0.9", "30", "c", "", "", "", "0", "0.4", None, "urban renewal", "")
    df = spark.createDataFrame([row("1", "0"), row("0", "1")], ", ".join(f"{n} string" for n in names))
    assert [r.final_label for r in refine.refine(df).collect()] == ["1", "1"]
    assert refine.Config.from_context({"unknown_only": "no", "least_size": "7", "near_margin": "bad"}) == refine.Config(unknown_only=False, least_size=7)


def test_enrichment_keeps_rows(spark):
    df = spark.createDataFrame([(1, "urban renewal renewal", "unknown_pool"), (2, "", "review_pool"), (3, "x", "")], "k long, doc string, source_pool string")
    out = {r.k: r for r in T.enrich(df, "k", "doc", L.SAMPLE).collect()}
    assert len(out) == 3 and out[3].cluster is None and out[1].cluster == "DUR_0001"
    assert T.cluster_count(0) == 0 and T.cluster_count(45) == 3


def test_truth_binding():
    assert S.bind_truth("pred_set1.xlsx", ["a.xlsx", "set1.xlsx"]) == ("set1.xlsx", "contains_match")
    assert S.bind_truth("x_alpha.xlsx", ["beta.xlsx", "alpha_y_z.xlsx"])[1] == "token_overlap_match"
    with pytest.raises(ValueError):
        S.bind_truth("p", ["a", "b"], "stable_release")
    with pytest.raises(ValueError):
        S.training_files(["train_a.xlsx", "train_eval.xlsx"], ["train"], ["eval"])


def test_headerless_records(spark):
    df = S.records(spark.createDataFrame([("t", "a", None, None)], "x string, y string, z string, w string"), has_header=False)
    assert df.columns == list(S.RECORD) and df.first()["title"] == "t"


def test_tables_round_trip(spark, tmp_path):
    S.write_tables({"One table": spark.range(3)}, str(tmp_path))
    assert S.read_tables(spark, str(tmp_path), ["One table"])["One table"].count() == 3
    S.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert S.read_json(spark, str(tmp_path / "m.json")) == {"a": 1} and S.read_json(spark, str(tmp_path / "no.json")) is None


def test_signatures():
    a, b = {"runtime": {"order_id": 1, "model": "m"}}, {"runtime": {"order_id": 2, "model": "m"}}
    x, y = U.comparable(a), U.comparable(b)
    assert U.signature(x) != U.signature(y) and U.group_signature(x) == U.group_signature(y) and U.differing(x, y) == ["runtime.order_id"]


def test_registry():
    r = U.Registry()
    r.register("single", lambda df: df, aliases=["one"])
    assert r.get("ONE") is r.get("single") and r.enabled("target") == ["single"]
    with pytest.raises(KeyError):
        r.get("none")


def test_context_windows(spark):
    df = spark.createDataFrame([(1, i, "x" * 10) for i in range(5)], "s long, o long, t string")
    assert [r.context for r in U.context_windows(df, "s", "o", "t", U.Limits(10**6, 2)).orderBy("o").collect()] == [0, 0, 1, 1, 2]


def test_release_gates():
    assert report.gate_failures({}, 999) and not report.gate_failures({k: 1000.0 for k, _ in report.LEAST} | {k: 0 for k, _ in report.MOST}, 1000)


def test_stream_equals_batch(spark, tmp_path):
    src = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2 == 0).alias("p"))
    src.write.parquet(str(tmp_path / "in"))
    args = {"positive": F.col("p"), "empty": F.lit(False), "fallback": F.lit(False)}
    q = G.windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), **args).writeStream.format("memory").queryName("st").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("st").collect())) == sorted(map(tuple, G.windowed(spark.read.parquet(str(tmp_path / "in")), **args).collect()))


def test_whole_documents_are_classified(spark, tmp_path):
    from quillgrid.plans import registry

    filler = "zzz " * 300
    texts = [filler, f"zzz\n{filler} the tion that renewal", f"{filler}\n the tion that renewal", f"{filler}renewal ment"]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    q = registry.queries()
    frame = {r.doc_id: r for r in q["l11_first_stage"](spark, str(tmp_path)).collect()}
    assert frame[0].score == 0 and all(frame[i].score > 0 for i in (1, 2, 3))
    local = {r.doc_id: r.top3 for r in q["l15_second_stage"](spark, str(tmp_path)).collect()}
    assert all(local[i] != local[0] for i in (1, 2, 3))
    mapped = {r.doc_id: r.score for r in q["m10_map_to_fixed"](spark, str(tmp_path)).collect()}
    assert mapped[0] == 0 and mapped[3] > 0
    names = {r.doc_id: r.cluster_keywords for r in q["m16_enrich_clusters"](spark, str(tmp_path)).collect()}
    assert any("renewal" in str(v) for v in names.values())


def test_a_wide_lexicon_is_planned_once(spark):
    """25 topics of 40 terms: each text is normalised once, and scores are those of the terms that occur."""
    topics = tuple(L.Topic(f"{'U' if i < 15 else 'N'}{i % 15 + 1}", "", "", tuple(f"seed {i} {k}" for k in range(20)), tuple(f"word{i}x{k}" for k in range(20)), excludes=(f"never {i}",)) for i in range(25))
    df = spark.createDataFrame([("Seed 3 7", "word3x1 and seed 3 7, word4x2; never 4"), (None, "nothing")], "title string, abstract string")
    out = L.score_topics(L.fields(df), L.Taxonomy(topics))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 12
    first, second = out.collect()
    best = {t["label"]: t["score"] for t in first["topics"]}
    assert best["U4"] == 3.0 * 2.35 + 1.0 and best["U5"] == 1.0 - 3.0 and all(t["score"] == 0 for t in second["topics"])


def test_places_of_many_equal_keys(spark):
    rows = [("same" if i % 3 else f"k{i:03d}", i) for i in range(300)] + [(None, 300)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(5)
    got = [(r.k, r.n) for r in metrics.numbered(df, ["k", "n"]).orderBy("_position").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [r._position for r in metrics.numbered(df, ["k", "n"]).orderBy("_position").collect()] == list(range(1, 302)) and metrics.numbered(df.limit(0), ["k", "n"]).count() == 0


def test_runs(spark, tmp_path):
    df = spark.createDataFrame([(0, "Renewal in Old Harbour", "", '{"Is_Spatial_Research": true, "Specific_Study_Area": "Old Harbour", "Spatial_Scale_Level": "8"}'), (1, "", None, "1"), (2, "x", "y", "")], "_row_id long, title string, abstract string, answer string")
    where = R.spatial(df).collect()
    assert [r["_row_id"] for r in where] == [0, 2] and where[0]["is_spatial"] == "1" and where[1]["spatial_level"] == "Not mentioned"
    with pytest.raises(ValueError):
        R.run(df, "nothing", R.spatial, R.spatial)
    R.save_bundle(df, f"file://{tmp_path}/m", {"a": "b"})
    model, settings = R.load_bundle(spark, f"file://{tmp_path}/m")
    assert settings == {"a": "b"} and R.fingerprint(model).collect() == R.fingerprint(df.repartition(4)).collect()
