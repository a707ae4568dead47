"""Mechanisms with state, commits, files or rounds: q-gram index, session windows, streams, bundles, workbooks, resumable runs, topic model, discovery."""

import json
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import lexicon as L
from quillgrid.operators import qgrams, windows
from quillgrid.operators import topic_model as TM
from quillgrid.operators import topics as T
from quillgrid.sources import bundle, discovery, paths, workbooks
from quillgrid.sources import manifest as U
from quillgrid.sources import tables as S
from quillgrid.streaming import resumable, sessions

# --- q-gram index ---


def test_terms_found_are_those_contained(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "ab", "the old town", "x" * 5000] + ["".join(rng.choice("abc -é") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    terms = ["a", "é", "b c", " ", "the old", "old town", "xxxxx", "zzz"] + ["".join(rng.choice("abc -é") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    want = {i: sorted({t for t in terms if t in (x or "")}) for i, x in enumerate(texts)}
    index = qgrams.Index(terms)
    got = {r.id: sorted(r.f or []) for r in df.select("id", index.found(F.coalesce("x", F.lit(""))).alias("f")).collect()}
    assert got == want
    lexicon = spark.createDataFrame([(t,) for t in [*terms, "", None]], "term string")
    for most in (1 << 20, 0):  # sent to all tasks, or joined
        assert {r.id: r.terms for r in qgrams.join_terms(df, "id", "x", lexicon, most=most).collect()} == {i: t for i, t in want.items() if t}
    assert qgrams.join_terms(df, "id", "x", lexicon.limit(0)).count() == 0


def test_stages_agree_with_and_without_an_index(spark):
    texts = [("urban renewal of the old town", "policy for existing buildings; a model of mobility"), ("nan", "rural regeneration and tif"), ("", ""), (None, "brownfield redevelopment without renewal")]
    df = spark.createDataFrame(texts, "title string, abstract string")
    a, b = (L.first_stage(L.score_topics(L.fields(df, index=i), L.SAMPLE)).select("title", "abstract", "topics", "rule").collect() for i in (None, L.everything(L.SAMPLE)))
    assert a == b


# --- session windows ---


def walked(rows, most_rows, most_chars):
    out, state = [], {}
    for s, o, t in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        n, have, chars = state.get(s, (0, 0, 0))
        if have and (have >= most_rows or chars > most_chars):
            n, have, chars = n + 1, 0, 0
        state[s] = (n, have + 1, chars + len(t or ""))
        out.append((s, o, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rows", "characters", "block"), [(5, 60, 8), (50, 200, 64)])
def test_windows_by_doubling(spark, rows, characters, block):
    """One session has two thirds of the rows and is cut into many blocks."""
    rng = random.Random(2)
    data = [(None if rng.random() < 0.05 else "hot" if i % 3 else f"s{i % 20}", i, rng.choice([None, "", "xxx", "x" * 10, "x" * 50])) for i in range(1500)]
    df = spark.createDataFrame(data, "s string, o long, t string")
    got = windows.context_windows(df, "s", "o", "t", rows, characters, block=block)
    assert sorted(((r.s, r.o, r.context) for r in got.collect()), key=repr) == walked(data, rows, characters)
    assert sorted(((r.s, r.o, r.context) for r in windows.walk(df, "s", "o", "t", rows, characters).collect()), key=repr) == walked(data, rows, characters)
    assert windows.context_windows(df.limit(0), "s", "o", "t", rows, characters).count() == 0


def test_a_hot_session_has_many_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("s"), F.col("id").alias("o"), F.lit("abc").alias("t"))
    plan = windows.context_windows(df, "s", "o", "t", 4, 10**6, block=16)
    assert plan.groupBy("context").count().where("count <> 4").count() == 0
    jumps = df.select("s", F.col("o").alias("_i"), (F.col("o") * 3).alias("_p"), F.floor(F.col("o") / 16).alias("_block"), F.lit(False).alias("_guest"))
    assert jumps.groupBy("s", "_block").count().count() == 250  # groups, of which none has more than a block


def test_sessions_as_a_stream(spark, tmp_path):
    """Three micro-batches, each from the checkpoint of the one before, give what the batch walk gives."""
    data = [(f"s{i % 4}", i, "x" * (i % 7)) for i in range(60)]
    come, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "s string, o long, t string"
    for k in range(3):
        spark.createDataFrame(data[20 * k : 20 * k + 20], schema).write.mode("append").parquet(come)
        sessions.run(sessions.context_windows(spark.readStream.schema(schema).parquet(come), "s", "o", "t", 4, 9), out, state)
    got = sorted(((r.s, r.o, r.context) for r in spark.read.parquet(out).collect()), key=repr)
    assert got == walked(data, 4, 9)


def test_idle_sessions_expire(spark, tmp_path):
    come, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "s string, o long, t string"
    for rows in ([("a", 1, "x"), ("a", 2, "x")], [("b", 1, "x")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(come)
        stream = sessions.context_windows(spark.readStream.schema(schema).parquet(come), "s", "o", "t", 1, 9, idle=1)
        sessions.run(stream, out, state, timers=True)
    got = {(r.s, r.o, r.context, r.event) for r in spark.read.parquet(out).collect()}
    assert {("a", 1, 0, "row"), ("a", 2, 1, "row"), ("a", None, 1, "closed"), ("b", 1, 0, "row")} <= got


# --- several tables at once ---


def test_bundle_has_all_tables_or_none(spark, tmp_path):
    folder = f"file://{tmp_path}/bundle"
    one = spark.createDataFrame([(1, "x", [1.5]), (None, None, None)], "a long, b string, c array<double>")
    two = spark.range(100).repartition(5)
    bundle.write({"one": one, "two": two, "none": one.limit(0)}, folder)
    back = bundle.read(spark, folder)
    assert {n: df.schema.simpleString() for n, df in back.items()} == {"one": one.schema.simpleString(), "two": two.schema.simpleString(), "none": one.schema.simpleString()}
    assert sorted(map(tuple, back["one"].collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr) and back["two"].count() == 100 and back["none"].count() == 0

    bad = spark.range(8).repartition(4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        bundle.write({"one": one, "two": bad}, folder)
    assert bundle.versions(folder) == [0] and bundle.read(spark, folder)["two"].count() == 100
    bundle.write({"one": one.limit(1)}, folder)
    assert bundle.versions(folder) == [0, 1] and bundle.read(spark, folder)["one"].count() == 1 and bundle.read(spark, folder, 0)["two"].count() == 100


def test_a_task_that_wrote_and_failed_leaves_nothing_that_counts(spark, tmp_path):
    """Files of attempts that weren't committed lie there, and are in no version."""
    folder = f"file://{tmp_path}/bundle"
    spark.dataSource.register(bundle.BundleSource)
    schema = bundle.T._parse_datatype_string("_table string, t struct<a: bigint>")
    w = bundle.BundleWriter(folder, schema)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"_table": "t", "t": {"a": 1}}])
    w.write(iter([batch]))  # its report is lost with its executor
    again = w.write(iter([batch]))
    w.commit([again, None])
    assert bundle.read(spark, folder)["t"].count() == 1
    lost = w.write(iter([batch]))
    w.abort([lost])
    assert bundle.versions(folder) == [0] and len(os.listdir(tmp_path / "bundle" / "data" / "t")) == 2


# --- workbooks ---

CELLS = ["plain", " spaced  ", "a\nb\r\nc\td", "<&>\"'", "\x00\x0b\x1f", "_x0041_ literal", "日本語 😀", "x" * 40_000, "1.50", "=A1", None]


@pytest.mark.parametrize("header", [True, False])
def test_workbooks_round_trip(spark, tmp_path, header):
    df = spark.createDataFrame([(i, c, None) for i, c in enumerate(CELLS * 3)], "id long, text string, nothing string").repartition(3)
    folder = f"file://{tmp_path}/books"
    workbooks.write(df, folder, header=header, sheet_rows=4)
    back = workbooks.read(spark, folder, header=header, columns=None if header else ["id", "text", "nothing"])
    assert sorted(((int(r.id), r.text, r.nothing) for r in back.collect()), key=repr) == sorted(((r.id, r.text, None) for r in df.collect()), key=repr)
    assert back.rdd.getNumPartitions() >= 9 and not [n for n in os.listdir(tmp_path / "books") if n.startswith(".")]


def test_workbooks_as_other_programs_write_them(spark, tmp_path):
    """Shared strings with runs and phonetic marks, numbers, booleans, missing references, gaps, absolute targets, lock files."""
    import zipfile

    main, rel = workbooks._MAIN[1:-1], workbooks._REL[1:].split("}")[0]
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c t="b"><v>1</v></c><c r="C2"><v>3.5</v></c></row><row r="3"/><row r="4"><c r="C4" t="str"><v>f</v></c></row>'
    (tmp_path / "books").mkdir()
    with zipfile.ZipFile(tmp_path / "books" / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>first</t></si><si><r><t>sec</t></r><r><t>ond</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    (tmp_path / "books" / "~$b.xlsx").write_bytes(b"lock")
    got = workbooks.read(spark, f"file://{tmp_path}/books")
    assert got.columns == ["first", "second"]
    assert [tuple(r) for r in got.collect()] == [("TRUE", "3.5"), (None, None), (None, "f")]


# --- resumable runs ---


@pytest.mark.parametrize("kills", [[(0, "write")], [(0, "enter"), (2, "write")], [(1, "write"), (1, "enter"), (3, "enter")]])
def test_runs_resume_and_write_nothing_twice(spark, tmp_path, kills):
    source, folder = (f"file://{tmp_path}/{x}" for x in ("in", "out"))
    df = spark.range(50).select("id", F.lit("x").alias("t"))
    resumable.stage(df.coalesce(1), source, 10)
    left, seen = list(kills), []

    def stop(number, at):
        seen.append(number)
        if left and left[0] == (number, at):
            left.pop(0)
            return True
        return False

    for _ in range(len(kills)):
        with pytest.raises(Exception, match="Stopped"):
            resumable.run(spark, source, df.schema, lambda b: b.withColumn("y", F.col("id") * 2), folder, stop=stop)
    resumable.run(spark, source, df.schema, lambda b: b.withColumn("y", F.col("id") * 2), folder, stop=stop)
    assert not left
    assert sorted(tuple(r) for r in resumable.result(spark, folder).collect()) == [(i, "x", 2 * i) for i in range(50)]
    before = len(seen)
    resumable.run(spark, source, df.schema, lambda b: b, folder, stop=stop)
    assert len(seen) == before


def test_intervals():
    assert [resumable.interval(n) for n in (0, 999, 1000, 4999, 5000)] == [10, 10, 100, 100, 1000]
    assert resumable.interval(10, "7") == 7 and resumable.interval(10, "x") == 10 and resumable.interval(10, -3) == 1


# --- topic model ---


def test_topic_model_is_the_same_however_rows_are_dealt(spark):
    rng = np.random.default_rng(4)
    means = rng.normal(size=(4, 8))
    rows = [(i, (means[i % 4] + rng.normal(size=8) * 0.1).tolist(), "one two three four") for i in range(400)] + [(900, None, "one two three"), (901, [0.0] * 8, "one two three"), (902, means[1].tolist(), "short")]
    df = spark.createDataFrame(rows, "id long, v array<double>, t string")
    zero = spark.createDataFrame([("given", means[0].tolist())], "topic string, vector array<double>")
    cfg = TM.Config(topics=6, least_size=10, similarity=0.9)
    a, b = (sorted(map(tuple, TM.fit(df.repartition(n), "id", "v", "t", zero, cfg).collect())) for n in (1, 9))
    assert a == b and len(a) == len(rows)
    by = {r[0]: r for r in a}
    assert all(by[i][1:3] == ("given", "zero_shot") for i in range(0, 400, 4))
    assert len({by[i][1] for i in range(400)}) >= 4 and all(by[i][2] == "outlier" for i in (900, 901, 902))
    # brute force: the same rounds with whole numbers
    near = np.array([by[i][3] for i in range(400)])
    assert (near > 0.3).all()
    assert TM.fit(df.limit(0), "id", "v", "t", zero, cfg).count() == 0


# --- discovery ---


def test_binding_follows_the_single_rules(spark):
    truths = ["aa.xlsx", "run_one.xlsx", "sample_city_x.xlsx", "zz.final.xlsx"]
    preds = ["Run_One.xlsx", "one.xlsx", "x_run_one_2.xlsx", "city sample 2020.xlsx", "q.xlsx", "ZZ.final.csv", "run.xlsx"]
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.truth, r.how) for r in discovery.bind(frame(preds), frame(truths)).collect()}
    assert got == {p: S.bind_truth(p, truths) for p in preds}
    assert {r.how for r in discovery.bind(frame(preds), frame(truths[:1])).collect()} == {"single_truth"}


def test_listing_of_files_and_folders(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/in/table.parquet")
    (tmp_path / "in" / "one.json").write_text("{}")
    got = {r.name: r.parts for r in discovery.files(spark, f"{tmp_path}/in").collect()}
    assert got["one.json"] == 1 and got["table.parquet"] >= 3
    assert [r.name for r in discovery.files(spark, f"{tmp_path}/in", "*.json").collect()] == ["one.json"]


# --- plain functions that queries of literals stood for ---


def test_registry_of_strategies():
    r = U.Registry()
    r.register("single", lambda df: df, aliases=("one",))
    r.register("new", lambda df: df, lifecycle="candidate")
    r.register("off", lambda df: df, enabled=False)
    assert r.enabled("target") == ["single"] and r.enabled("target", True) == ["new", "single"] and r.get("ONE") is r.get("single")
    with pytest.raises(ValueError):
        r.register("other", lambda df: df, aliases=("one",))
    with pytest.raises(KeyError):
        r.get("nothing")


def test_manifests_compare_by_what_matters(spark, tmp_path):
    m = {"task_mode": "a", "prediction_file": "p.xlsx", "experiment": {"order_id": 3, "dataset": "d1"}}
    path = f"file://{tmp_path}/{uuid.uuid4().hex}.json"
    S.write_json(spark, path, m)
    assert S.read_json(spark, path) == json.loads(json.dumps(m)) and S.read_json(spark, path + "x") is None
    assert U.comparable(m, "t.xlsx") == {"task_mode": "a", "experiment.order_id": 3, "experiment.dataset": "d1", "truth_file": "t.xlsx"}
    other = {**m, "experiment": {"order_id": 9, "dataset": "d1"}}
    assert U.group_signature(U.comparable(m)) == U.group_signature(U.comparable(other)) != U.signature(U.comparable(m))


def test_seed_tokens():
    assert T.seed_tokens(L.SAMPLE)["N8"] == ["methods", "neural", "network", "algorithm", "accuracy"]


def test_paths(tmp_path):
    uri = f"file://{tmp_path}/a/b.txt"
    paths.put(uri, b"x")
    assert paths.get(uri) == b"x" and paths.names(f"file://{tmp_path}/a") == ["b.txt"] and paths.names(f"file://{tmp_path}/none") == []
    paths.remove(uri)
    paths.remove(uri)
    assert paths.names(f"file://{tmp_path}/a") == []


def test_postprocessing_corrects_open_labels(spark):
    """A firm cluster of open rows that speak of renewal gives them a label; settled rows and a small cluster stay as they are."""
    from quillgrid.operators import runs

    rows = [(i, "urban renewal of estate housing", "estate housing renewal residents upgrading", "unknown_pool", "", "Unknown", "unknown") for i in range(25)]
    rows += [(100, "zebra zebra zebra", "", "unknown_pool", "", "Unknown", "unknown"), (101, "urban renewal of estate housing", "", "", "0", "N3", "covered")]
    df = spark.createDataFrame(rows, "id long, title string, abstract string, source_pool string, final_label string, topic_final string, coverage string").withColumns({"guard_action": F.lit(""), "review_flag": F.lit("1"), "score": F.lit("0.4"), "threshold": F.lit("0.45"), "doc": F.concat_ws(" ", "title", "abstract")})
    assert runs.postprocess(df, "id", "doc", L.SAMPLE) is df
    got = {r.id: r for r in runs.postprocess(df, "id", "doc", L.SAMPLE, discover=True, refined=True).collect()}
    assert len(got) == len(rows) and all((got[i].final_label, got[i].topic_final, got[i].override_applied) == ("1", "U1", 1) for i in range(25))
    assert (got[100].final_label, got[100].override_applied, got[101].final_label, got[101].cluster) == ("", 0, "0", None)
