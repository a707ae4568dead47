"""What queries shuffle, write and hold is bounded by their input: rows counted by Spark itself, not times."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


def stages(spark):
    it = spark.sparkContext._jsc.sc().statusStore().store().view(spark._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")).iterator()
    out = {}
    while it.hasNext():
        i = it.next().info()
        out[i.stageId()] = i.shuffleWriteRecords()
    return out


def shuffled(spark, action):
    """(what an action returns, the rows that it shuffled)."""
    before = set(stages(spark))
    out = action()
    return out, sum(n for k, n in stages(spark).items() if k not in before)


def prose(rows, words, seed=1, vocabulary=400):
    rnd = random.Random(seed)
    names = ["w" + "".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(names) for _ in range(words)) for _ in range(rows)]


def test_class_terms_shuffle_combined_counts(spark):
    from quillgrid.operators import topic_model as TM

    text = prose(1, 60)[0]
    df = spark.createDataFrame([(k, "ab"[k % 2], text + " own" + chr(97 + k % 26)) for k in range(400)], "doc_id int, topic string, text string").repartition(4)
    got, rows = shuffled(spark, lambda: TM.class_terms(df, "topic", "text", TM.Config(max_df=1.0)).collect())
    assert {r["topic"] for r in got} == {"a", "b"} and len(got) == 20
    # every document has 180 terms, so that counts by document are more than 70,000 rows
    assert rows < 10_000


def documents(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, most", [("m08_keyword_terms", 0), ("m07_keyword_clusters", 0), ("m10_map_to_fixed", 0), ("m09_cluster_ids", 3000), ("m20_seed_overlap", 1500)])
def test_terms_of_a_row_are_not_shuffled(spark, tmp_path, name, most):
    from quillgrid.plans import registry

    sf = documents(spark, tmp_path, [t + " que los that" for t in prose(300, 150)])
    got, rows = shuffled(spark, lambda: registry.queries()[name](spark, sf).collect())
    assert got
    # the terms of 300 documents are some 80,000 rows
    assert rows <= most


def test_terms_of_a_bucket_are_added_up_before_they_are_dealt(spark):
    from quillgrid.operators import topics as T
    from quillgrid.plans import model_queries as MQ

    text = prose(1, 100)[0] + " same same same same"
    df = spark.createDataFrame([(i, text, "unknown_pool") for i in range(400)], "doc_id long, text string, source_pool string").repartition(4)
    got, rows = shuffled(spark, lambda: T.enrich(df, "doc_id", "text", MQ.WORDS).collect())
    assert {(r["cluster"], r["cluster_size"]) for r in got} == {("DUR_0001", 400)}
    assert rows < 6_000


def test_terms_as_the_array_form_has_them(spark):
    from pyspark.sql import functions as F

    from quillgrid.operators import topics as T

    texts = [None, "", "the and", "a_b a_b ab_", "Abc-d the abc_d  abc+d\nxyz xyz q1 abc_abc abc abc", "nan", "word the word word é word"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    old = df.select("k", F.explode(T.terms("t")).alias("x")).groupBy("k", "x.term").agg(F.sum("x.n").alias("weight")).collect()
    new = T.top_terms(df, "k", "t", 1000, unique=True).collect()
    assert {(r["k"], r["term"], r["weight"]) for r in old} == {(r["k"], r["term"], r["weight"]) for r in new} and len(new) == len(old)


def test_terms_of_a_lexicon_table_are_found_within_rows(spark):
    from quillgrid.operators import lexicon as L

    texts = [("Old Harbour", "the harbour-wall is old"), ("", "ab cab"), (None, None), ("ends in ha", "rbour and x")] + [(t[:40], t[40:]) for t in prose(200, 120)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "k int, title string, abstract string").repartition(4)
    words = ["harbour", "old", "ab", "a", "wall is", "ha rbour", "arbour", "zzz", ""] + [w[1:4] for w in " ".join(prose(1, 150, 2)).split()]
    lexicon = spark.createDataFrame([(w,) for w in words], "term string")
    d = L.fields(df)
    want = {(r["k"], w, w in r["_t"], w in r["_a"]) for r in d.collect() for w in words if w and w in r["_both"]}
    assert (3, "ha rbour", False, False) in want
    for most in (1 << 17, 1):
        got = [tuple(r) for r in L.table_hits(d, "k", lexicon, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    single = lexicon.where("not contains(term, ' ')")
    _, rows = shuffled(spark, lambda: L.table_hits(d, "k", single).collect())
    # the lexicon alone is shuffled; the texts' q-grams are more than 10,000 rows
    assert rows < 1_000


def test_bound_truths_need_no_large_broadcast_and_one_row_for_a_set_of_words(spark):
    from quillgrid.sources import discovery as Y
    from quillgrid.sources import tables as S

    truths = [f"{a}_{b}.xlsx" for a in ("red", "blue", "old") for b in ("ring", "gear")] + ["red_gear_10x.xlsx"]
    names = [f"red-gear-{k}.xlsx" for k in range(300)] + [f"x{k}.xlsx" for k in range(50)] + ["a_red_ring.xlsx", "red.xlsx", "blue_gear.xlsx"]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = [{r["name"]: (r["truth"], r["how"]) for r in Y.bind(frame(names), frame(truths), most=most).collect()} for most in (Y.qgrams.SENT, 0)]
    assert got[0] == got[1] == {n: S.bind_truth(n, sorted(truths)) for n in names}
    assert Y.qgrams.SENT <= 1 << 16
    _, rows = shuffled(spark, lambda: Y.bind(frame(names), frame(truths)).collect())
    # pairs of a name and a truth with a word in common are more than 1,500 rows a step
    assert rows < 20_000


def test_kmeans_counts_terms_once_and_keeps_those_of_the_vocabulary(spark):
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql import functions as F

    from quillgrid.operators import topics as T

    texts = [t + (" red ring old" if i % 2 else " blue gear new") for i, t in enumerate(prose(60, 40, vocabulary=30))] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    got = T.corpus_terms(df, "t", 10_000, 0.95 * len(texts))
    fitted = CountVectorizer(inputCol="x", maxDF=0.95).fit(df.select(F.transform(T.terms("t"), lambda x: x["term"]).alias("x")))
    assert set(got) == set(fitted.vocabulary)
    buckets = {r["k"]: r["bucket"] for r in T.by_kmeans(df, "k", "t", T.Config(min_size=31)).collect()}
    assert set(buckets) == set(range(62)) and len(set(buckets.values())) == 2
    assert T.by_kmeans(df.where("k >= 60"), "k", "t", T.Config(min_size=1)).count() == 2


def test_pairs_of_one_title_are_dealt_in_runs(spark):
    """A hot title's pairs are made by many tasks, a right row's pairs side by side; all pairs are there, and unmatched rows once."""
    import collections

    from pyspark.sql import functions as F

    from quillgrid.operators import align as J

    left = [(k, " Hot " if k % 2 else "HOT", k % 3) for k in range(300)] + [(300, None, 1), (301, "alone", 2), (301, "alone", 2), (302, "two", 0), (302, "two", 0)]
    right = [(k, "hot") for k in range(200)] + [(200, ""), (201, "Two"), (201, "Two"), (202, "nobody's")]
    a = spark.createDataFrame(left, "doc_id int, title string, n int").coalesce(1)
    b = spark.createDataFrame(right, "doc_id int, title string").coalesce(1)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        for most in (1 << 17, 50):
            found = J.by_title(a, b, most=most)
            assert found.columns == ["doc_id", "title", "n", "doc_id_right"]
            got = found.withColumn("task", F.spark_partition_id()).collect()
            clean = lambda t: (t or "").strip().lower()
            ids = collections.defaultdict(list)
            for i, t in right:
                ids[clean(t)].append(i)
            assert collections.Counter(tuple(r)[:4] for r in got) == collections.Counter((*row, i) for row in left for i in ids.get(clean(row[1]), [None]))
            hot = [(r.task, r.doc_id_right) for r in got if clean(r.title) == "hot"]
            assert len({t for t, _ in hot}) > 1
            assert sum(x != y for x, y in zip(hot, hot[1:])) <= 200 * (len(left) // most + 1)
    finally:
        spark.conf.set(setting, before)


def test_a_file_of_few_row_groups_is_dealt_to_all_cores(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quillgrid.sources import tables as S

    cores = spark.sparkContext.defaultParallelism
    rows = 4000
    table = pa.table({"doc_id": list(range(rows)), "text": [f"{k} " * 50 for k in range(rows)]})
    most = lambda df: max(df.rdd.glom().map(len).collect())
    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for name, size in (("one", rows), ("many", rows // 40)):
            pq.write_table(table, tmp_path / name, row_group_size=size, compression="none")
            df = spark.read.parquet(str(tmp_path / name))
            assert df.rdd.getNumPartitions() >= cores
            found = S.spread(df)
            assert most(found) <= 2 * rows // cores and found.count() == rows and found.distinct().count() == rows
            assert (found is df) == (name == "many")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
