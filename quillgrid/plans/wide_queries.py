"""Queries of a lexicon that is a table: 25 topics over all words of the benchmark, of three letters or more.

A word's topic and kind follow from its md5, so both engines have the same lexicon.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import lexicon as L
from quillgrid.plans import model_queries as MQ
from quillgrid.plans.registry import query

TOPICS = 25
_LEX = f"""w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS term FROM benchmark),
lex AS (SELECT term, CAST(('0x' || substr(md5(term), 1, 6))::BIGINT % {TOPICS} AS INTEGER) AS topic, ['seed', 'context', 'anchor', 'exclude'][CAST(('0x' || substr(md5(term), 7, 4))::BIGINT % 4 AS INTEGER) + 1] AS kind FROM w)"""
_HITS = f"{MQ._X}, {_LEX}, h AS (SELECT doc_id, topic, kind, term, contains(t, term) AS in_title, contains(a, term) AS in_abstract FROM y, lex WHERE contains(b, term))"
_SCORES = f"""{_HITS}, has AS (SELECT DISTINCT topic FROM lex WHERE kind = 'anchor'),
c AS (SELECT doc_id, topic, count(*) FILTER (kind = 'seed' AND in_title) AS st, count(*) FILTER (kind = 'seed' AND in_abstract) AS sa, count(*) FILTER (kind = 'context' AND in_title) AS ct, count(*) FILTER (kind = 'context' AND in_abstract) AS ca, count(*) FILTER (kind = 'anchor') AS an, count(*) FILTER (kind = 'exclude') AS ex FROM h GROUP BY 1, 2),
s AS (SELECT doc_id, topic, round(CAST(3.0 * (1.35 * st + sa) + CASE WHEN ct + ca = 0 THEN 0 WHEN topic NOT IN (SELECT topic FROM has) THEN 1.35 * ct + ca WHEN an > 0 THEN 1.35 * ct + ca + 1.5 ELSE 0 END - 3.0 * ex AS DOUBLE), 4) AS score FROM c)"""


def lexicon(spark, sf):
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).distinct()
    number = lambda start, n: F.conv(F.substring(F.md5("term"), start, n), 16, 10).cast("long")
    kinds = F.array(*(F.lit(k) for k in L.KINDS))
    return words.select("term", (number(1, 6) % TOPICS).cast("int").alias("topic"), F.get(kinds, (number(7, 4) % 4).cast("int")).alias("kind"))


def _hits(spark, sf):
    return L.table_hits(L.fields(MQ.spread_docs(spark, sf)), "doc_id", lexicon(spark, sf))


@query("l04_wide_term_hits", f"WITH {_HITS} SELECT doc_id, term, in_title, in_abstract FROM h")
def l04(spark, sf):
    return _hits(spark, sf)


@query("l05_wide_topic_scores", f"WITH {_SCORES} SELECT doc_id, topic, score FROM s")
def l05(spark, sf):
    return L.table_scores(_hits(spark, sf), "doc_id", lexicon(spark, sf))


@query("l07_wide_best_topic", f"WITH {_SCORES}, k AS (SELECT doc_id, topic, score, list(score) OVER (PARTITION BY doc_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS r FROM s) SELECT doc_id, topic, score, round(score - greatest(coalesce(a[2], 0), 0), 4) AS margin FROM k WHERE r = 1 AND score > 0")
def l07(spark, sf):
    return L.table_best(L.table_scores(_hits(spark, sf), "doc_id", lexicon(spark, sf)), "doc_id")
