"""Frames that queries start from: one SQL text for both engines, over the driver's tables.

The frames have the awkward cells that operators must cope with - blanks, nulls,
"nan", "1.0", stray spaces, mixed case - as functions of the row's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations", "benchmark", "pages")

#: Truth (labels) beside predictions (a rule over documents), with the columns of a decision's audit.
EVAL = """SELECT d.doc_id AS _row_id, d.doc_id AS doc_id,
  CASE WHEN d.doc_id % 29 = 0 THEN NULL WHEN d.doc_id % 7 = 0 THEN concat(CAST(l.quality AS STRING), '.0') WHEN d.doc_id % 11 = 0 THEN concat(' ', CAST(l.quality AS STRING), ' ') WHEN d.doc_id % 31 = 0 THEN '1.00' ELSE CAST(l.quality AS STRING) END AS truth,
  CASE WHEN d.doc_id % 37 = 0 THEN 'nan' WHEN d.n_chars >= 600 THEN '1' ELSE '0' END AS pred,
  CASE WHEN d.n_chars >= 1500 THEN '1' WHEN d.doc_id % 19 = 0 THEN '' ELSE '0' END AS pred_b,
  CASE WHEN d.doc_id % 5 = 0 THEN '1.0' WHEN d.n_chars >= 300 THEN '1' ELSE '0' END AS pred_c,
  CASE WHEN d.doc_id % 13 = 0 THEN '' WHEN d.doc_id % 17 = 0 THEN NULL ELSE d.source END AS decision_source,
  CASE d.doc_id % 9 WHEN 0 THEN 'u1' WHEN 1 THEN 'U2' WHEN 2 THEN 'n3' WHEN 3 THEN 'N8' WHEN 4 THEN 'unknown' WHEN 5 THEN '' WHEN 6 THEN 'U10' WHEN 7 THEN NULL ELSE 'U1' END AS theme_truth,
  CASE (d.doc_id + d.n_chars) % 8 WHEN 0 THEN 'U1' WHEN 1 THEN 'u2' WHEN 2 THEN 'N3' WHEN 3 THEN 'N8' WHEN 4 THEN 'Unknown' WHEN 5 THEN '' WHEN 6 THEN 'U10' ELSE 'nan' END AS topic_final,
  CASE d.doc_id % 6 WHEN 0 THEN 'social_impact_boundary' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'double_unknown' END AS boundary_bucket,
  CASE d.doc_id % 5 WHEN 0 THEN 'U1_vs_N3' WHEN 1 THEN '' ELSE 'Unknown_vs_U2' END AS conflict_pattern,
  CASE d.doc_id % 10 WHEN 0 THEN 'binary_near_threshold' WHEN 1 THEN 'rule_Conflict;x' WHEN 2 THEN NULL WHEN 3 THEN 'topic_inconsistency' ELSE '' END AS review_reason,
  CASE d.doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'x' ELSE NULL END AS review_flag,
  CASE d.doc_id % 12 WHEN 0 THEN '1' ELSE '0' END AS consistency,
  CASE d.doc_id % 3 WHEN 0 THEN 'strong_positive' WHEN 1 THEN ' ' ELSE 'None' END AS evidence_balance,
  CASE d.doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'null' ELSE concat('why ', CAST(d.doc_id % 3 AS STRING)) END AS decision_explanation,
  CASE WHEN d.doc_id % 5 = 0 THEN '-1' WHEN d.doc_id % 8 = 0 THEN NULL ELSE concat('DUR_000', CAST(d.doc_id % 6 AS STRING)) END AS cluster,
  CASE d.doc_id % 4 WHEN 0 THEN 'unknown_pool' WHEN 1 THEN '' ELSE 'review_pool' END AS source_pool,
  CASE d.doc_id % 5 WHEN 0 THEN 'mapped_to_fixed' WHEN 1 THEN 'candidate_new_urban_topic' WHEN 2 THEN 'candidate_new_nonurban_topic' WHEN 3 THEN 'needs_review' ELSE '' END AS mapping_status,
  CASE WHEN d.doc_id % 6 = 0 THEN 'bad' ELSE CAST((d.doc_id % 100) / 100.0 AS STRING) END AS cluster_confidence,
  CASE d.doc_id % 4 WHEN 0 THEN 'promote' WHEN 1 THEN 'demote' WHEN 2 THEN '' ELSE 'none' END AS candidate_action,
  CASE d.doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END AS candidate_label,
  CASE d.doc_id % 2 WHEN 0 THEN 'high' ELSE 'low' END AS review_priority,
  CASE d.doc_id % 9 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'fallback_first_digit' WHEN 2 THEN NULL ELSE 'explicit_answer_pattern' END AS parse_reason,
  CASE d.doc_id % 8 WHEN 0 THEN '3. National' WHEN 1 THEN '全国' WHEN 2 THEN 'City-wide 7' WHEN 3 THEN 'level 4 of 9' WHEN 4 THEN NULL WHEN 5 THEN 'Street grid' WHEN 6 THEN 'other' ELSE 'Global' END AS level_truth,
  CASE d.doc_id % 7 WHEN 0 THEN 'national' WHEN 1 THEN '国家' WHEN 2 THEN 'single city' WHEN 3 THEN '4' WHEN 4 THEN 'OTHER' WHEN 5 THEN 'block' ELSE '1' END AS level_pred,
  CASE d.doc_id % 4 WHEN 0 THEN 'Not mentioned' WHEN 1 THEN 'Old town, North-East' WHEN 2 THEN 'the river bank' ELSE '' END AS area_truth,
  CASE d.doc_id % 5 WHEN 0 THEN 'not mentioned' WHEN 1 THEN 'old town north east' WHEN 2 THEN 'river bank' WHEN 3 THEN '' ELSE 'elsewhere' END AS area_pred,
  d.lang AS lang, d.n_chars AS n_chars, d.source AS source, l.toxic AS toxic, l.quality AS quality
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

#: Documents with titles that repeat but for case and spaces.
TITLED = """SELECT doc_id AS _row_id, doc_id, CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN concat('  Title   ', CAST(doc_id % 300 AS STRING), ' ') WHEN doc_id % 3 = 1 THEN concat('TITLE ', CAST(doc_id % 300 AS STRING)) ELSE concat('title ', CAST(doc_id % 300 AS STRING)) END AS title,
  CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE 'a ' END AS abstract, CAST(n_chars % 2 AS STRING) AS label, lang, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN ' ' ELSE CAST(1990 + doc_id % 30 AS STRING) END AS publication_year, n_chars FROM {documents}"""

#: Customers under titles of the same kind, of which some are no document's.
CROSSED = """SELECT c_custkey AS _row_id, c_custkey AS doc_id, CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN concat('TITLE   ', CAST(c_custkey % 450 + 37 AS STRING), ' ') ELSE concat('title ', CAST(c_custkey % 450 + 37 AS STRING)) END AS title,
  CASE WHEN c_custkey % 5 = 0 THEN 'A' ELSE 'a ' END AS abstract, CAST(c_nationkey % 2 AS STRING) AS label, c_mktsegment AS lang, CAST(1990 + c_custkey % 30 AS STRING) AS publication_year, CAST(c_nationkey AS BIGINT) AS n_chars FROM {customer}"""

#: Orders as a review sheet: year, topic, level, detail.
REVIEW = """SELECT o.o_orderkey AS _row_id, CASE WHEN o.o_orderkey % 23 = 0 THEN 'n/a' ELSE CAST(year(o.o_orderdate) AS STRING) END AS publication_year, CASE WHEN o.o_orderkey % 47 = 0 THEN ' ' ELSE o.o_orderpriority END AS topic,
  CASE o.o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'Non-spatial' WHEN 2 THEN '1.0' ELSE 'TRUE' END AS spatial_flag, CASE WHEN o.o_orderkey % 9 = 0 THEN '' WHEN r.r_regionkey = 0 THEN '9. Micro / Neighborhood / Block' ELSE r.r_name END AS level,
  CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE n.n_name END AS detail
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

#: Whole texts and cells of the awkward kinds, one for each document.
MESSY = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('  ', text, '  ') WHEN 1 THEN 'NaN' WHEN 2 THEN NULL WHEN 3 THEN replace(text, ' ', '   ') WHEN 4 THEN '' WHEN 5 THEN replace(replace(text, 'e', 'E'), 't', 'T') WHEN 6 THEN replace(text, 'e', '-') ELSE text END AS t,
  CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'alpha; Beta ;alpha;; gamma  ray' WHEN 2 THEN ' ' WHEN 3 THEN concat(lang, '; ', source, ';', lang) ELSE 'Beta; delta' END AS kw1, CASE doc_id % 4 WHEN 0 THEN 'delta ;BETA' WHEN 1 THEN 'nan' WHEN 2 THEN NULL ELSE concat(source, ' ; Omega') END AS kw2,
  CASE doc_id % 11 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN ' 0 ' WHEN 3 THEN '0.0' WHEN 4 THEN 'true' WHEN 5 THEN 'Spatial' WHEN 6 THEN 'x' WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN '1.7' ELSE '-1' END AS flag,
  CASE doc_id % 8 WHEN 0 THEN 'u3' WHEN 1 THEN 'N10' WHEN 2 THEN ' UNKNOWN ' WHEN 3 THEN 'none' WHEN 4 THEN 'Urban_Renewal_Other' WHEN 5 THEN 'U99' WHEN 6 THEN NULL ELSE 'n2' END AS label,
  CASE doc_id % 10 WHEN 0 THEN 'Answer: 1' WHEN 1 THEN concat('Step 1: read', chr(10), ' 0 ', chr(10), 'done') WHEN 2 THEN 'final label 1.' WHEN 3 THEN 'Yes, it is' WHEN 4 THEN '' WHEN 5 THEN 'is_urban_renewal = "1"' WHEN 6 THEN 'Step 10 says no' WHEN 7 THEN '结论：0' WHEN 8 THEN concat(' ', chr(10), '1', chr(9), '0', chr(9), '7. City', chr(9), 'Old town') ELSE concat('x', chr(9), 'y') END AS answer,
  lang, source, n_chars FROM {documents}"""


def spark_frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


# --- DuckDB spellings of the cell functions ---


def text(c: str) -> str:
    return f"trim(coalesce(CAST({c} AS VARCHAR), ''))"


def present(c: str) -> str:
    return f"(lower({text(c)}) NOT IN ('', 'nan', 'none', 'null'))"


def clustered(c: str) -> str:
    return f"(lower({text(c)}) NOT IN ('', 'nan', 'none', 'null', '-1', '-1.0'))"


def binary(c: str) -> str:
    return f"(CASE replace({text(c)}, '.0', '') WHEN '1' THEN 1 WHEN '0' THEN 0 ELSE -1 END)"


def decided(c: str) -> str:
    return f"(CASE trunc(try_cast({text(c)} AS DOUBLE)) WHEN 1 THEN 1 WHEN 0 THEN 0 END)"


def flag(c: str) -> str:
    return f"CAST(trunc(coalesce(try_cast({text(c)} AS DOUBLE), 0)) AS INTEGER)"


def topic(c: str) -> str:
    t = text(c)
    return f"(CASE WHEN lower({t}) IN ('', 'nan', 'none', 'null') THEN '' WHEN lower({t}) = 'unknown' THEN 'Unknown' WHEN regexp_full_match({t}, '[UuNn][0-9]+') THEN upper({t}) ELSE {t} END)"


def family(c: str) -> str:
    t = topic(c)
    ins = ", ".join(f"'U{i}'" for i in range(1, 16))
    outs = ", ".join(f"'N{i}'" for i in range(1, 11))
    return f"(CASE WHEN {t} = '' THEN '' WHEN {t} IN ({ins}, 'Urban_Renewal_Other') THEN 'urban' WHEN {t} IN ({outs}, 'Nonurban_Other') THEN 'nonurban' ELSE 'unknown' END)"


def counts(t: str, p: str) -> str:
    a, b = binary(t), binary(p)
    pairs = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return ", ".join(f"count(*) FILTER ({a} = {x} AND {b} = {y}) AS {k}" for k, (x, y) in pairs.items()) + ", count(*) AS total"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / CAST(({b}) AS DOUBLE) ELSE 0.0 END)"


def scores(correct: str = "tp + tn") -> str:
    p, r = share("tp", "tp + fp"), share("tp", "tp + fn")
    return f"round({share(correct, 'total')} * 100, 4) AS accuracy, CAST({correct} AS BIGINT) AS correct, round({p}, 6) AS precision, round({r}, 6) AS recall, round({share(f'2 * {p} * {r}', f'{p} + {r}')}, 6) AS f1"


def rate(c: str) -> str:
    return f"round(coalesce(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 0), 6)"
