"""Queries of discovery: the driver's folder as a listing, the tables' columns, and file names made of the parts' names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillgrid.plans import frames as D
from quillgrid.plans.registry import query
from quillgrid.sources import discovery as Y
from quillgrid.sources import tables as S

#: A file of predictions for each part, and a file of truth for each name of parts.
PREDICTIONS = """SELECT DISTINCT concat(CASE p_partkey % 6 WHEN 0 THEN 'urban_renewal_' WHEN 1 THEN 'Spatial_' WHEN 2 THEN 'eval_urban_renewal_' WHEN 3 THEN '~$urban_renewal_' WHEN 4 THEN 'merged_' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN concat(lower(p_type), '_', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) WHEN 2 THEN concat(split_part(p_name, ' ', 2), '_run_', CAST(p_partkey AS STRING)) WHEN 3 THEN concat('q', CAST(p_partkey AS STRING)) ELSE replace(p_name, ' ', '-') END, '.xlsx') AS name, p_brand AS folder FROM {part}"""
TRUTHS = "SELECT DISTINCT concat(replace(p_name, ' ', '_'), '.xlsx') AS name, p_brand AS folder FROM {part}"
_P, _T = f"(SELECT DISTINCT name FROM ({D.duck(PREDICTIONS)}))", f"(SELECT DISTINCT name FROM ({D.duck(TRUTHS)}))"
_IN = "NOT starts_with(lower(name), 'eval_') AND NOT starts_with(lower(name), '~$')"
_STEM = "lower(regexp_replace({c}, '(.)\\.[^.]*$', '\\1'))"
SCOPES = ("urban_renewal", "spatial", "merged", "all")


def names(spark, sf, sql=PREDICTIONS):
    return D.spark_frame(spark, sf, sql).select("name").distinct()


@query("s06_in_scope", " UNION ALL ".join(f"SELECT name, '{s}' AS scope, {_IN} AND ({'true' if s == 'all' else f'starts_with(lower(name), {chr(39)}{s}_{chr(39)})'}) AS ok FROM {_P}" for s in SCOPES))
def s06(spark, sf):
    n = names(spark, sf)
    return reduce(lambda a, b: a.union(b), [n.select("name", F.lit(s).alias("scope"), Y.in_scope("name", s).alias("ok")) for s in SCOPES])


@query("s05_prediction_files", f"SELECT table_name || '.parquet' AS name FROM information_schema.tables WHERE NOT starts_with(table_name, 'eval_')")
def s05(spark, sf):
    """What lies in the driver's folder, a file or a directory of parts."""
    return Y.prediction_files(Y.files(spark, sf, "*.parquet"), "all").select("name")


_COUNTED = " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, (SELECT count(*) FROM {t}) AS rows" for t in D.TABLES)


@query("s04_task_inputs", _COUNTED)
def s04(spark, sf):
    """Every table of the folder, read as a task's input."""
    found = [r["name"] for r in Y.files(spark, sf, "*.parquet").collect() if r["name"].removesuffix(".parquet") in D.TABLES]
    return reduce(lambda a, b: a.union(b), [S.read(spark, f"{sf}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("rows")).select("name", "rows") for n in sorted(found)])


@query("s07_truth_files", f"WITH t AS (SELECT folder, list_sort(list(DISTINCT name)) AS n FROM ({D.duck(TRUTHS)}) GROUP BY folder) SELECT folder, track, CASE WHEN track = 'legacy_archive' OR len(n) = 1 THEN array_to_string(n, ',') END AS names, CASE WHEN track <> 'legacy_archive' AND len(n) <> 1 THEN 'ValueError' ELSE '' END AS error FROM t, (VALUES ('stable_release'), ('legacy_archive')) AS v(track)")
def s07(spark, sf):
    t = D.spark_frame(spark, sf, TRUTHS)
    one = lambda track: Y.truth_files(t, "folder", track).select("folder", F.lit(track).alias("track"), F.array_join("names", ",").alias("names"), "error")
    return one("stable_release").union(one("legacy_archive"))


_TOK = "list_distinct(regexp_extract_all({c}, '[a-z0-9]+'))"


@query(
    "s08_bind_truth",
    f"""WITH p AS (SELECT name, {_STEM.replace('{c}', 'name')} AS s FROM {_P}), t AS (SELECT name AS truth, {_STEM.replace('{c}', 'name')} AS u FROM {_T}),
x AS (SELECT p.name, truth, s = u AS same, contains(s, u) OR contains(u, s) AS part, len(list_intersect({_TOK.replace('{c}', 's')}, {_TOK.replace('{c}', 'u')})) AS n FROM p, t),
b AS (SELECT name, min(truth) FILTER (same) AS a, min(truth) FILTER (part) AS c, min(truth) AS f, max(n) AS m, arg_min(truth, (-n, truth)) AS o FROM x GROUP BY name)
SELECT name, coalesce(a, c, CASE WHEN m > 0 THEN o END, f) AS truth, CASE WHEN a IS NOT NULL THEN 'exact_stem_match' WHEN c IS NOT NULL THEN 'contains_match' WHEN m > 0 THEN 'token_overlap_match' ELSE 'fallback_first_truth' END AS how FROM b""",
)
def s08(spark, sf):
    return Y.bind(names(spark, sf), names(spark, sf, TRUTHS))


@query("s10_training_files", f"SELECT name FROM {_P} WHERE contains(lower(name), 'widget') OR contains(lower(name), 'bolt')")
def s10(spark, sf):
    return Y.training_files(names(spark, sf), ("Widget", "bolt")).select("name")


@query("s11_training_contract", f"SELECT name, contains(lower(name), 'eval_') OR contains(name, '~$') AS leaks FROM {_P} WHERE contains(lower(name), 'gear')")
def s11(spark, sf):
    return Y.training_files(names(spark, sf), ("gear",), ("eval_", "~$")).select("name", "leaks")


_WANTED = "SELECT DISTINCT concat(lower(p_type), CASE WHEN p_partkey % 2 = 0 THEN concat('_', split_part(p_name, ' ', 1)) ELSE '' END) AS wanted FROM {part}"


@query("s18_matches_strategy", f"SELECT name, wanted FROM (SELECT name, {_STEM.replace('{c}', 'name')} AS s FROM {_P}), ({D.duck(_WANTED)}) WHERE s = wanted OR list_contains(string_split(s, '_'), wanted) OR array_to_string(string_split(s, '_')[1:2], '_') = wanted OR starts_with(s, wanted)")
def s18(spark, sf):
    """Strategies are few; they are sent to all tasks."""
    return names(spark, sf).join(F.broadcast(D.spark_frame(spark, sf, _WANTED)), Y.matches_strategy("name", "wanted")).select("name", "wanted")


# --- columns of the tables ---

_COLUMNS = "c AS (SELECT table_name AS name, list(column_name ORDER BY ordinal_position) AS c FROM information_schema.columns GROUP BY 1)"


def columns(spark, sf):
    """Name and columns of each table of the folder: Parquet footers, no rows."""
    return {t: spark.read.parquet(f"{sf}/{t}.parquet").columns for t in D.TABLES}


def _named(spark, sf, find):
    return spark.createDataFrame([(t, find(c)) for t, c in columns(spark, sf).items()], "name string, found string")


@query("s14_label_column", f"WITH {_COLUMNS} SELECT name, CASE WHEN list_contains(c, 'label') THEN 'label' WHEN list_contains(c, 'quality') THEN 'quality' ELSE list_filter(c, lambda x: contains(lower(x), 'n_') AND contains(lower(x), 'key'))[1] END AS found FROM c")
def s14(spark, sf):
    return _named(spark, sf, lambda c: S.label_column(c, ("label", "quality"), ("n_", "key")))


@query("s15_truth_label_column", f"WITH {_COLUMNS} SELECT name, list_filter(c, lambda x: x NOT IN ('doc_id', 'label') AND NOT regexp_matches(lower(x), 'key|text'))[1] AS found FROM c")
def s15(spark, sf):
    return _named(spark, sf, lambda c: S.other_column(c, ("doc_id", "label"), ("key", "text")))


@query("s16_truth_column", f"WITH {_COLUMNS} SELECT name, CASE WHEN list_contains(c, 'text') THEN 'text' ELSE coalesce(list_filter(c, lambda x: suffix(x, 'local_v2'))[1], 'KeyError') END AS found FROM c")
def s16(spark, sf):
    def find(c):
        try:
            return S.truth_column(c, "text")
        except KeyError as e:
            return type(e).__name__

    return _named(spark, sf, find)


_OVER = " UNION ALL ".join(f"SELECT '{t}' AS name, 'doc_id' AS wanted, CASE WHEN (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}' AND column_name = 'doc_id') > 0 THEN '' ELSE 'ValueError' END AS error" for t in D.TABLES)


@query("j22_required_columns", _OVER)
def j22(spark, sf):
    from quillgrid.operators import align as J

    def error(t):
        try:
            J.require(spark.read.parquet(f"{sf}/{t}.parquet"), ["doc_id"], t)
        except ValueError as e:
            return type(e).__name__
        return ""

    return spark.createDataFrame([(t, "doc_id", error(t)) for t in D.TABLES], "name string, wanted string, error string")
