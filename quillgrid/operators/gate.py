"""The family gate: which family a record belongs to, from numeric features of all stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells, text
from quillgrid.operators import phrases as P
from quillgrid.operators.lexicon import looked_up

FEATURES = (
    "rule_is_urban", "rule_is_nonurban", "rule_score", "rule_margin", "local_is_urban", "local_is_nonurban", "local_confidence", "local_margin", "topic_binary_probability", "hint_is_urban", "hint_is_nonurban", "hint_probability", "hint_label_purity", "hint_mapped_label_share", "hint_count", "risk_tag_count",
    "anchor_hit_count", "object_hit_count", "mechanism_hit_count", "text_token_count", "cross_group_conflict", "stage1_conflict_flag", "llm_hint_urban", "llm_hint_nonurban",
)
URBAN_AT, NONURBAN_AT = 0.72, 0.28
HINT_SCHEMA = "struct<available:boolean,outlier:boolean,count:bigint,purity:double,share:double,probability:double,label:string,group:string>"


def no_hint() -> Column:
    """The topic model's hint where there is no model."""
    return F.struct(F.lit(False).alias("available"), F.lit(False).alias("outlier"), F.lit(0).cast("bigint").alias("count"), *(F.lit(0.0).alias(c) for c in ("purity", "share", "probability")), F.lit("").alias("label"), F.lit("").alias("group"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Adds ``hint`` and ``llm`` where they aren't there."""
    out = df if "hint" in df.columns else df.withColumn("hint", no_hint())
    return out if "llm" in df.columns else out.withColumn("llm", F.lit(""))


def llm_hint(c: Column | str) -> Column:
    """ "1", "0" or "" of an external hint."""
    t = F.regexp_replace(cells.text_of(c), r"\.0$", "")
    return F.when(t.isin("0", "1"), t).otherwise("")


def features(df: DataFrame) -> DataFrame:
    """Adds ``features``, a struct of doubles, from rule, local, hint, llm and _sep."""
    r, lo, h = F.col("rule"), F.col("local"), F.col("hint")
    rf, lf, hf = (cells.family_of_group(x["group"]) for x in (r, lo, h))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    plains = lambda terms: list(dict.fromkeys(t.replace("-", " ") for t in terms))
    df = df.withColumn("_fg", text.seal(looked_up(df, F.col("_sep"), [t for x in (P.COMMON_ANCHORS, P.EXISTING_OBJECTS, P.MECHANISMS) for t in plains(x)])))
    count = lambda terms: F.size(F.array_intersect(F.array(*map(F.lit, plains(terms))), F.col("_fg"))).cast("double")
    v = (
        one(rf == cells.IN), one(rf == cells.OUT), r["score"], r["margin"], one(lf == cells.IN), one(lf == cells.OUT), lo["confidence"], lo["margin"], lo["p"], one(hf == cells.IN), one(hf == cells.OUT), h["probability"], h["purity"], h["share"], h["count"].cast("double"), F.size(r["risk_tags"]).cast("double"),
        count(P.COMMON_ANCHORS), count(P.EXISTING_OBJECTS), count(P.MECHANISMS), F.size(F.filter(F.split("_sep", " "), lambda w: w != "")).cast("double"), one(rf.isin(cells.IN, cells.OUT) & lf.isin(cells.IN, cells.OUT) & (rf != lf)), r["conflict"].cast("double"), one(llm_hint("llm") == "1"), one(llm_hint("llm") == "0"),
    )
    return df.withColumn("features", text.seal(F.struct(*(F.coalesce(x, F.lit(0.0)).alias(n) for n, x in zip(FEATURES, v))))).drop("_fg")


def heuristic(f: Column) -> Column:
    """The probability of the family in scope by hand-set weights (fixed values)."""
    cap = lambda c, most: F.least(f[c], F.lit(most))
    side = lambda name, x: (f[f"{name}_is_urban"] - f[f"{name}_is_nonurban"]) * x
    z = (f["topic_binary_probability"] - 0.5) * 3.6 + side("rule", F.least(f["rule_score"] / 6.5, F.lit(1.0))) + side("local", f["local_confidence"]) * 1.3 + side("hint", cap("hint_label_purity", 1.0)) * 0.5
    z = z + cap("anchor_hit_count", 3.0) * 0.12 + cap("object_hit_count", 3.0) * 0.12 + cap("mechanism_hit_count", 3.0) * 0.14 - f["risk_tag_count"] * 0.1
    z = z * F.when(f["cross_group_conflict"] > 0, 0.82).otherwise(1.0)
    z = z + F.when((f["llm_hint_urban"] > 0) & ((f["rule_is_urban"] > 0) | (f["local_is_urban"] > 0)), 0.2).otherwise(0.0)
    z = z - F.when((f["llm_hint_nonurban"] > 0) & ((f["rule_is_nonurban"] > 0) | (f["local_is_nonurban"] > 0)), 0.2).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def boundary(rule: Column, local: Column, rule_family: Column, local_family: Column) -> Column:
    """The name of the conflict between both labels."""
    across = lambda a, fa, b, fb, rest: _across(a, b, rest, (fa == cells.IN) & (fb == cells.OUT))
    out = F.when((rule_family == cells.NEITHER) & (local_family == cells.NEITHER), "double_unknown")
    for cond, bucket in [*across(rule, rule_family, local, local_family, "urban_rule_nonurban_local"), *across(local, local_family, rule, rule_family, "nonurban_rule_urban_local")]:
        out = out.when(cond, bucket)
    pattern = conflict_pattern(rule, local)
    return out.when(F.contains(pattern, F.lit("U10")) | F.contains(pattern, F.lit("N8")), "method_boundary").otherwise("same_family_or_single_source")


def _across(inside: Column, outside: Column, rest: str, split: Column) -> list[tuple[Column, str]]:
    return [*((split & inside.isin(*a) & outside.isin(*b), name) for a, b, name in P.BOUNDARIES), (split, rest)]


def conflict_pattern(rule: Column, local: Column) -> Column:
    name = lambda c: F.when(F.coalesce(c, F.lit("")) == "", cells.UNKNOWN).otherwise(c)
    return F.concat(name(rule), F.lit("_vs_"), name(local))


def gate(df: DataFrame, probability: str | None = None) -> DataFrame:
    """Adds ``gate``: families, probability (a fitted model's column, else the heuristic) and the boundary. Needs ``features``."""
    p = F.col(probability) if probability else heuristic(F.col("features"))
    r, lo = F.col("rule"), F.col("local")
    rf, lf = cells.family_of_group(r["group"]), cells.family_of_group(lo["group"])
    df = df.withColumn("_p", p)
    final = F.when(F.col("_p") >= URBAN_AT, cells.IN).when(F.col("_p") <= NONURBAN_AT, cells.OUT).otherwise(cells.NEITHER)
    g = F.struct(
        rf.alias("rule_family"), lf.alias("local_family"), final.alias("family"), F.round(F.abs(F.col("_p") - 0.5) * 2, 4).alias("confidence"), F.round("_p", 6).alias("probability"), F.lit("family_gate_model" if probability else "family_gate_heuristic").alias("source"),
        boundary(r["label"], lo["label"], rf, lf).alias("bucket"), conflict_pattern(r["label"], lo["label"]).alias("pattern"),
    )
    return df.withColumn("gate", text.seal(g)).drop("_p")


def fit(df: DataFrame, label: str):
    """A logistic regression on ``features`` with balanced classes; ``predict`` adds its probability."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    flat = df.select(F.col(label).cast("double").alias("label"), "features.*").na.fill(0.0)
    n = flat.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    if not n["n"] or n["p"] in (0.0, float(n["n"])):
        raise ValueError("both classes are needed to fit the gate")
    w = F.when(F.col("label") == 1, n["n"] / (2 * n["p"])).otherwise(n["n"] / (2 * (n["n"] - n["p"])))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(flat.withColumn("w", w))
    return LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=1000, regParam=1.0 / n["n"]).fit(rows)


def predict(df: DataFrame, model, column: str = "gate_probability") -> DataFrame:
    """The fitted gate's probability as a plain expression over ``features``."""
    z = F.lit(float(model.intercept))
    for name, weight in zip(FEATURES, model.coefficients):
        z = z + F.col(f"features.{name}") * float(weight)
    return df.withColumn(column, 1 / (1 + F.exp(-z)))
