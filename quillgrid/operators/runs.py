"""Runs as callable plans: inputs, strategies over recorded answers, tasks, post-processing and evaluation.

The engine asks no model itself. A strategy is a function of a frame with
recorded answers (one column for each turn); a task is inputs, strategy and
output row in one plan; a run of both tasks pairs their rows by position.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells, parse, text
from quillgrid.operators import errors, refine, topics
from quillgrid.operators import metrics as M
from quillgrid.operators.align import ROW, by_position, keep_first, require
from quillgrid.operators.lexicon import Taxonomy

# --- strategies over recorded answers ---


def single(answer: str = "answer") -> Column:
    """One turn: the label of an answer; null without one."""
    return F.when(cells.text_of(answer) != "", parse.simple_answer(answer))


def stepwise(answer: str = "answer") -> Column:
    """The first step's label; further attributes are another task's."""
    return single(answer)


def long_context(answer: str = "answer") -> Column:
    """struct(label, reason) of an answer given within a longer session; an empty answer is 0."""
    return parse.answer(answer)


def reflection(first: str = "answer", second: str = "answer_2") -> Column:
    """Two turns: the second answer's tab-separated fields, the first one's if the second is empty; null without a first."""
    chosen = F.when(cells.text_of(second) == "", F.col(first)).otherwise(F.col(second))
    return F.when(cells.text_of(first) != "", parse.tabbed(chosen))


STRATEGIES: dict[str, Callable[..., Column]] = {"single": single, "stepwise": stepwise, "stepwise_long": long_context, "reflection": reflection}

#: What a step prompt says where there is only a title and an abstract, and its question (fixed values).
ONLY_TITLE_ABSTRACT = "[TITLE_ABSTRACT_ONLY MODE]"
FIRST_STEP = "Step 1: Urban renewal study? Output only 1 or 0."


def step_prompt(base: Column, has_metadata: Column, hints: Column, step: int, note: str = ONLY_TITLE_ABSTRACT) -> Column:
    """A step's prompt: the single prompt, a note where there are no metadata, the weak hints, and the first step's question."""
    parts = [base, F.when(~has_metadata, F.lit(note)), F.when(hints != "", hints), *([F.lit(FIRST_STEP)] if step == 1 else [])]
    return F.concat_ws("\n", *parts)


def answered(df: DataFrame, answer: str, method: str = "pure_llm_api", reason: str = "parse_reason") -> DataFrame:
    """The output row of a task that an external model decides alone: label (blank or unreadable: 0), source, reason and flags."""
    a = parse.answer(answer)
    label = F.when(a["label"].isin("0", "1"), a["label"]).otherwise("0")
    return df.withColumns({"is_target": label, "final_label": label, "decision_source": F.lit(method), "decision_reason": a["reason"], reason: a["reason"], "llm_used": F.lit(1), "llm_attempted": F.lit(1), "llm_failure_reason": F.lit("")})


# --- tasks ---


def not_blank(df: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Rows with a title or an abstract; others are passed over by every task."""
    return df.where((F.coalesce(title, F.lit("")) != "") | (F.coalesce(abstract, F.lit("")) != ""))


def spatial(df: DataFrame, answer: str = "answer", keep: Sequence[str] = (ROW, "title", "abstract")) -> DataFrame:
    """The spatial task: attributes of each recorded answer, checked against the row's text, blank cells filled; rows in their own order."""
    s = F.col("_s")
    rows = not_blank(df).withColumn("_s", text.seal(parse.spatial(answer, "title", "abstract")))
    flat = rows.select(*keep, s["is_spatial"].alias("is_spatial"), s["level"].alias("spatial_level"), s["area"].alias("spatial_desc"), s["reasoning"].alias("reasoning"), s["confidence"].alias("confidence"), s["status"].alias("validation_status"), s["reason"].alias("validation_reason"), s["evidence"].alias("area_evidence"))
    return errors.with_defaults(flat, errors.SPATIAL_DEFAULTS)


def both(target: DataFrame, where: DataFrame, order: str = ROW) -> DataFrame:
    """The outputs of both tasks side by side, row by row; they must have the same rows."""
    return by_position(target, where, order=order)


def run(df: DataFrame, task: str, target: Callable[[DataFrame], DataFrame], where: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A run of one task or both: urban_renewal, spatial or both."""
    if task == "urban_renewal":
        return target(df)
    if task == "spatial":
        return where(df)
    if task != "both":
        raise ValueError(f"no task {task}")
    return both(target(df), where(df))


def batch(df: DataFrame, wanted: Mapping[str, str], title: str = "title") -> DataFrame:
    """Several strategies over one input, a label column each (``wanted``: strategy to answer column), with a paper id."""
    rows = not_blank(df)
    label = lambda name, answer: long_context(answer)["label"] if name == "stepwise_long" else STRATEGIES[name](answer)
    return rows.select("*", cells.paper_id(F.col(ROW), title).alias("paper_id"), *(label(n, a).alias(f"{n}_label") for n, a in wanted.items()))


def postprocess(df: DataFrame, key: str, doc: str, taxonomy: Taxonomy, *, discover: bool = False, refined: bool = False, settings: Mapping[str, object] | None = None) -> DataFrame:
    """Cluster what the chain left open, the rows with a ``source_pool`` (``discover``), and let firm clusters correct labels (``refined``); a failure isn't swallowed.

    Reads final_label, and for ``refined`` the columns of ``refine.refine`` that
    don't come from the clusters.
    """
    if not discover and not refined:
        return df
    out = topics.enrich(df, key, doc, taxonomy)
    out = topics.candidates(out, label="final_label", candidate="fixed_candidate", status="mapping_status", keywords="cluster_keywords", confidence_="cluster_confidence")
    return refine.refine(out, refine.Config.from_context(settings)) if refined else out


# --- labels and predictions for samples ---


def label_frame(df: DataFrame, label: str, also: Sequence[str] = (), title: str = "title", order: str = ROW) -> DataFrame:
    """Labelled rows by trimmed lower-case title, the first of each, with the label as 1, 0 or -1."""
    require(df, [title, label, *also], "labels")
    keyed = df.select(order, title, *also, cells.binary(label).alias("truth"), F.lower(text.strip(F.coalesce(F.col(title).cast("string"), F.lit("nan")))).alias("_key"))
    return keep_first(keyed, "_key", order)[0]


#: What the columns of a spatial run are called beside labels (fixed values).
SPATIAL_NAMES = {"spatial_level": "spatial_level_pred", "spatial_desc": "spatial_desc_pred", "Reasoning": "spatial_reasoning", "Confidence": "spatial_confidence"}


def spatial_frame(df: DataFrame, title: str = "title", order: str = ROW) -> DataFrame:
    """A spatial run's attributes by trimmed lower-case title, the first of each, under the names they have beside labels."""
    require(df, [title, "is_spatial", "spatial_level", "spatial_desc"], "spatial predictions")
    key = F.lower(text.strip(F.coalesce(F.col(title).cast("string"), F.lit("nan")))).alias("_key")
    rows = df.select(order, key, cells.binary("is_spatial").alias("spatial_pred"), *(F.col(c).alias(n) for c, n in SPATIAL_NAMES.items() if c in df.columns))
    return keep_first(rows, "_key", order)[0].drop(order)


# --- contracts of a run ---


def track_of(explicit: str | None, path: str | None, train_root: str) -> str:
    """The experiment's track: as said, research_matrix for inputs from the training folder, else stable_release."""
    if explicit:
        return explicit.strip().lower()
    inside = path is not None and (PurePosixPath(path) == PurePosixPath(train_root) or PurePosixPath(train_root) in PurePosixPath(path).parents)
    return "research_matrix" if inside else "stable_release"


POLICIES = ("per_paper_isolated", "cross_paper_long_context")


def session_policy(task: str, method: str, explicit: str | None = None) -> str:
    """Whether rows share a session: as said, else only where a model alone decides and the task isn't spatial."""
    if explicit:
        if explicit.strip() not in POLICIES:
            raise ValueError(f"no session policy {explicit}")
        return explicit.strip()
    return POLICIES[1] if task != "spatial" and method == "pure_llm_api" else POLICIES[0]


def contract(*, track: str, dataset: str, task: str, method: str, hints: bool, path: str, release: str, root: str) -> list[str]:
    """What a release run breaks: its dataset, folder, task and method are set; other tracks are free."""
    if track != "stable_release":
        return []
    tests = {"dataset": dataset == release, "input": PurePosixPath(root) in PurePosixPath(path).parents, "task": task == "urban_renewal", "method": method == "three_stage_hybrid" and hints}
    return [name for name, ok in tests.items() if not ok]


def environment(version: tuple[int, int], available: Sequence[str], needed: Sequence[str], want: tuple[int, int] | None = None, newest: tuple[int, int] = (3, 13)) -> list[str]:
    """What a runtime lacks: a version that is too new or another one than is wanted, and modules."""
    out = ["too new"] if version > newest else []
    out += ["other version"] if want is not None and version != want else []
    return out + [f"missing {m}" for m in sorted(set(needed) - set(available))]


# --- evaluation ---


def evaluate(truth: DataFrame, preds: Mapping[str, DataFrame], key: str, label: str, pred: str, source: str | None = None) -> dict[str, DataFrame]:
    """Every prediction file against the truth: metrics, unknown rates, and metrics by source; a file's name is in each row.

    Rows pair by ``key``; rows that only one side has aren't counted.
    """
    found: dict[str, DataFrame | None] = {"metrics": None, "unknown": None, "sources": None}
    for name, df in sorted(preds.items()):
        pair = truth.select(key, F.col(label).alias("_t")).join(df.select(key, F.col(pred).alias("_p"), *([source] if source else [])), key)
        parts = {"metrics": M.binary(pair, "_t", "_p"), "unknown": M.unknown_rate(pair, "_p", "_t")}
        if source:
            parts["sources"] = M.by_source(pair, "_t", "_p", source)
        for k, part in parts.items():
            part = part.select(F.lit(name).alias("file"), "*")
            found[k] = part if found[k] is None else found[k].unionByName(part)
    return {k: v for k, v in found.items() if v is not None}


def metadata_rows(manifests: DataFrame, bindings: DataFrame, first: str) -> DataFrame:
    """A row for each prediction file: its truth, how it was found, its manifest's settings, and whether it compares with the first one.

    ``manifests``: file, settings (map); ``bindings``: file, truth, how. A file
    without a manifest has blank settings and its own signature.
    """
    empty = F.create_map().cast("map<string,string>")
    m = bindings.join(manifests, "file", "left").withColumn("found", F.col("settings").isNotNull()).withColumn("settings", F.coalesce("settings", empty))
    sign = F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";"), 256)
    m = m.withColumn("signature", sign)
    base = m.where(F.col("file") == first).select(F.col("settings").alias("_base"))  # one row
    m = m.join(F.broadcast(base), how="cross")
    keys = F.array_sort(F.filter(F.array_union(F.map_keys("settings"), F.map_keys("_base")), lambda k: ~F.try_element_at("settings", k).eqNullSafe(F.try_element_at("_base", k))))
    value = lambda k: F.coalesce(F.try_element_at("settings", F.lit(k)), F.lit("")).alias(k)
    return m.select("file", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), "truth", "how", "found", "signature", (F.size(keys) == 0).alias("comparable"), F.array_join(keys, ";").alias("issues"), value("dataset_id"), value("session_policy"), value("order_id"))


def export_tables(facts: DataFrame, sources: Mapping[str, DataFrame], values: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of a report: its facts in long form, and each source table as name, row label and value, in order of value."""
    out = {"facts": M.long_form(facts, facts.columns, "fact", "value")}
    for name, df in sources.items():
        label, value = next(c for c in df.columns if c != values[name]), values[name]
        out[name] = df.select(F.lit(name).alias("table"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    return out


# --- model bundles ---


def save_bundle(model: DataFrame, folder: str, settings: Mapping[str, str]) -> None:
    """A fitted model's table and its settings, under one folder."""
    model.write.mode("overwrite").parquet(f"{folder}/model")
    spark = model.sparkSession
    spark.createDataFrame(sorted(settings.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")


def load_bundle(spark, folder: str) -> tuple[DataFrame, dict[str, str]]:
    settings = {r["key"]: r["value"] for r in spark.read.parquet(f"{folder}/settings").collect()}
    return spark.read.parquet(f"{folder}/model"), settings


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that depends on all rows and not on their order: rows, and the sum of their hashes."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def intact(bundle: Mapping[str, DataFrame], recorded: DataFrame) -> DataFrame:
    """name, intact: whether each table of a bundle has the fingerprint on record (name, rows, hash); tables without a record aren't."""
    now = None
    for name, df in bundle.items():
        one = fingerprint(df).select(F.lit(name).alias("name"), "*")
        now = one if now is None else now.unionByName(one)
    old = recorded.select("name", F.col("rows").alias("_r"), F.col("hash").alias("_h"))
    return now.join(old, "name", "left").select("name", (F.col("rows").eqNullSafe(F.col("_r")) & F.col("hash").eqNullSafe(F.col("_h"))).alias("intact"))
