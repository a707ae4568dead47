"""Wrong predictions by what their texts are about, and projections of predictions for people."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators.align import ROW, by_occurrence, first_existing, keep_first

#: Wording of the subject by name (fixed values).
ANCHORS = {
    "urban_renewal": r"\burban renewal\b",
    "urban_regeneration": r"\burban regeneration\b|\bregeneration\b",
    "redevelopment": r"\bredevelopment\b|\bredevelop\b",
    "revitalization": r"\brevitali[sz]ation\b|\brevitali[sz]e\b",
    "retrofit": r"\bretrofit(?:ting)?\b",
    "adaptive_reuse": r"\badaptive reuse\b",
    "densification": r"\bdensification\b",
    "renewal_mission_law": r"\brenewal mission\b|\brenewal law\b",
    "renewal_project_area": r"\brenewal project\b|\brenewal area\b|\bregenerated area\b|\bold community renewal\b|\burban village renewal\b",
}
#: Kinds of errors in order (fixed values).
KINDS = {
    "method_design_evaluation_under_renewal": r"\bmodel\b|\bmodelling\b|\bmodeling\b|\bframework\b|\bremote sensing\b|\bdeep learning\b|\bmachine learning\b|\balgorithm\b|\bgis\b|\bsatellite\b|\bassessment\b|\bevaluation\b|\boptimi[sz]ation\b|\bdesign\b",
    "governance_program_law_under_renewal": r"\bpolicy\b|\bgovernance\b|\bmission\b|\blaw\b|\bimplementation\b|\breit\b|\bprogram(?:me)?\b|\bparticipation\b|\bcompensation\b|\brelocation\b|\bbudget\b",
    "heritage_adaptive_reuse_public_realm": r"\bheritage\b|\bconservation\b|\bhistoric\b|\badaptive reuse\b|\bpublic realm\b|\bstreet\b|\bretrofitting\b|\bretrofit\b",
    "health_social_effects_under_regeneration": r"\bhealth\b|\bphysical activity\b|\bgentrification\b|\bdisplacement\b|\brehousing\b|\bcommunity\b|\bwell-being\b|\bsocial\b",
    "contamination_risk_history_with_renewal_area_wording": r"\bpollution\b|\bcontaminat\w+\b|\bsoil\b|\brisk\b|\barchaeolog\w+\b|\bhistor\w+\b|\bmosque\b|\bpops\b|\bocps\b",
}


def anchor_terms(c: Column | str, patterns: Mapping[str, str] = ANCHORS) -> Column:
    """The names of the patterns that a text matches, in order."""
    return F.array_compact(F.array(*(F.when(F.rlike(cells.col(c), F.lit(f"(?i){p}")), n) for n, p in patterns.items())))


def error_kind(c: Column | str, kinds: Mapping[str, str] = KINDS, patterns: Mapping[str, str] = ANCHORS) -> Column:
    """The first kind that a text matches; else whether it has the wording at all."""
    out = None
    for n, p in kinds.items():
        hit = F.rlike(cells.col(c), F.lit(f"(?i){p}"))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.when(F.size(anchor_terms(c, patterns)) > 0, "explicit_renewal_wording_but_other_object").otherwise("other")


def analysis(detail: DataFrame, pred: DataFrame, truth: str, label: str, *, title: str = "title", abstract: str = "abstract", reason: str = "parse_reason", order: str = ROW) -> DataFrame:
    """Every decided row whose label is wrong, with its kind and the parse reason of its title's first prediction."""
    t, p = cells.binary(truth), cells.binary(label)
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    wrong = detail.where((t != p) & t.isin(0, 1) & p.isin(0, 1)).select(title, F.when(t == 1, "FN").otherwise("FP").alias("error_type"), error_kind(whole).alias("kind"), F.array_join(anchor_terms(whole), ";").alias("anchors"))
    first = keep_first(pred.select(title, reason, order), title, order)[0].drop(order)
    return wrong.join(first, title, "left").withColumn(reason, F.coalesce(reason, F.lit("")))


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Columns that aren't there are added, blank and null cells filled, with the given values."""
    return df.withColumns({c: F.when(cells.text_of(c) == "", F.lit(v)).otherwise(F.col(c).cast("string")) if c in df.columns else F.lit(v) for c, v in defaults.items()})


#: Cells of a spatial row that has none of its own (fixed values).
SPATIAL_DEFAULTS = {"is_spatial": "0", "spatial_level": "Not mentioned", "spatial_desc": "Not mentioned", "confidence": "Low"}


def review_frame(merged: DataFrame, inputs: DataFrame | None, columns: Sequence[str], derived: Mapping[str, Sequence[str]], key: Sequence[str] = ("title", "abstract"), order: str = ROW) -> DataFrame:
    """Input columns beside derived ones, row by row.

    Inputs come from ``inputs``, paired by key and occurrence, else from the
    merged frame; a derived column is the first of its candidates that exists.
    """
    src = by_occurrence(merged.select(order, *key), inputs, key, order) if inputs is not None else merged
    left = src.select(order, *(first_existing(src, [c]).alias(c) for c in columns))
    right = merged.select(order, *(first_existing(merged, c).alias(n) for n, c in derived.items()))
    return left.join(right, order)
