"""Labels refined by cluster evidence, under gates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells, text
from quillgrid.operators import phrases as P


@dataclass(frozen=True)
class Config:
    """Settings (fixed values)."""

    enabled: bool = True
    mutate: bool = True
    unknown_only: bool = True
    allow_flip: bool = False
    flip_needs_review: bool = True
    near_margin: float = 0.08
    least_confidence: float = 0.72
    least_size: int = 20
    anchor_for_positive: bool = True

    @classmethod
    def from_context(cls, context: Mapping[str, object] | None) -> Config:
        """Settings from loosely typed values; what is blank or can't be read keeps its default."""
        out = {}
        for f in fields(cls):
            raw = (context or {}).get(f.name)
            if raw in (None, ""):
                continue
            try:
                kind = type(f.default)
                out[f.name] = raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(float(raw))
            except (TypeError, ValueError):
                continue
        return cls(**out)


def refine(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Overrides labels where a cluster's candidate speaks for another one.

    Reads final_label, topic_final, coverage, candidate_label, cluster_confidence,
    cluster_size, cluster, fixed_candidate, mapping_status, guard_action,
    review_flag, score, threshold, title, abstract. Adds override_applied, _label,
    _topic and _source; with ``mutate`` changes final_label, topic_final and
    coverage. A label 1 never becomes 0. Missing thresholds count as the median
    of the others, 0.5 if there are none.
    """
    if not cfg.enabled:
        return df
    now, new = cells.binary_text("final_label"), cells.binary_text("candidate_label")
    conf = F.coalesce(F.col("cluster_confidence").cast("string").try_cast("double"), F.lit(0.0))
    size = F.coalesce(F.col("cluster_size").cast("string").try_cast("double"), F.lit(0.0))
    unknown = (now == "") | (cells.text_of("topic_final") == cells.UNKNOWN) | (cells.text_of("coverage") == "unknown")
    conflict = (now != "") & (new != now) & ~unknown
    target = (new != "") & (conf >= cfg.least_confidence) & (size >= cfg.least_size) & ~((new == "0") & (now == "1"))
    target = target & (unknown if cfg.unknown_only or not cfg.allow_flip else unknown | conflict)
    if cfg.allow_flip and cfg.flip_needs_review:
        th = F.col("threshold").cast("string").try_cast("double")
        mid = df.agg(F.percentile(th, F.lit(0.5))).first()[0]
        near = F.abs(F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(0.0)) - F.coalesce(th, F.lit(0.5 if mid is None else float(mid)))) <= cfg.near_margin
        target = target & (unknown | (cells.flag_number("review_flag") > 0) | near)
    if cfg.anchor_for_positive:
        doc = text.phrase(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
        core, common, rural = (text.contains_any(doc, names) for names in (P.CORE_ANCHORS, P.COMMON_ANCHORS, P.RURAL_ANCHORS))
        action = F.lower(cells.text_of("guard_action"))
        allowed = ~rural & ((unknown & core) | (~unknown & (now == "0") & ((action == "keep_0") | ((action == "review") & common))))
        target = target & ((new != "1") | allowed)
    given, fam = cells.text_of("fixed_candidate"), cells.family("fixed_candidate")
    topic = F.when(new == "1", F.when(fam == cells.IN, given).otherwise(cells.OPEN_IN)).otherwise(F.when(fam == cells.OUT, given).otherwise(cells.OPEN_OUT))
    source = F.when(unknown, "dynamic_topic_refiner_unknown").when(conflict, "dynamic_topic_refiner_flip").otherwise("dynamic_topic_refiner")
    df = df.withColumn("_o", F.struct(target.alias("hit"), new.alias("label"), topic.alias("topic"), source.alias("source")))
    o = F.col("_o")
    put = lambda c: F.when(o["hit"], o[c]).otherwise("")
    out = df.withColumns({"override_applied": o["hit"].cast("int"), "override_label": put("label"), "override_topic": put("topic"), "override_source": put("source")})
    if cfg.mutate:
        cover = F.when(o["topic"].isin(cells.OPEN_IN, cells.OPEN_OUT), "open_set").otherwise("binary_resolved")
        out = out.withColumns({"final_label": F.when(o["hit"], o["label"]).otherwise(F.col("final_label")), "topic_final": F.when(o["hit"], o["topic"]).otherwise(F.col("topic_final")), "coverage": F.when(o["hit"], cover).otherwise(F.col("coverage"))})
    return out.drop("_o")
