"""The decision chain: fusion, recovery of unknowns, gate, guards, open set, binary decision, audit.

Every stage is DataFrame -> DataFrame and adds one struct column, so a row keeps
the whole record of how it was decided; ``final_columns`` flattens it once. A
stage is a table of (condition, outcome), the first that holds counts.

Columns read: title, abstract, _sep (``lexicon.fields``), rule, local, hint, llm,
and the stages before. ``decision`` is the running result: topic, source,
reason, confidence, review_flag, review_reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells, text
from quillgrid.operators import gate as G
from quillgrid.operators import phrases as P
from quillgrid.operators.lexicon import SIGNAL_LISTS, any_of, hits_among, looked_up

UNKNOWN, IN, OUT = cells.UNKNOWN, cells.IN, cells.OUT
PROMOTIONS = ("anchor_guard_promotion", "uncertain_nonurban_promotion", "family_gate_recovery")


@dataclass(frozen=True)
class Settings:
    """Thresholds (fixed values)."""

    anchor_guard: bool = True
    anchor_family_floor: float = 0.40
    anchor_binary_floor: float = 0.50
    anchor_needs_candidate: bool = True
    anchor_within_score: float = 3.60
    anchor_within_margin: float = 1.00
    uncertain_guard: bool = True
    uncertain_within_score: float = 3.40
    uncertain_within_margin: float = 1.00
    uncertain_local_confidence: float = 0.62
    uncertain_local_margin: float = 1.20
    uncertain_family_floor: float = 0.52
    open_set: bool = True
    open_set_family_floor: float = 0.52
    threshold: float = 0.45
    low_confidence: float = 0.60
    review_margin: float = 0.005
    recall: bool = True
    recall_context_score: float = 0.067
    recall_context_floor: float = 0.46
    recall_topic_floor: float = 0.56
    recall_core_floor: float = 0.58
    recall_broad_floor: float = 0.52
    recall_evidence_floor: float = 0.50
    recall_promotion_floor: float = 0.62
    hint_support: int = 35
    hint_purity: float = 0.80
    hint_share: float = 0.70
    hint_probability: float = 0.50


DEFAULT = Settings()


def s(*parts: Column | str) -> Column:
    """Text of columns and (as str) literals."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def more(reason: Column, *parts: Column | str) -> Column:
    """A reason with another one after a semicolon."""
    return F.when(reason == "", s(*parts)).otherwise(s(reason, ";", *parts))


def decision(topic, source, reason, confidence, flag=None, review=None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, int, float)) else x
    return F.struct(lit(topic).alias("topic"), lit(source).alias("source"), lit(reason).alias("reason"), F.round(lit(confidence), 4).alias("confidence"), (F.lit(0) if flag is None else lit(flag)).cast("int").alias("review_flag"), (F.lit("") if review is None else lit(review)).alias("review_reason"))


def first_match(table: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = None
    for cond, result in table:
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out.otherwise(otherwise) if otherwise is not None else out


def pair_table(table: dict, rule: Column, local: Column) -> Column:
    """An entry of a table by (rule, local), null if there is none; a tuple becomes an array."""
    flat = {f"{a}|{b}": v for (a, b), v in table.items()}
    value = lambda v: F.array(*(F.lit(float(x)) for x in v)) if isinstance(v, tuple) else F.lit(float(v))
    return F.try_element_at(F.create_map(*(x for k, v in flat.items() for x in (F.lit(k), value(v)))), s(rule, "|", local))


# --- signals that several stages read ---


def rule_confidence(r: Column | str = "rule") -> Column:
    r = cells.col(r)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    c = 0.18 + 0.48 * unit(r["score"] / 8) + 0.24 * unit(r["margin"] / 4) + F.when(r["strong"], 0.08).otherwise(0.0)
    return F.round(F.least(F.greatest(c, F.lit(0.2)), F.lit(0.99)), 4)


def hint_quality(h: Column | str = "hint", cfg: Settings = DEFAULT) -> Column:
    h = cells.col(h)
    high = (h["count"] >= cfg.hint_support) & (h["purity"] >= cfg.hint_purity) & (h["share"] >= cfg.hint_share)
    return F.when(~h["available"], "unavailable").when(h["outlier"], "outlier").when(high, "high").when((h["count"] >= 10) & (h["purity"] >= 0.60), "medium").otherwise("low")


def has_signal(signals: Column, needle: str) -> Column:
    return F.exists(signals, lambda x: F.contains(F.lower(x), F.lit(needle)))


def signals(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds, once for all stages, ``sig`` (what the text and the labels say) and the best label within either family."""
    both = text.plain(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    raw = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    df = G.with_defaults(df).withColumns({"_x": both, "_y": text.plain("title"), "_raw": text.seal(raw)})
    terms = [t.replace("-", " ") for x in SIGNAL_LISTS for t in x]
    df = df.withColumn("_fx", text.seal(looked_up(df, F.col("_x"), terms)))
    # the title begins the whole text, so it has no term that the text hasn't
    df = df.withColumn("_fy", text.seal(text.bind(F.col("_y"), lambda v: F.filter("_fx", lambda t: F.contains(v, t)))))
    x, y = F.col("_fx"), F.col("_fy")
    quality = hint_quality(cfg=cfg)
    good = quality.isin("high", "medium")
    first = lambda terms: F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains("_raw", t))
    block = F.coalesce(s("text=", F.try_element_at(first(P.PROMOTION_BLOCKS), F.lit(1))), F.when(F.contains("_raw", F.lit("brownfield")), s("brownfield_nonurban=", F.try_element_at(first(P.BROWNFIELD_BLOCKS), F.lit(1)))), F.lit(""))
    sig = F.struct(
        hits_among(x, P.CORE_ANCHORS).alias("core"), hits_among(x, P.COMMON_ANCHORS).alias("broad"), hits_among(y, P.CORE_ANCHORS).alias("title_core"), any_of(x, P.EXISTING_OBJECTS).alias("object"), any_of(x, P.MECHANISMS).alias("mechanism"), any_of(x, P.CONTEXT).alias("context"), any_of(x, P.NEGATIONS).alias("negated"),
        hits_among(x, P.ACTIONS).alias("actions"), hits_among(x, P.BUILT).alias("built"), hits_among(x, P.POLICY).alias("policy"), any_of(y, P.ACTIONS).alias("title_action"), any_of(y, P.BUILT).alias("title_built"), block.alias("text_block"), F.coalesce(s("text=", F.try_element_at(first(P.RECOVERY_BLOCKS), F.lit(1))), F.lit("")).alias("recovery_block"),
        rule_confidence().alias("rule_confidence"), quality.alias("quality"), ((F.col("hint.group") == IN) & good).alias("hint_in"), ((F.col("hint.group") == OUT) & good).alias("hint_out"), G.llm_hint("llm").alias("llm"),
    )
    df = df.withColumn("sig", text.seal(sig)).drop("_x", "_y", "_raw", "_fx", "_fy")
    return df.withColumns({"within_in": text.seal(within(F.lit(IN), None, cfg)), "within_out": text.seal(within(F.lit(OUT), None, cfg))})


# --- fusion ---


def fuse(df: DataFrame) -> DataFrame:
    """Adds ``decision`` from both stages' labels; sixteen cases. Needs ``sig``."""
    r, lo, rc = F.col("rule"), F.col("local"), F.col("sig.rule_confidence")
    a, b, lc, lm = r["label"], lo["label"], lo["confidence"], lo["margin"]
    no_rule, no_local, strong, same = a == UNKNOWN, b == UNKNOWN, r["strong"], (r["group"] == lo["group"])
    same_group = ~no_rule & ~no_local & same
    top = F.greatest(rc, lc)
    fusion = lambda t, why, c: decision(t, "rule_model_fusion", s(f"{why}:", t), c)
    stage2 = lambda why: decision(b, "stage2_classifier", s(f"{why}:", b), lc)
    review = lambda why: decision(UNKNOWN, "unknown_review", why, top, 0, why)
    table = [
        ((a == b) & ~no_rule, fusion(b, "rule_local_agree", top)),
        (no_rule & no_local, review("rule_unknown_local_unknown")),
        (strong & ~no_rule & no_local, fusion(a, "rule_high_confidence_local_unknown", rc)),
        (strong & same_group & (rc >= lc + 0.05), fusion(a, "rule_high_confidence_same_group", rc)),
        (strong & same_group, stage2("local_stronger_same_group")),
        (strong & ~no_rule & (rc >= lc + 0.18), fusion(a, "rule_high_conflict_override_local", rc)),
        (strong & ~no_rule & (lc >= rc + 0.18) & (lm >= 1.5), stage2("local_stronger_cross_group")),
        (strong & ~no_rule, review("rule_local_cross_group_conflict")),
        (no_local & (rc >= 0.62) & ~no_rule, fusion(a, "rule_preferred_local_unknown", rc)),
        (no_local, review("local_unknown_rule_weak")),
        (same_group & (lc >= 0.45), stage2("local_same_group")),
        (same_group, fusion(a, "rule_same_group_backup", rc)),
        (no_rule, stage2("rule_unknown_local_direct")),
        ((lc >= 0.72) & (lm >= 1.6), stage2("local_cross_group_strong")),
        ((rc >= 0.72) & (r["margin"] >= 2.5), fusion(a, "rule_cross_group_strong", rc)),
    ]
    hard = r["route"] == "hard_negative"
    first = decision(a, "stage1_rule", r["reason"], F.lit(0.98))
    return df.withColumn("decision", text.seal(F.when(hard, first).otherwise(first_match(table, review("rule_local_cross_group_both_weak")))))


# --- a label within a family ---


def within(family: Column, extra_topic: Column | None = None, cfg: Settings = DEFAULT) -> Column:
    """struct(label, score, margin): the best label of a family over local scores, the rule's score and the hint's bonus.

    Unknown if the best has less than 2.8, or less than 1.0 more than the next.
    """
    r, lo, h = F.col("rule"), F.col("local"), F.col("hint")
    bonus = F.when(F.col("sig.quality") == "high", 0.8).when(F.col("sig.quality") == "medium", 0.45).otherwise(0.0)
    add = lambda label, score, ok: F.when(ok, F.array(F.struct(label.alias("label"), score.alias("score")))).otherwise(F.expr("cast(array() as array<struct<label:string,score:double>>)"))
    rows = F.concat(lo["scored"], add(r["label"], r["score"], (r["label"] != UNKNOWN) & (r["group"] == family)))
    if extra_topic is not None:
        rows = F.concat(rows, add(extra_topic, lo["confidence"] * 8, (extra_topic != UNKNOWN) & (cells.family(extra_topic) == family)))
    own = F.coalesce(F.array_max(F.transform(F.filter(rows, lambda x: x["label"] == h["label"]), lambda x: x["score"])), F.lit(0.0))
    rows = F.concat(rows, add(h["label"], own + bonus, (h["label"] != "") & (cells.family(h["label"]) == family)))
    rows = F.filter(rows, lambda x: (x["label"] != UNKNOWN) & (cells.family(x["label"]) == family))

    def ranked(rows: Column) -> Column:
        labels = F.array_distinct(F.transform(rows, lambda x: x["label"]))
        return F.array_sort(F.transform(labels, lambda k: F.struct((-F.array_max(F.transform(F.filter(rows, lambda x: x["label"] == k), lambda x: x["score"]))).alias("minus"), k.alias("label"))))

    def pick(best: Column) -> Column:
        top, second = -F.try_element_at(best, F.lit(1))["minus"], F.coalesce(-F.try_element_at(best, F.lit(2))["minus"], F.lit(0.0))
        margin = F.round(F.greatest(top - second, F.lit(0.0)), 4)
        known = family.isin(IN, OUT) & (F.size(best) > 0)
        label = F.when(known & (top >= 2.8) & (margin >= 1.0), F.try_element_at(best, F.lit(1))["label"]).otherwise(UNKNOWN)
        return F.struct(label.alias("label"), F.when(known, F.round(top, 4)).otherwise(0.0).alias("score"), F.when(known, margin).otherwise(0.0).alias("margin"))

    return text.bind(text.bind(rows, ranked), pick)


# --- unknown topics ---


def _resolved(topic: Column, reason: Column, confidence: Column, path: str, evidence: Column) -> Column:
    return F.struct(topic.alias("topic"), F.lit("unknown_hint_resolution").alias("source"), reason.alias("reason"), F.round(confidence, 4).alias("confidence"), F.lit(path).alias("path"), evidence.alias("evidence"))


def offline() -> Column:
    """Curated rules that need no hint; null if none holds."""
    r, lo, h = F.col("rule"), F.col("local"), F.col("hint")
    a, b, score, p = r["label"], lo["label"], r["score"], lo["p"]
    marks, risks = r["matches"], r["risk_tags"]
    pattern, bucket = G.conflict_pattern(a, b), G.boundary(a, b, r["group"], lo["group"])
    any_of = lambda names: F.exists(F.array(*(F.lit(n) for n in names)), lambda n: F.exists(marks, lambda m: F.contains(F.lower(m), n)))
    ev = F.format_string("pattern=%s;bucket=%s;trigger=", pattern, bucket)
    by_rule = lambda why: _resolved(a, s(f"offline_unknown_curated_rule:{why}:", a), F.greatest(F.col("sig.rule_confidence"), F.lit(0.66)), "unknown_offline_curated_rule", s(ev, F.format_string(f"{why};rule=%s;rule_score=%.2f;rule_margin=%.2f;binary=%.4f", a, score, r["margin"], p)))
    need = pair_table(P.OFFLINE_LOCAL, a, b)
    why = s(F.lower(a), "_to_", F.lower(b), "_strong_local")
    by_local = _resolved(b, s("offline_unknown_curated_local:", why, ":", b), F.greatest(lo["confidence"], F.lit(0.68)), "unknown_offline_curated_local", s(ev, why, F.format_string(";local=%s;local_confidence=%.4f;local_margin=%.4f;binary=%.4f", b, lo["confidence"], lo["margin"], p)))
    pure = (h["label"] == a) & (h["purity"] >= 0.80)
    known_unknown, in_out = (a != UNKNOWN) & (b == UNKNOWN), (r["group"] == IN) & (lo["group"] == OUT)
    table = [
        (known_unknown & (a == "U1") & (score >= 2.5) & any_of(P.U1_SIGNALS), by_rule("u1_anchor_bundle")),
        (known_unknown & (a == "U9") & (score >= 4.0) & any_of(P.U9_SIGNALS), by_rule("u9_policy_governance_bundle")),
        (known_unknown & (a == "U10") & (score >= 3.5) & (p >= 0.90) & any_of(P.U10_SIGNALS), by_rule("u10_finance_anchor_bundle")),
        (known_unknown & (a == "U12") & ((has_signal(marks, "gentrification") & ~has_signal(risks, P.MEDIA_RISK)) | pure | (r["margin"] >= 2.0)), by_rule("u12_gentrification_bundle")),
        (known_unknown & (a == "U4") & ((score >= 3.8) | ((score >= 2.85) & has_signal(marks, "title:redevelopment"))), by_rule("u4_redevelopment_bundle")),
        (known_unknown & (a == "U13") & (score >= 4.5) & has_signal(marks, "anchor:brownfield") & has_signal(marks, "anchor:revitalization"), by_rule("u13_brownfield_interim_use")),
        ((r["group"] == OUT) & (lo["group"] == IN) & need.isNotNull() & (lo["confidence"] >= need[0]) & (lo["margin"] >= need[1]) & (p >= need[2]), by_local),
        (in_out & (a == "U1") & (b == "N1") & (score >= 2.5), by_rule("u1_over_n1_curated")),
        (in_out & (a == "U12") & (b == "N1") & (score >= 2.0), by_rule("u12_over_n1_curated")),
        (in_out & (a == "U12") & b.isin("N5", "N7", "N9") & (score >= 4.5) & has_signal(marks, "gentrification") & has_signal(marks, "displacement"), by_rule("u12_displacement_cross_group")),
        (in_out & (a == "U4") & (b == "N1") & ~has_signal(risks, "greenfield") & (has_signal(marks, "redevelopment") | has_signal(marks, "revitalization")), by_rule("u4_over_n1_inner_city")),
        (in_out & (a == "U5") & b.isin("N9", "N10") & (p <= 0.03) & has_signal(marks, "anchor:brownfield"), by_rule("u5_brownfield_cross_group")),
    ]
    return first_match(table)


def hinted() -> Column:
    """Rules that read the external hint and the topic model; null if none holds."""
    r, lo, g = F.col("rule"), F.col("local"), F.col("sig")
    a, b, rc, lc, lm, llm = r["label"], lo["label"], g["rule_confidence"], lo["confidence"], lo["margin"], g["llm"]
    free, yes, no = g["recovery_block"] == "", llm == "1", llm == "0"
    out = lambda t, why, c, floor, path="unknown_hint_resolution", ev=None: _resolved(t, s(f"{why}:", t), F.greatest(c, F.lit(floor)), path, F.lit("") if ev is None else ev)
    weak = F.try_element_at(F.create_map(*(F.lit(x) for kv in P.WEAK_RULES.items() for x in kv)), a)
    ku, ki = (a != UNKNOWN) & (b == UNKNOWN), (a == UNKNOWN) & (b != UNKNOWN)
    io, oi = (r["group"] == IN) & (lo["group"] == OUT), (r["group"] == OUT) & (lo["group"] == IN)
    to_topic, to_local = pair_table(P.RULE_TO_TOPIC, a, b), pair_table(P.RULE_TO_LOCAL, a, b)
    ev = lambda fam: s(f"family={fam};sources=llm+local+bertopic;label=", b)
    table = [
        (ku & (r["group"] == OUT) & no & (rc >= 0.24), out(a, "rule_unknown_local_llm_family_nonurban_weak", rc, 0.60)),
        (ku & weak.isNotNull() & yes & (rc >= weak) & free, out(a, "rule_unknown_local_llm_family_curated", rc, 0.60)),
        (ku & (r["group"] == IN) & yes & (rc >= 0.35) & free, out(a, "rule_unknown_local_llm_family", rc, 0.62)),
        (ku & (r["group"] == IN) & g["hint_in"] & (rc >= 0.50) & free, out(a, "rule_unknown_local_bertopic_support", rc, 0.64)),
        (ku & (r["group"] == OUT) & g["hint_out"] & (rc >= 0.50), out(a, "rule_unknown_local_bertopic_support", rc, 0.64)),
        (io & yes & g["hint_in"] & (rc >= 0.35) & (lc <= 0.60) & (lm <= 1.0) & free, out(a, "cross_group_dual_urban_support", rc, 0.64)),
        (io & yes & to_topic.isNotNull() & (rc >= to_topic) & free, out(a, "cross_group_curated_rule_urban", rc, 0.62)),
        (oi & yes & to_local.isNotNull() & (lc >= to_local[0]) & (lm >= to_local[1]) & free, out(b, "cross_group_curated_local_urban", lc, 0.68)),
        (oi & no & g["hint_out"] & (rc >= 0.35) & (lc <= 0.60) & (lm <= 1.0), out(a, "cross_group_dual_nonurban_support", rc, 0.64)),
        (ki & (lo["group"] == IN) & yes & g["hint_in"] & (lc >= 0.62) & free, out(b, "local_unknown_rule_llm_bertopic_support", lc, 0.64, "unknown_hint_bertopic", ev(IN))),
        (ki & (lo["group"] == OUT) & no & g["hint_out"] & (lc >= 0.62), out(b, "local_unknown_rule_llm_bertopic_support", lc, 0.64, "unknown_hint_bertopic", ev(OUT))),
    ]
    return first_match(table)


def consensus(w: Column) -> Column:
    """The label within the hint's family that several sources bear out; null if they don't. ``w``: ``within`` that family."""
    r, lo, g = F.col("rule"), F.col("local"), F.col("sig")
    family = F.when(g["llm"] == "1", IN).when(g["llm"] == "0", OUT)
    by_rule, by_local = r["group"] == family, lo["group"] == family
    by_hint = F.when(family == IN, g["hint_in"]).otherwise(g["hint_out"])
    sources = F.array_compact(F.array(F.lit("llm"), F.when(by_rule, "rule"), F.when(by_local, "local"), F.when(by_hint, "bertopic")))
    floor = F.when(by_rule & (w["label"] == r["label"]), 4.8).otherwise(3.4)
    named = (w["label"] == r["label"]) | (w["label"] == lo["label"])
    ok = family.isNotNull() & (w["label"] != UNKNOWN) & (F.size(sources) >= 2) & (by_rule | by_hint) & (w["margin"] >= 1.0) & (w["score"] >= floor) & (named | (F.size(sources) >= 3))
    c = F.greatest(F.lit(0.64), F.when(w["label"] == r["label"], g["rule_confidence"]).otherwise(0.0), F.when(w["label"] == lo["label"], lo["confidence"]).otherwise(0.0))
    ev = s(F.format_string("family=%s;sources=", family), F.array_join(sources, "+"), F.format_string(";within=%s;score=%.2f;margin=%.2f", w["label"], w["score"], w["margin"]))
    return F.when(ok, _resolved(w["label"], s("llm_family_consensus_within_family:", w["label"]), c, "unknown_hint_consensus", ev))


def resolve_unknown(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``recovery`` (path, evidence) and gives unknown decisions a topic where a rule allows it."""
    own = F.when(F.col("sig.llm") == "1", F.col("within_in")).otherwise(F.col("within_out"))
    df = df.withColumn("_w", text.seal(own)).withColumn("_f", text.seal(F.when(F.col("decision.topic") == UNKNOWN, F.coalesce(offline(), hinted(), consensus(F.col("_w"))))))
    d, f, hit = F.col("decision"), F.col("_f"), F.col("_f").isNotNull()
    path = F.when(d["topic"] != UNKNOWN, "not_triggered").when(hit, f["path"]).otherwise("retained_unknown")
    new = F.when(hit, decision(f["topic"], f["source"], f["reason"], f["confidence"])).otherwise(F.when(d["topic"] == UNKNOWN, decision(UNKNOWN, d["source"], d["reason"], d["confidence"], 1, d["review_reason"])).otherwise(d))
    return df.withColumn("recovery", text.seal(F.struct(path.alias("path"), F.coalesce(f["evidence"], F.lit("")).alias("evidence")))).withColumn("decision", text.seal(new)).drop("_w", "_f")


# --- gate ---


def apply_gate(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``inner`` (the label within the gate's family); an unknown topic takes it under ten conditions. Needs ``gate``."""
    df = df.withColumn("inner", text.seal(within(F.col("gate.family"), F.col("decision.topic"), cfg)))
    d, g, w, sg = F.col("decision"), F.col("gate"), F.col("inner"), F.col("sig")
    want = F.when(sg["llm"] == "1", IN).when(sg["llm"] == "0", OUT)
    by_rule, by_hint, by_local = F.col("rule.group") == want, F.col("hint.group") == want, F.col("local.group") == want
    votes = 1 + by_rule.cast("int") + by_local.cast("int") + by_hint.cast("int")
    ok = F.coalesce((d["topic"] == UNKNOWN) & (w["label"] != UNKNOWN) & (w["score"] >= 4.0) & (w["margin"] >= 1.0) & (g["confidence"] >= 0.82) & (g["family"] == want) & (by_rule | by_hint) & (votes >= 2), F.lit(False))
    new = decision(w["label"], "family_gate_recovery", more(d["reason"], s("family_gate:", g["family"], ":", w["label"])), F.greatest(d["confidence"], 0.58 + g["confidence"] * 0.25))
    ev = F.format_string("family=%s;within=%s;family_confidence=%.4f;within_score=%.2f;within_margin=%.2f", g["family"], w["label"], g["confidence"], w["score"], w["margin"])
    rec = F.when(ok, F.struct(F.lit("family_gate_recovery").alias("path"), ev.alias("evidence"))).otherwise(F.col("recovery"))
    return df.withColumn("recovery", text.seal(rec)).withColumn("decision", text.seal(F.when(ok, new).otherwise(d)))


# --- guards of topics out of scope ---


def block_reason(topic: Column) -> Column:
    """Why a topic out of scope must not be promoted; empty if nothing speaks against it."""
    r = F.col("rule")
    return (
        F.when(r["reason"].isin(*P.HARD_NEGATIVES), s("route=", r["reason"])).when(F.array_contains(r["risk_tags"], P.GREENFIELD_RISK), f"risk_tag={P.GREENFIELD_RISK}").when(topic == "N9", "final_topic=N9").otherwise(F.col("sig.text_block"))
    )


def in_scope(c: Column) -> Column:
    return cells.family(c) == IN


def anchor_guard(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``guard``: a topic out of scope although a core anchor occurs is blocked, promoted, or put up for review."""
    d, g, sg, w = F.col("decision"), F.col("gate"), F.col("sig"), F.col("within_in")
    given = F.filter(F.array(F.when(F.col("inner.label") == UNKNOWN, "").otherwise(F.col("inner.label")), F.col("local.label"), F.col("hint.label")), in_scope)
    good = (w["label"] != UNKNOWN) & (w["score"] >= cfg.anchor_within_score) & (w["margin"] >= cfg.anchor_within_margin)
    fallback = (F.size(given) == 0) & good
    candidate = F.coalesce(F.try_element_at(given, F.lit(1)), F.when(fallback, w["label"]))
    if not cfg.anchor_needs_candidate:
        candidate = F.coalesce(candidate, F.when(in_scope(F.col("rule.label")), F.col("rule.label")))
    marks = F.array_compact(
        F.array(
            F.when(fallback, F.format_string("urban_within_candidate:%s@%.2f/%.2f", w["label"], w["score"], w["margin"])), F.when(candidate.isNotNull(), s("urban_candidate:", candidate)), F.when(g["probability"] >= cfg.anchor_family_floor, f"family_probability_urban>={cfg.anchor_family_floor:.2f}"),
            F.when(F.col("local.p") >= cfg.anchor_binary_floor, f"topic_binary_probability>={cfg.anchor_binary_floor:.2f}"), F.when(g["bucket"].isin(*P.GUARD_BUCKETS), s("boundary_bucket:", g["bucket"])),
        )
    )
    applies = F.lit(cfg.anchor_guard) & (cells.family(d["topic"]) == OUT) & ~F.col("rule.reason").isin(*P.HARD_NEGATIVES) & (F.size(sg["core"]) > 0)
    df = df.withColumn("_g", text.seal(F.struct(marks.alias("marks"), candidate.alias("candidate"), block_reason(d["topic"]).alias("block"), applies.alias("applies"))))
    m = F.col("_g")
    why = F.array_join(m["marks"], "; ")
    act = lambda action, reason: F.struct(F.lit(action).alias("action"), reason.alias("reason"), F.array_join(sg["core"], "; ").alias("hits"))
    review = lambda tail: decision(d["topic"], "anchor_guard_review", more(d["reason"], f"anchor_guard_core_anchor_{tail}"), d["confidence"], 1, more(d["review_reason"], "anchor_guard_core_anchor_without_support" if tail == "without_support" else "anchor_guard_support_without_urban_candidate"))
    promoted = decision(m["candidate"], "anchor_guard_promotion", more(d["reason"], s("anchor_guard_core_anchor_promote:", m["candidate"], ";", why)), F.greatest(d["confidence"], F.lit(0.58)), d["review_flag"], d["review_reason"])
    blocked = decision(d["topic"], d["source"], more(d["reason"], s("anchor_guard_blocked:", m["block"])), d["confidence"], d["review_flag"], d["review_reason"])
    cases = [(~m["applies"], act("", F.lit("")), d), (m["block"] != "", act("blocked_nonurban_risk", m["block"]), blocked), (m["candidate"].isNotNull() & (F.size(m["marks"]) > 0), act("promote", why), promoted)]
    cases += [(F.size(m["marks"]) > 0, act("review", s("support_without_urban_candidate;", why)), review("support_without_urban_candidate")), (F.lit(True), act("review", F.lit("core_anchor_without_support")), review("without_support"))]
    return df.withColumns({"guard": text.seal(first_match([(c, a) for c, a, _ in cases])), "decision": text.seal(first_match([(c, x) for c, _, x in cases]))}).drop("_g")


def uncertain_guard(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``doubt``: a topic out of scope that the rule stage itself wanted reviewed is promoted, blocked, reviewed or kept."""
    d, g, sg, w, n, lo = F.col("decision"), F.col("gate"), F.col("sig"), F.col("within_in"), F.col("inner"), F.col("local")
    candidate_reason = F.startswith(d["reason"], F.lit("rule_local_agree:")) | F.startswith(d["reason"], F.lit("rule_high_conflict_override_local:"))
    applies = F.lit(cfg.uncertain_guard) & (cells.family(d["topic"]) == OUT) & ~F.col("rule.reason").isin(*P.HARD_NEGATIVES) & (F.col("rule.review_flag") == 1) & (d["source"] == "rule_model_fusion") & candidate_reason
    by_inner = in_scope(n["label"]) & (n["score"] >= cfg.uncertain_within_score) & (n["margin"] >= cfg.uncertain_within_margin)
    by_local = in_scope(lo["label"]) & (lo["confidence"] >= cfg.uncertain_local_confidence) & (lo["margin"] >= cfg.uncertain_local_margin)
    by_family = (g["probability"] >= cfg.uncertain_family_floor) & g["bucket"].isin(*P.PROMOTE_BUCKETS)
    falls = by_family & ~by_inner & ~by_local & (w["label"] != UNKNOWN)
    label = F.coalesce(F.when(by_inner, n["label"]), F.when(by_local, lo["label"]), F.when(falls, w["label"]))
    at = lambda name, x, a, b: F.format_string(f"{name}:%s@%.2f/%.2f", x, a, b)
    marks = F.array_compact(F.array(F.when(by_inner, at("within_family", n["label"], n["score"], n["margin"])), F.when(by_local, at("local_urban", lo["label"], lo["confidence"], lo["margin"])), F.when(by_family, F.format_string("family_prob_bucket:%.2f:%s", g["probability"], g["bucket"])), F.when(falls, at("fallback_within", w["label"], w["score"], w["margin"]))))
    anchored = (F.size(sg["core"]) > 0) | (F.size(sg["broad"]) > 0)
    block = F.when(block_reason(d["topic"]) != "", block_reason(d["topic"])).when(~anchored, "missing_renewal_anchor").otherwise("")
    rl = F.col("rule.label")
    meaning = F.coalesce(s("core_anchor:", F.try_element_at(sg["core"], F.lit(1))), s("broad_anchor:", F.try_element_at(sg["broad"], F.lit(1))), F.when(F.array_contains("rule.risk_tags", P.OTHER_OBJECT_RISK), f"risk_tag:{P.OTHER_OBJECT_RISK}"))
    risky = rl.isin(*P.HIGH_RISK_RULES) | ((rl == "N8") & meaning.isNotNull())
    df = df.withColumn("_g", text.seal(F.struct(applies.alias("applies"), label.alias("label"), F.array_join(marks, "; ").alias("why"), block.alias("block"), risky.alias("risky"), F.array_join(F.array_compact(F.array(s("high_risk_rule:", rl), meaning)), "; ").alias("evidence"))))
    m = F.col("_g")
    keep = s("rule=", rl, " not in high_risk_bucket")
    act = lambda a, e: F.struct(F.lit(a).alias("action"), e.alias("reason"))
    same = lambda reason: decision(d["topic"], d["source"], reason, d["confidence"], d["review_flag"], d["review_reason"])
    cases = [
        (~m["applies"], act("", F.lit("")), d),
        (m["label"].isNotNull() & (m["block"] != ""), act("blocked_nonurban_risk", m["block"]), same(more(d["reason"], s("uncertain_nonurban_blocked:", m["block"])))),
        (m["label"].isNotNull(), act("promote", m["why"]), decision(m["label"], "uncertain_nonurban_promotion", more(d["reason"], s("uncertain_nonurban_promote:", m["label"], ";", m["why"])), F.greatest(d["confidence"], F.lit(0.58)), d["review_flag"], d["review_reason"])),
        (m["risky"], act("review", m["evidence"]), decision(d["topic"], "uncertain_nonurban_review", more(d["reason"], s("uncertain_nonurban_review:", m["evidence"])), d["confidence"], 1, more(d["review_reason"], "uncertain_nonurban_review"))),
        (F.lit(True), act("keep_0", keep), d),
    ]
    return df.withColumns({"doubt": text.seal(first_match([(c, a) for c, a, _ in cases])), "decision": text.seal(first_match([(c, x) for c, _, x in cases]))}).drop("_g")


def rule_review(df: DataFrame) -> DataFrame:
    """The first stage's review flag carried over where the decision has none."""
    d, r = F.col("decision"), F.col("rule")
    unknown = d["topic"] == UNKNOWN
    flag = F.when(unknown | (d["review_flag"] == 1) | (r["review_flag"] == 1), 1).otherwise(0)
    fresh = F.when(d["review_reason"] != "", d["review_reason"]).otherwise(F.when(r["review_reason"] != "", r["review_reason"]).otherwise(F.when(unknown, "unknown_review").otherwise("")))
    reason = F.when(d["review_flag"] == 1, d["review_reason"]).when(flag == 1, fresh).otherwise("")
    return df.withColumn("decision", text.seal(decision(d["topic"], d["source"], d["reason"], d["confidence"], flag, reason)))


# --- open set ---


def open_set_evidence(cfg: Settings = DEFAULT) -> Column:
    """struct(ok, reason, evidence): is it in scope although no topic fits?"""
    d, g, sg, r = F.col("decision"), F.col("gate"), F.col("sig"), F.col("rule")
    risky = F.arrays_overlap(r["risk_tags"], F.array(*(F.lit(x) for x in (P.TECHNICAL_RISK, P.GREENFIELD_RISK, P.MEDIA_RISK, P.BACKGROUND_RISK))))
    few = lambda a, n=4: F.array_join(F.slice(a, 1, n), ",")
    some = lambda a: F.size(a) > 0
    titled = sg["title_action"] | sg["title_built"]
    say = lambda ok, reason, ev: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"), ev.alias("evidence"))
    positive = (sg["llm"] == "1") | ((g["family"] == IN) & (g["probability"] >= cfg.open_set_family_floor))
    block = block_reason(d["topic"])
    both = some(sg["actions"]) & some(sg["built"]) & titled & ~risky
    return first_match(
        [
            (sg["negated"], say(False, "negated_renewal_context", F.lit("negated renewal wording"))),
            (block != "", say(False, "nonurban_promotion_blocked", block)),
            (some(sg["title_core"]), say(True, "core_renewal_anchor", F.array_join(F.slice(sg["title_core"], 1, 5), "; "))),
            (some(sg["core"]) & (titled | (some(sg["built"]) & some(sg["policy"]))) & ~risky, say(True, "core_renewal_anchor", s("core=", few(sg["core"]), ";objects=", few(sg["built"])))),
            (both, say(True, "renewal_action_existing_urban_object", s("actions=", few(sg["actions"]), ";objects=", few(sg["built"])))),
            ((d["topic"] == UNKNOWN) & positive & both, say(True, "family_or_llm_positive_unmapped", F.format_string("family_probability=%.4f", g["probability"]))),
        ],
        say(False, "no_open_set_urban_evidence", F.lit("")),
    )


def open_set(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``open`` (flag, topic, reason, evidence, coverage); unknown or doubtful topics may become the open-set label."""
    df = df.withColumn("_e", text.seal(open_set_evidence(cfg)))
    d, e = F.col("decision"), F.col("_e")
    hard = F.col("rule.reason").isin(*P.HARD_NEGATIVES)
    group = cells.family(d["topic"])
    covered = group.isin(IN, OUT) & ~d["topic"].isin(cells.OPEN_IN, cells.OPEN_OUT) & ~((group == OUT) & d["source"].isin("uncertain_nonurban_review", "anchor_guard_review"))
    st = lambda flag, topic, reason, ev, cover: F.struct(F.lit(flag).alias("flag"), F.lit(topic).alias("topic"), reason.alias("reason"), ev.alias("evidence"), cover.alias("coverage"))
    blank = F.lit("")
    new = decision(cells.OPEN_IN, "open_set_recovery", more(d["reason"], s("open_set_urban_other:", e["reason"])), F.greatest(d["confidence"], F.lit(0.55)), 1, more(d["review_reason"], "open_set_topic"))
    rest = F.when(d["topic"] == UNKNOWN, "unknown").when(d["topic"] == cells.OPEN_OUT, "open_set").otherwise("covered")
    cases = [(F.lit(not cfg.open_set), st(0, "", blank, blank, blank), d), (hard, st(0, "", F.lit("hard_negative"), F.col("rule.reason"), F.lit("hard_negative")), d), (covered, st(0, "", blank, blank, F.lit("covered")), d), (e["ok"], st(1, cells.OPEN_IN, e["reason"], e["evidence"], F.lit("open_set")), new), (F.lit(True), st(0, "", blank, blank, rest), d)]
    return df.withColumns({"open": text.seal(first_match([(c, a) for c, a, _ in cases])), "decision": text.seal(first_match([(c, x) for c, _, x in cases]))}).drop("_e")


# --- binary decision ---


def vote(topic: Column) -> Column:
    """Mean of five labels' families: 1, 0, or 0.5 for none."""
    one = lambda c: F.when(cells.family(c) == IN, 1.0).when(cells.family(c) == OUT, 0.0).otherwise(0.5)
    inner = F.when(F.col("inner.label") == UNKNOWN, "").otherwise(F.col("inner.label"))
    five = [F.col("rule.label"), F.col("local.label"), inner, F.col("hint.label"), topic]
    out = F.lit(0.0)
    for c in five:
        out = out + one(c)
    return F.round(out / 5, 6)


def anchor_evidence(topic: Column) -> Column:
    """struct(p, evidence) of anchors, objects and mechanisms in the text."""
    sg = F.col("sig")
    say = lambda p, e: F.struct(F.lit(p).alias("p"), e.alias("evidence"))
    return first_match(
        [
            ((F.size(sg["core"]) > 0) & ~sg["negated"], say(0.75, s("core_anchor:", F.coalesce(F.try_element_at(sg["core"], F.lit(1)), F.lit(""))))), ((F.size(sg["broad"]) > 0) & ~sg["negated"], say(0.65, s("broad_anchor:", F.coalesce(F.try_element_at(sg["broad"], F.lit(1)), F.lit(""))))),
            (sg["object"], say(0.65, F.lit("existing_urban_object"))), (sg["mechanism"], say(0.65, F.lit("renewal_mechanism"))), (F.array_contains("rule.risk_tags", P.TECHNICAL_RISK) & (topic == "N8"), say(0.45, F.lit("technical_method_risk"))),
        ],
        say(0.50, F.lit("neutral")),
    )


def risk_adjustment(tags: Column) -> Column:
    out = F.lit(0.0)
    for tag, a in P.RISK_ADJUSTMENTS.items():
        out = out + F.when(F.array_contains(tags, tag), a).otherwise(0.0)
    return out


def recall_floor(raw: Column, cfg: Settings = DEFAULT) -> Column:
    """struct(score, flag, tier, reason): the highest floor that the evidence gives; of equal floors the first."""
    sg, d = F.col("sig"), F.col("decision")
    core, broad = (F.size(sg["core"]) > 0) & ~sg["negated"], (F.size(sg["broad"]) > 0) & ~sg["negated"]
    labels = (("rule", F.col("rule.label")), ("local", F.col("local.label")), ("within", F.col("inner.label")), ("bertopic", F.col("hint.label")), ("final", d["topic"]))
    sources = F.array_compact(F.array(*(F.when(in_scope(c), n) for n, c in labels)))
    topical, final_in = F.size(sources) > 0, in_scope(d["topic"])
    tags = F.col("rule.risk_tags")
    blocked = F.when(F.array_contains(tags, P.TECHNICAL_RISK) & (d["topic"] == "N8") & ~(core | broad | sg["object"]), "generic_technical_n8_without_substantive_anchor").when(F.array_contains(tags, P.GREENFIELD_RISK) & ~(core | broad), "greenfield_expansion_without_renewal_anchor")
    floor = lambda ok, v, tier, why, i: F.when(ok, F.struct(F.lit(v).alias("floor"), F.lit(-i).alias("first"), F.lit(tier).alias("tier"), why.alias("why")))
    context = sg["context"] | topical | sg["object"] | sg["mechanism"]
    best = F.array_max(
        F.array_compact(
            F.array(
                floor(final_in, cfg.recall_topic_floor, "final_topic_urban_floor", s("final_topic=", d["topic"]), 0), floor(core, cfg.recall_core_floor, "core_anchor_floor", F.lit("core_anchor"), 1), floor(broad & (sg["context"] | topical | sg["object"]), cfg.recall_broad_floor, "broad_anchor_context_floor", F.lit("broad_anchor_with_urban_context"), 2),
                floor(topical & (sg["object"] | sg["mechanism"] | sg["context"]), cfg.recall_evidence_floor, "urban_evidence_context_floor", F.lit("urban_topic_evidence_with_context"), 3), floor((raw >= cfg.recall_context_score) & context & ~sg["negated"], cfg.recall_context_floor, "context_relevance_floor", F.lit(f"raw_score>={cfg.recall_context_score:.3f}"), 4),
                floor(d["source"].isin(*PROMOTIONS), cfg.recall_promotion_floor, "guard_promotion_floor", d["source"], 5),
            )
        )
    )
    say = lambda score, flag, tier, why: F.struct(score.alias("score"), F.lit(flag).alias("flag"), tier.alias("tier"), why.alias("reason"))

    def say_best(best: Column) -> Column:
        detail = F.when(topical, s(best["why"], ";urban_sources=", F.array_join(sources, ","))).otherwise(best["why"])
        return first_match(
            [(F.lit(not cfg.recall), say(raw, 0, F.lit("none"), F.lit("disabled"))), (blocked.isNotNull(), say(raw, 0, F.lit("blocked"), blocked)), (best.isNull(), say(raw, 0, F.lit("none"), F.lit("no_recall_evidence"))), (best["floor"] <= raw, say(raw, 0, F.lit("none"), F.lit("score_already_above_recall_floor")))],
            say(best["floor"], 1, best["tier"], detail),
        )

    return text.bind(best, say_best)


def raw_score(cfg: Settings = DEFAULT) -> Column:
    d = F.col("decision")
    llm = F.when(F.col("sig.llm") == "1", 1.0).when(F.col("sig.llm") == "0", 0.0).otherwise(0.5)
    unit = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    moved = F.when(d["source"].isin(*PROMOTIONS), 0.16).when((d["source"] == "unknown_hint_resolution") & F.startswith(d["reason"], F.lit("rule_unknown_local_llm_family_nonurban_weak:")), -0.10).otherwise(0.0)
    z = 0.40 * unit(F.col("gate.probability")) + 0.25 * unit(F.col("local.p")) + 0.20 * vote(d["topic"]) + 0.10 * anchor_evidence(d["topic"])["p"] + 0.05 * llm + risk_adjustment(F.col("rule.risk_tags")) + moved
    return F.round(F.least(F.greatest(z, F.lit(0.02)), F.lit(0.98)), 6)


def inconsistent(label: Column, topic: Column) -> Column:
    g = cells.family(topic)
    return ((g == cells.NEITHER) | ((label == "1") & (g != IN)) | ((label == "0") & (g == IN))).cast("int")


def binary_decision(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``binary`` (score, label, confidence, source, inconsistent, recall) and the review reasons that follow."""
    d = F.col("decision")
    hard = F.col("rule.reason").isin(*P.HARD_NEGATIVES)
    df = df.withColumn("_raw", text.seal(raw_score(cfg))).withColumn("_c", text.seal(recall_floor(F.col("_raw"), cfg)))
    score = F.when(hard, 0.02).otherwise(F.round(F.least(F.greatest(F.col("_c.score"), F.lit(0.02)), F.lit(0.98)), 6))
    df = df.withColumn("_z", text.seal(score))
    label = F.when(hard, "0").when(F.col("_z") >= cfg.threshold, "1").otherwise("0")
    conf = F.when(hard, 0.98).when(label == "1", F.round("_z", 6)).otherwise(F.round(1 - F.col("_z"), 6))
    recall = F.when(hard, F.struct(F.col("_z").alias("score"), F.lit(0).alias("flag"), F.lit("hard_negative").alias("tier"), F.col("rule.reason").alias("reason"))).otherwise(F.col("_c"))
    b = F.struct(F.col("_z").alias("score"), F.col("_raw").alias("raw"), label.alias("label"), conf.alias("confidence"), F.when(hard, "binary_hard_negative_override").otherwise("binary_confidence_resolution").alias("source"), inconsistent(label, d["topic"]).alias("inconsistent"), recall.alias("recall"))
    df = df.withColumn("binary", text.seal(b))
    old = F.filter(F.split(d["review_reason"], ";"), lambda x: x != "")
    reasons = F.array_distinct(F.concat(old, F.array_compact(F.array(F.when(F.col("binary.confidence") < cfg.low_confidence, "binary_low_confidence"), F.when(F.col("binary.inconsistent") == 1, "binary_topic_inconsistency")))))
    flag = F.when(hard, d["review_flag"]).otherwise(F.when((d["review_flag"] == 1) | (F.size(reasons) > 0), 1).otherwise(0))
    new = F.struct(d["topic"].alias("topic"), d["source"].alias("source"), d["reason"].alias("reason"), F.col("binary.confidence").alias("confidence"), flag.cast("int").alias("review_flag"), F.when(hard, d["review_reason"]).otherwise(F.array_join(reasons, ";")).alias("review_reason"))
    return df.withColumn("decision", text.seal(new)).drop("_raw", "_c", "_z")


# --- audit and result ---


def audit(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``audit`` (disagreement of label and topic; it never changes either) and ``review``, the final review signal."""
    d, b = F.col("decision"), F.col("binary")
    g = cells.family(d["topic"])
    hard = F.col("rule.reason").isin(*P.HARD_NEGATIVES)
    base = F.format_string("from=%s;score=%.4f;threshold=%.4f;", d["topic"], b["score"], F.lit(cfg.threshold))
    say = lambda flag, action, reason, ev: F.struct(F.lit(flag).alias("flag"), F.lit(action).alias("action"), reason.alias("reason"), ev.alias("evidence"))
    pos, neg = (b["label"] == "1") & (g != IN), (b["label"] == "0") & (g != OUT)
    a = first_match(
        [(hard, say(0, "hard_negative_preserved", F.col("rule.reason"), F.col("rule.reason"))), (pos, say(1, "positive_binary_conflict_audit", s("binary_positive_from_", d["topic"]), s(base, "recall=", b["recall"]["tier"], ";source=", b["source"]))), (neg, say(1, "negative_binary_conflict_audit", s("binary_negative_from_", d["topic"]), s(base, "source=", b["source"])))],
        say(0, "covered", s("binary_", b["label"], "_matches_", g), F.lit("")),
    )
    reason = F.when(hard, d["reason"]).when(pos, more(d["reason"], s("binary_audit_positive_conflict:", d["topic"]))).when(neg, more(d["reason"], s("binary_audit_negative_conflict:", d["topic"]))).otherwise(d["reason"])
    manual = ("anchor_guard_core_anchor_without_support", "anchor_guard_support_without_urban_candidate", "uncertain_nonurban_review")
    why = F.array_distinct(F.concat(F.array_compact(F.array(F.when(F.abs(b["score"] - cfg.threshold) <= cfg.review_margin, "binary_near_threshold"), F.when(b["inconsistent"] == 1, "binary_topic_inconsistency"), F.when((b["recall"]["tier"] == "blocked") & (b["label"] == "1"), "risk_blocked_positive"))), F.filter(F.split(d["review_reason"], ";"), lambda x: x.isin(*manual))))
    why = F.when(hard, F.array().cast("array<string>")).otherwise(why)
    return df.withColumns({"audit": text.seal(a), "review": text.seal(F.struct((F.size(why) > 0).cast("int").alias("flag"), F.array_join(why, ";").alias("reason")))}).withColumn("decision", text.seal(F.struct(d["topic"].alias("topic"), d["source"].alias("source"), reason.alias("reason"), d["confidence"].alias("confidence"), d["review_flag"].alias("review_flag"), d["review_reason"].alias("review_reason"))))


def balance(label: Column, confidence: Column, hard: Column, conflict: Column) -> Column:
    """How the evidence stands, in ten words."""
    return (
        F.when(hard, "hard_negative").when(conflict == 1, F.when(label == "1", "conflict_positive").otherwise("conflict_negative")).when((label == "1") & (confidence >= 0.75), "strong_positive").when((label == "1") & (confidence >= 0.60), "positive").when(label == "1", "low_confidence_positive")
        .when((label == "0") & (confidence >= 0.75), "strong_negative").when((label == "0") & (confidence >= 0.60), "negative").when(label == "0", "low_confidence_negative").otherwise("unknown")
    )


def explain(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``explanation``: the decision in a sentence, evidence for and against, the balance, and the stack of rules."""
    d, b, g, sg, gd, db, op, r = (F.col(c) for c in ("decision", "binary", "gate", "sig", "guard", "doubt", "open", "rule"))
    fam = cells.family(d["topic"])
    at = lambda name, c, ok: F.when(ok, F.format_string(f"{name}=%.4f", c))
    risks = F.transform(r["risk_tags"], lambda t: s("risk_tag=", t))
    is_other = lambda t: F.endswith(t, F.lit(P.OTHER_OBJECT_RISK))
    plus = F.concat(F.array_compact(F.array(F.when(fam == IN, s("topic_final=", d["topic"])), F.when(op["flag"] == 1, s("open_set=", op["reason"])), F.when(gd["action"] == "promote", s("anchor_guard=promote(", gd["hits"], ")")), F.when(gd["action"] == "review", "anchor_guard=core_anchor_review"), F.when(db["action"] == "promote", s("uncertain_nonurban_guard=promote(", db["reason"], ")")), at("family_probability", g["probability"], g["probability"] >= 0.60), at("topic_binary_probability", F.col("local.p"), F.col("local.p") >= 0.60), F.when(sg["llm"] == "1", "llm_family_hint=1"))), F.filter(risks, is_other), F.array_compact(F.array(F.when(b["recall"]["flag"] == 1, s("recall_calibration=", b["recall"]["tier"])))))
    minus = F.concat(F.array_compact(F.array(F.when(fam == OUT, s("topic_final=", d["topic"])), F.when(fam == cells.NEITHER, "topic_final=Unknown"), F.when(db["action"].isin("review", "keep_0"), s("uncertain_nonurban_guard=", db["action"], "(", db["reason"], ")")), at("family_probability", g["probability"], g["probability"] <= 0.35), at("topic_binary_probability", F.col("local.p"), F.col("local.p") <= 0.35), F.when(sg["llm"] == "0", "llm_family_hint=0"))), F.filter(risks, lambda t: ~is_other(t)), F.array_compact(F.array(F.when(b["recall"]["tier"] == "blocked", s("recall_calibration_blocked=", b["recall"]["reason"])))))
    shown = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_distinct(a), "; ")).otherwise("none")
    none = lambda c: F.when(c == "", "none").otherwise(c)
    line = F.format_string("final=%s; score=%.4f%sthreshold=%.4f; confidence=%.4f; topic=%s/%s; coverage=%s; source=%s; review=%d", b["label"], b["score"], F.when(b["score"] >= cfg.threshold, ">=").otherwise("<"), F.lit(cfg.threshold), d["confidence"], d["topic"], fam, op["coverage"], d["source"], F.col("review.flag"))
    stack = F.concat_ws(" > ", s("route=", r["route"], ":", r["reason"]), s("rule=", r["label"]), s("local=", F.col("local.label")), s("family=", g["source"], ":", g["family"]), s("anchor=", none(gd["action"])), s("uncertain_nonurban=", none(db["action"])), s("open_set=", none(op["topic"]), ":", op["reason"]), s("binary_audit=", F.col("audit.action")), s("binary=", b["source"], ":", b["recall"]["tier"]))
    return df.withColumn("explanation", text.seal(F.struct(line.alias("text"), shown(plus).alias("positive"), shown(minus).alias("negative"), balance(b["label"], d["confidence"], r["reason"].isin(*P.HARD_NEGATIVES), b["inconsistent"]).alias("balance"), stack.alias("stack"))))


def decide(df: DataFrame, cfg: Settings = DEFAULT, gate_probability: str | None = None) -> DataFrame:
    """The whole chain over title, abstract, _sep, rule and local (hint and llm where there are any)."""
    df = fuse(signals(df, cfg))
    df = resolve_unknown(df, cfg)
    df = G.gate(G.features(df), gate_probability)
    df = uncertain_guard(anchor_guard(apply_gate(df, cfg), cfg), cfg)
    return explain(audit(binary_decision(open_set(rule_review(df), cfg), cfg), cfg), cfg)


def final_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The flat prediction row."""
    d, b = F.col("decision"), F.col("binary")
    return df.select(
        *keep, b["label"].alias("final_label"), d["topic"].alias("topic_final"), cells.family(d["topic"]).alias("topic_final_group"), d["source"].alias("decision_source"), d["reason"].alias("decision_reason"), F.round(d["confidence"], 4).alias("confidence"), F.col("review.flag").alias("review_flag"), F.col("review.reason").alias("review_reason"),
        d["review_flag"].alias("review_flag_raw"), d["review_reason"].alias("review_reason_raw"), F.col("rule.route").alias("metadata_route"), F.col("rule.reason").alias("metadata_route_reason"), F.array_join("rule.risk_tags", "; ").alias("stage1_risk_tags"), F.col("rule.label").alias("topic_rule"), F.col("rule.score").alias("topic_rule_score"), F.col("rule.margin").alias("topic_rule_margin"),
        F.array_join("rule.top3", "; ").alias("topic_rule_top3"), F.col("local.label").alias("topic_local_label"), F.col("local.confidence").alias("topic_local_confidence"), F.col("local.margin").alias("topic_local_margin"), F.col("local.p").alias("topic_binary_probability"), F.col("gate.family").alias("family_predicted_family"), F.col("gate.probability").alias("family_probability"), F.col("gate.confidence").alias("family_confidence"),
        F.col("gate.bucket").alias("boundary_bucket"), F.col("gate.pattern").alias("family_conflict_pattern"), F.col("inner.label").alias("topic_within_family_label"), F.col("inner.score").alias("topic_family_within_score"), F.col("inner.margin").alias("topic_family_within_margin"), F.col("recovery.path").alias("unknown_recovery_path"), F.col("recovery.evidence").alias("unknown_recovery_evidence"),
        F.col("guard.action").alias("anchor_guard_action"), F.col("guard.reason").alias("anchor_guard_reason"), F.col("doubt.action").alias("uncertain_guard_action"), F.col("doubt.reason").alias("uncertain_guard_reason"), F.col("open.flag").alias("open_set_flag"), F.col("open.topic").alias("open_set_topic"), F.col("open.reason").alias("open_set_reason"), F.col("open.coverage").alias("taxonomy_coverage_status"),
        b["score"].alias("probability_score"), b["source"].alias("binary_decision_source"), b["inconsistent"].alias("binary_topic_consistency_flag"), b["recall"]["flag"].alias("binary_recall_calibration_flag"), b["recall"]["tier"].alias("binary_recall_calibration_tier"), b["recall"]["reason"].alias("binary_recall_calibration_reason"), F.col("audit.flag").alias("binary_audit_flag"),
        F.col("audit.action").alias("binary_audit_action"), F.col("explanation.text").alias("decision_explanation"), F.col("explanation.positive").alias("primary_positive_evidence"), F.col("explanation.negative").alias("primary_negative_evidence"), F.col("explanation.balance").alias("evidence_balance"), F.col("explanation.stack").alias("decision_rule_stack"),
    )
