"""Topic scores of texts from a lexicon, and the first, rule-based stage of the decision.

A lexicon is data: ``Taxonomy`` holds definitions that can come from JSON. Each
definition becomes one expression over literal arrays, so scoring is a single
projection without a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import cells, text
from quillgrid.operators import phrases as P
from quillgrid.operators import qgrams

TITLE_WEIGHT, SEED, CONTEXT, COMBO, EXCLUDE = 1.35, 3.0, 1.0, 4.0, 3.0


def _plain(term: str) -> str:
    return " ".join(term.lower().split()).replace("-", " ")


@dataclass(frozen=True)
class Topic:
    """One topic's terms. Seeds and context terms are looked up as written, the others with hyphens as spaces."""

    label: str
    group: str
    name: str = ""
    seeds: tuple[str, ...] = ()
    context_terms: tuple[str, ...] = ()
    context_anchors: tuple[str, ...] = ()
    combos: tuple[tuple[str, ...], ...] = ()
    excludes: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    context_bonus: float = 1.5
    anchor_penalty: float | None = None  # taken off if no anchor occurs
    renewal_penalty: float | None = None  # taken off if a renewal anchor and an object or a mechanism occur


@dataclass(frozen=True)
class Taxonomy:
    topics: tuple[Topic, ...]
    names: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_json(cls, raw: str) -> Taxonomy:
        fix = lambda d: {k: tuple(map(tuple, v)) if k == "combos" else tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        return cls(tuple(Topic(**fix(d)) for d in json.loads(raw)))


#: A small lexicon of our own, for examples and tests.
SAMPLE = Taxonomy(
    (
        Topic("U1", cells.IN, "old housing", ("estate renewal", "old housing"), ("residents", "housing"), ("renewal", "upgrading")),
        Topic("U9", cells.IN, "governance", ("renewal governance",), ("policy",), ("urban regeneration",), (("urban regeneration", "policy"),), anchors=("renewal", "regeneration"), anchor_penalty=2.1),
        Topic("N1", cells.OUT, "urbanisation", ("urbanization", "urban growth"), excludes=("renewal",), renewal_penalty=2.15),
        Topic("N8", cells.OUT, "methods", ("neural network", "algorithm"), ("accuracy",), renewal_penalty=2.35),
    )
)


def hits(text_: Column, terms: Sequence[str]) -> Column:
    """The phrases that a plain text contains, in their own order and as written."""
    pairs = [(t, t.replace("-", " ")) for t in terms if t]
    if not pairs:
        return F.array().cast("array<string>")
    table = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("plain")) for t, p in pairs))
    return text.bind(text_, lambda x: F.transform(F.filter(table, lambda r: F.contains(x, r["plain"])), lambda r: r["term"]))


def any_hit(text_: Column, terms: Sequence[str]) -> Column:
    return text.contains_any(text_, [_plain(t) for t in terms])


def everything(taxonomy: Taxonomy) -> qgrams.Index:
    """One index of all terms that the stages look for: the taxonomy's and the rules' own lists."""
    return qgrams.Index([*_in_fields(taxonomy), *_in_both(taxonomy), *(p for x in RULE_LISTS for p in _plains(x))])


def looked_up(df: DataFrame, text_: Column, terms: Sequence[str]) -> Column:
    """Which of the plain terms a text contains; from the row's candidates (``fields`` with an index) more terms may come along."""
    return text.bind(text_, lambda v: F.filter("_cand", lambda t: F.contains(v, t))) if "_cand" in df.columns else text.contained(text_, list(dict.fromkeys(terms)))


def hits_among(found: Column, terms: Sequence[str]) -> Column:
    """``hits`` from the plain terms found in a text."""
    pairs = [(t, t.replace("-", " ")) for t in terms if t]
    if not pairs:
        return F.array().cast("array<string>")
    table = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("plain")) for t, p in pairs))
    return F.transform(F.filter(table, lambda r: F.array_contains(found, r["plain"])), lambda r: r["term"])


def any_of(found: Column, terms: Sequence[str]) -> Column:
    """``any_hit`` from the plain terms found in a text."""
    return _any_among(_plains(terms), found)


def weighted(title: Column, abstract: Column, terms: Sequence[str], base: float) -> tuple[Column, Column]:
    """(score, matches ``field:term``) of terms in either field; the title weighs more."""
    terms = [" ".join(t.lower().split()) for t in terms if t.strip()]
    if not terms:
        return F.lit(0.0), F.array().cast("array<string>")
    arr = F.array(*(F.lit(t) for t in terms))
    in_title, in_abstract = F.filter(arr, lambda t: F.contains(title, t)), F.filter(arr, lambda t: F.contains(abstract, t))
    found = F.flatten(F.transform(arr, lambda t: F.array_compact(F.array(F.when(F.contains(title, t), F.concat(F.lit("title:"), t)), F.when(F.contains(abstract, t), F.concat(F.lit("abstract:"), t))))))
    return base * (TITLE_WEIGHT * F.size(in_title) + F.size(in_abstract)), F.array_distinct(found)


def _listed(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(t.lower().split()) for t in terms if t.strip()))


def _plains(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(_plain(t) for t in terms if t.strip()))


def _among(terms: Sequence[str], found: Column) -> Column:
    """Which of the terms were found, in the terms' order."""
    return F.array_intersect(F.array(*map(F.lit, terms)), found) if terms else F.array().cast("array<string>")


def _any_among(terms: Sequence[str], found: Column) -> Column:
    return F.arrays_overlap(F.array(*map(F.lit, terms)), found) if terms else F.lit(False)


def _field_score(terms: Sequence[str], base: float, title: Column, abstract: Column) -> tuple[Column, Column]:
    """(score, matches ``field:term``) of terms from the terms found in either field; the title weighs more."""
    terms = _listed(terms)
    if not terms:
        return F.lit(0.0), F.array().cast("array<string>")
    own_title, own_abstract = _among(terms, title), _among(terms, abstract)
    named = F.flatten(F.transform(_among(terms, F.concat(own_title, own_abstract)), lambda t: F.array_compact(F.array(F.when(F.array_contains(own_title, t), F.concat(F.lit("title:"), t)), F.when(F.array_contains(own_abstract, t), F.concat(F.lit("abstract:"), t))))))
    return base * (TITLE_WEIGHT * F.size(own_title) + F.size(own_abstract)), named


def topic_score(t: Topic, found: Column, place: int) -> Column:
    """struct(minus, place, label, score, matches, combos) of a topic, from the terms found (``score_topics``)."""
    title, abstract, both = found["title"], found["abstract"], found["both"]
    seed, seen = _field_score(t.seeds, SEED, title, abstract)
    context, in_context = _field_score(t.context_terms, CONTEXT, title, abstract)
    anchors = _among(_plains(t.context_anchors), both) if t.context_anchors else None
    counts = (F.size(in_context) > 0) if anchors is None else (F.size(in_context) > 0) & (F.size(anchors) > 0)
    none = F.array().cast("array<string>")
    bonus = context if anchors is None else context + t.context_bonus
    named = none if anchors is None else F.transform(F.slice(anchors, 1, 3), lambda a: F.concat(F.lit("anchor:"), a))
    combos = [[_plain(x) for x in c if x.strip()] for c in t.combos]
    combo = F.array_compact(F.array(*(F.when(F.size(_among(_plains(c), both)) == len(set(c)) if c else F.lit(False), F.lit("+".join(c))) for c in combos))) if combos else none
    out = _among(_plains(t.excludes), both)
    parts = [seed, F.when(counts, bonus).otherwise(0.0), COMBO * F.size(combo), -EXCLUDE * F.size(out)]
    marks = [seen, F.when(counts, F.concat(in_context, named)).otherwise(none), F.transform(combo, lambda c: F.concat(F.lit("combo:"), c)), F.transform(out, lambda x: F.concat(F.lit("exclude:"), x))]
    if t.anchor_penalty is not None and t.anchors:
        missing = ~_any_among(_plains(t.anchors), both)
        parts.append(-F.when(missing, t.anchor_penalty).otherwise(0.0))
        marks.append(F.when(missing, F.array(F.lit("penalty:missing_anchor"))).otherwise(none))
    if t.renewal_penalty is not None:
        parts.append(-F.when(found["renewal"], t.renewal_penalty).otherwise(0.0))
        marks.append(F.when(found["renewal"], F.array(F.lit("penalty:renewal_anchor_present"))).otherwise(none))
    total = F.aggregate(F.array(*(x.cast("double") for x in parts)), F.lit(0.0), lambda a, x: a + x)
    return text.bind(F.round(total, 4), lambda score: F.struct((-score).alias("minus"), F.lit(place).alias("place"), F.lit(t.label).alias("label"), score.alias("score"), F.array_distinct(F.concat(*marks)).alias("matches"), combo.alias("combos")))


def fields(df: DataFrame, title: str = "title", abstract: str = "abstract", index: qgrams.Index | None = None) -> DataFrame:
    """Adds the plain texts that the stages look up in: _t, _a, _both (title and abstract, empty ones left out), _sep.

    With an ``index`` (``everything``), _cand too: the terms that the whole text may
    contain, which all stages then verify instead of looking for every term.
    """
    out = df.withColumns({"_t": text.plain(title), "_a": text.plain(abstract)})
    out = out.withColumns({"_both": F.concat_ws(" ", F.when(F.col("_t") != "", F.col("_t")), F.when(F.col("_a") != "", F.col("_a"))), "_sep": F.replace(text.phrase(text.joined([title, abstract])), F.lit("-"), F.lit(" "))})
    if index is None:
        return out
    whole = text.plain(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    return out.withColumn("_cand", text.seal(index.candidates(F.concat_ws("\n", "_both", F.when(whole != F.col("_both"), whole)))))


def _in_fields(taxonomy: Taxonomy) -> list[str]:
    return _listed([x for t in taxonomy.topics for x in (*t.seeds, *t.context_terms)])


def _in_both(taxonomy: Taxonomy) -> list[str]:
    return _plains([x for t in taxonomy.topics for x in (*t.context_anchors, *(y for c in t.combos for y in c), *t.excludes, *t.anchors)])


_RENEWAL = (P.COMMON_ANCHORS, P.EXISTING_OBJECTS, P.PENALTY_MECHANISMS)


def score_topics(df: DataFrame, taxonomy: Taxonomy, column: str = "topics") -> DataFrame:
    """Adds all topics' scores, best first (ties: the taxonomy's order). Needs ``fields``.

    Every term of the whole lexicon is looked up once in each text, however many
    topics share it; topics are scored from the terms found, so the plan holds
    each normalised text once and grows with the lexicon only by its literals.
    """
    topics = taxonomy.topics
    in_fields, in_both = _in_fields(taxonomy), _in_both(taxonomy)
    penal = any(t.renewal_penalty is not None for t in topics)
    both = looked_up(df, F.col("_both"), [*in_both, *(p for x in _RENEWAL for p in _plains(x))] if penal else in_both)
    df = df.withColumn("_in_both", text.seal(both))
    renewal = any_of(F.col("_in_both"), P.COMMON_ANCHORS) & (any_of(F.col("_in_both"), P.EXISTING_OBJECTS) | any_of(F.col("_in_both"), P.PENALTY_MECHANISMS)) if penal else F.lit(False)
    found = F.struct(looked_up(df, F.col("_t"), in_fields).alias("title"), looked_up(df, F.col("_a"), in_fields).alias("abstract"), F.col("_in_both").alias("both"), renewal.alias("renewal"))
    df = df.withColumn("_found", text.seal(found))
    return df.withColumn(column, F.array_sort(F.array(*(topic_score(t, F.col("_found"), i) for i, t in enumerate(topics))))).drop("_found", "_in_both")


KINDS = ("seed", "context", "anchor", "exclude")


#: Words whose terms a task remembers.
_REMEMBERED = 1 << 17


def _in_words(terms: Sequence[str], schema: pa.Schema):
    """(key, term, in_title, in_abstract) of a task's (key, title, abstract) rows, for terms without a space: those lie within words.

    A word's terms are its substrings of the terms' lengths that are terms. They are worked out when a word first comes up.
    """
    place = {t: i for i, t in enumerate(terms)}
    lengths = sorted({len(t) for t in terms})
    names = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}

        def found(words: set[str]) -> set[int]:
            out: set[int] = set()
            for w in words:
                got = known.get(w)
                if got is None:
                    got = frozenset(place[x] for n in lengths if n <= len(w) for x in {w[i : i + n] for i in range(len(w) - n + 1)} if x in place)
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[w] = got
                out |= got
            return out

        for b in batches:
            row, term, in_title, in_abstract = [], [], [], []
            for k, (title, abstract) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                t, a = found(set(title.split(" "))), found(set(abstract.split(" ")))
                both = sorted(t | a)
                row += [k] * len(both)
                term += both
                in_title += [x in t for x in both]
                in_abstract += [x in a for x in both]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), names.take(pa.array(term, pa.int32())), pa.array(in_title, pa.bool_()), pa.array(in_abstract, pa.bool_())], schema=schema)

    return run


def table_hits(df: DataFrame, key: str, lexicon: DataFrame, most: int = 1 << 17) -> DataFrame:
    """(key, term, in_title, in_abstract) of a lexicon table's terms in each text. Needs ``fields``.

    A term may also lie across the border of title and abstract, and then is in neither.
    Terms without a space are looked for within the row, word by word, if they have been counted and
    are ``most`` at most, so that texts aren't shuffled; all others by a join of q-grams.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    terms = lexicon.select("term").where(F.length("term") > 0).distinct()
    spaced = F.contains("term", F.lit(" "))
    single = [r[0] for r in terms.where(~spaced).limit(most + 1).collect()]
    inside = None
    if single and len(single) <= most:
        schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string("term string, in_title boolean, in_abstract boolean").fields])
        inside = df.select(key, "_t", "_a").mapInArrow(_in_words(sorted(single), to_arrow_schema(schema)), schema)
        terms = terms.where(spaced)
        if terms.isEmpty():
            return inside
    found = qgrams.join_terms(df, key, "_both", terms, also=("_t", "_a"))
    one = lambda t: F.struct(t.alias("term"), F.contains("_t", t).alias("in_title"), F.contains("_a", t).alias("in_abstract"))
    joined = found.select(key, F.explode(F.transform("terms", one)).alias("_x")).select(key, "_x.*")
    return joined if inside is None else inside.unionByName(joined)


def table_scores(hits_: DataFrame, key: str, lexicon: DataFrame, bonus: float = 1.5, most: int = qgrams.SENT) -> DataFrame:
    """(key, topic, score) of the topics that a text has terms of, by a lexicon table (topic, kind, term).

    The same weights as ``score_topics``: context terms count if the topic has no
    anchors, or one occurs, which adds ``bonus``. Counts are combined by text and
    topic before they are shuffled. The lexicon is sent to all tasks only if it
    has been counted and has ``most`` rows at most.
    """
    anchored = lexicon.where("kind = 'anchor'").select("topic").distinct().withColumn("has_anchors", F.lit(True))
    terms = lexicon.select("topic", "kind", "term").distinct().join(anchored, "topic", "left")
    if terms.limit(most + 1).count() <= most:
        terms = F.broadcast(terms)
    joined = hits_.join(terms, "term")
    n = lambda kind, place: F.count_if((F.col("kind") == kind) & F.col(place))
    some = lambda kind: F.count_if(F.col("kind") == kind)
    counts = joined.groupBy(key, "topic").agg(*(n(k, p).alias(f"{k}_{p}") for k in ("seed", "context") for p in ("in_title", "in_abstract")), some("anchor").alias("anchors"), some("exclude").alias("excludes"), F.max("has_anchors").alias("has_anchors"))
    weigh = lambda k, base: base * (TITLE_WEIGHT * F.col(f"{k}_in_title") + F.col(f"{k}_in_abstract"))
    any_context = F.col("context_in_title") + F.col("context_in_abstract") > 0
    context = F.when(any_context & F.col("has_anchors").isNull(), weigh("context", CONTEXT)).when(any_context & (F.col("anchors") > 0), weigh("context", CONTEXT) + bonus).otherwise(0.0)
    return counts.select(key, "topic", F.round(weigh("seed", SEED) + context - EXCLUDE * F.col("excludes"), 4).alias("score"))


def table_best(scores: DataFrame, key: str) -> DataFrame:
    """(key, topic, score, margin): the best topic of each text with a positive score, and its lead over the next one (ties: by name)."""
    two = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "topic")).alias("b"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    second = F.greatest(F.coalesce(F.try_element_at("s", F.lit(2)), F.lit(0.0)), F.lit(0.0))
    return two.where("b.minus < 0").select(key, F.col("b.topic").alias("topic"), (-F.col("b.minus")).alias("score"), F.round(-F.col("b.minus") - second, 4).alias("margin"))


#: Lists that the first stage looks for, and all that the rules do.
STAGE_LISTS = (P.BACKGROUND, P.MEDIA, P.GREENFIELD, P.METHOD, P.MATERIALS, P.WORDING, P.GENERAL_METHOD, P.GOVERNANCE, P.RURAL, P.MISUSE_MATH, P.MISUSE_TRIGGER, P.EXISTING_OBJECTS, P.MECHANISMS)
SIGNAL_LISTS = (P.CORE_ANCHORS, P.COMMON_ANCHORS, P.EXISTING_OBJECTS, P.MECHANISMS, P.CONTEXT, P.NEGATIONS, P.ACTIONS, P.BUILT, P.POLICY)
RULE_LISTS = (*STAGE_LISTS, *SIGNAL_LISTS, *_RENEWAL)


def ranked(label: Column, score: Column) -> Column:
    return F.format_string("%s:%.2f", label, score)


def first_stage(df: DataFrame) -> DataFrame:
    """Adds ``rule``, the first stage's finding, from ``topics``. Needs ``fields`` and ``score_topics``.

    Misuse of the wording in mathematics, and rural matters, are hard negatives.
    Explicit wording about another object overrides the topic; else the best
    topic counts, with its margin to the next.
    """
    df = df.withColumn("_fs", text.seal(looked_up(df, F.col("_sep"), [p for x in STAGE_LISTS for p in _plains(x)])))
    t = F.col("_fs")
    found = {n: hits_among(t, getattr(P, n.upper())) for n in ("background", "media", "greenfield", "method", "materials", "wording", "general_method", "governance", "rural", "misuse_math", "misuse_trigger")}
    some = {n: F.size(F.col(f"_h.{n}")) > 0 for n in found}
    df = df.withColumn("_h", text.seal(F.struct(*(c.alias(n) for n, c in found.items())))).withColumn("_obj", any_of(t, P.EXISTING_OBJECTS) | any_of(t, P.MECHANISMS)).drop("_fs")
    best, second = F.col("topics")[0], F.try_element_at("topics", F.lit(2))
    margin = F.round(F.greatest(best["score"] - F.coalesce(second["score"], F.lit(0.0)), F.lit(0.0)), 4)
    other = some["wording"] & ~F.col("_obj") & (some["background"] | some["media"])
    topic = F.when(other & some["general_method"], "N8").when(other & some["governance"], "N3")
    df = df.withColumns({"_best": best, "_margin": margin, "_other": topic})
    best, margin, other = F.col("_best"), F.col("_margin"), F.col("_other").isNotNull()
    strong = (((best["score"] >= 6) & (margin >= 3)) | ((best["score"] >= 5) & (F.size(best["combos"]) > 0))) & (best["score"] >= 4) & (margin >= 2)
    top3 = F.transform(F.slice("topics", 1, 3), lambda x: ranked(x["label"], x["score"]))
    over3 = F.concat(F.array(F.concat("_other", F.lit(":6.40"))), F.slice(F.filter(top3, lambda x: F.substring_index(x, ":", 1) != F.col("_other")), 1, 2))
    label = F.coalesce("_other", F.when(best["score"] <= 0, cells.UNKNOWN).otherwise(best["label"]))
    extra = F.when(F.col("_other") == "N8", F.concat("_h.background", "_h.wording", "_h.general_method")).otherwise(F.concat("_h.background", "_h.media", "_h.wording", "_h.governance"))
    risks = F.array_sort(F.array_compact(F.array(F.when(some["background"], P.BACKGROUND_RISK), F.when(some["media"], P.MEDIA_RISK), F.when(other, P.OTHER_OBJECT_RISK), F.when(some["greenfield"], P.GREENFIELD_RISK), F.when(some["method"] | some["materials"], P.TECHNICAL_RISK))))
    df = df.withColumn("_s", text.seal(F.struct(label.alias("label"), F.when(other, 6.4).otherwise(best["score"]).alias("score"), F.when(other, 3.0).otherwise(margin).alias("margin"), F.when(other, over3).otherwise(top3).alias("top3"), F.when(other, F.array_distinct(F.concat(extra, best["matches"]))).otherwise(best["matches"]).alias("matches"), (other | strong).alias("strong"))))
    s = F.col("_s")
    group = lambda i: cells.family(F.substring_index(F.try_element_at(s["top3"], F.lit(i)), ":", 1))
    conflict = F.when((F.size(s["top3"]) >= 2) & (group(1) != group(2)), 1).otherwise(0)
    review = F.when(s["label"] == cells.UNKNOWN, "rule_unknown").when(conflict == 1, "rule_group_conflict").when(s["margin"] < 2, "rule_low_margin").when(s["score"] < 4, "rule_low_score").otherwise("")
    reason = (
        F.when(F.col("_other") == "N8", "explicit_renewal_wording_but_other_object_method").when(F.col("_other") == "N3", "explicit_renewal_wording_but_other_object_governance").when(s["strong"], F.concat(F.lit("rule_topic_"), F.lower(s["label"])))
        .when(some["greenfield"] & (s["label"] == "N2"), "greenfield_expansion_signal").when(some["method"] & (s["label"] == "N8"), "method_signal").when(some["materials"] & (s["label"] == "N10"), "environment_signal").otherwise("uncertain_pass")
    )

    def out(route, reason_, label_, score, margin_, top, matches, signals, risk, conf, strong_, review_):
        return F.struct(
            F.lit(route).alias("route"), reason_.alias("reason"), label_.alias("label"), cells.family(label_).alias("group"), score.alias("score"), margin_.alias("margin"), top.alias("top3"), matches.alias("matches"), signals.alias("signals"), risk.alias("risk_tags"), conf.alias("conflict"), strong_.alias("strong"),
            (review_ != "").cast("int").alias("review_flag"), review_.alias("review_reason"),
        )

    def hard(reason_, label_, marks):
        return out("hard_negative", F.lit(reason_), F.lit(label_), F.lit(9.0), F.lit(9.0), F.array(F.lit(f"{label_}:9.00")), marks, marks, F.array().cast("array<string>"), F.lit(0), F.lit(True), F.lit(""))

    signals = F.concat(s["matches"], "_h.greenfield", "_h.method", "_h.materials")
    rule = (
        F.when(some["misuse_trigger"] & some["misuse_math"], hard("math_term_misuse", "N8", F.concat("_h.misuse_trigger", "_h.misuse_math")))
        .when(some["rural"], hard("rural_nonurban", "N9", F.col("_h.rural")))
        .otherwise(out("uncertain", reason, s["label"], s["score"], s["margin"], s["top3"], s["matches"], signals, risks, conflict, s["strong"], review))
    )
    return df.withColumn("rule", text.seal(rule)).drop("_h", "_obj", "_best", "_margin", "_other", "_s")


def metadata_audit(df: DataFrame, categories: str, areas: str, keywords: str) -> DataFrame:
    """Adds which domains and keywords of a record are on the lists; they are for the record only and decide nothing."""
    on = lambda arr, names: F.array_sort(F.array_intersect(arr, F.array(*(F.lit(n) for n in names))))
    d = text.domains(categories, areas)
    return df.withColumns({"negative_domains": on(d, P.NEGATIVE_DOMAINS), "negative_keywords": on(text.keyword_list(keywords), P.NEGATIVE_KEYWORDS), "related_domains": on(d, P.RELATED_DOMAINS)})
