"""Labels and attributes out of a language model's answers, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.text import _c, bind, strip

#: What an answer looks like when it says so (fixed values).
ANSWER_PATTERNS = (
    r"(?i)(?:最终答案|最终结论|答案|结论)\s*[:：是为]?\s*([01])\b",
    r'(?i)"?(?:是否属于城市更新研究|is_urban_renewal)"?\s*[:=]\s*"?([01])"?',
)
_STEP, _LONE, _YES = r"(?i)(Step|Field|Phase)\s*\d+", r"(?<!\d)(1|0)(?!\d)", r"(?i)\b(yes|true)\b"


def _found(text: Column, pattern: str) -> Column:
    out = F.regexp_extract(text, pattern, 1)
    return F.when(out != "", out)


def answer(c: Column | str, patterns: Sequence[str] = ANSWER_PATTERNS) -> Column:
    """struct(label, reason) of an answer: an explicit statement, a line that is a digit, the first lone digit, yes or true; else 0."""
    raw = strip(F.coalesce(_c(c), F.lit("")))
    clean = F.regexp_replace(raw, _STEP, "")
    say = lambda label, reason: F.struct(label.alias("label"), F.lit(reason).alias("reason"))
    explicit = F.coalesce(*(_found(raw, p) for p in patterns)) if patterns else F.lit(None).cast("string")
    line, lone = _found(clean, r"(?m)^\s*([01])\s*$"), _found(clean, _LONE)
    return (
        F.when(raw == "", say(F.lit("0"), "empty_text"))
        .when(explicit.isNotNull(), say(explicit, "explicit_answer_pattern"))
        .when(line.isNotNull(), say(line, "single_digit_line"))
        .when(lone.isNotNull(), say(lone, "fallback_first_digit"))
        .when(F.rlike(raw, F.lit(_YES)), say(F.lit("1"), "fallback_boolean_yes"))
        .otherwise(say(F.lit("0"), "no_label_detected"))
    )


def simple_answer(c: Column | str) -> Column:
    """1 or 0: the first lone digit, else 1 for yes or true, else 0."""
    raw = strip(F.coalesce(_c(c), F.lit("")))
    lone = _found(F.regexp_replace(raw, _STEP, ""), _LONE)
    return F.coalesce(lone, F.when(F.rlike(raw, F.lit(_YES)), "1").otherwise("0"))


def first_line(c: Column | str) -> Column:
    """The first line that isn't blank, trimmed; empty if there is none."""
    lines = F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"\r\n|\r|\n"), lambda x: strip(x) != "")
    return F.coalesce(strip(F.try_element_at(lines, F.lit(1))), F.lit(""))


def last_tabbed_line(c: Column | str) -> Column:
    """The last line that holds a tab; the whole text if none does."""
    text = F.coalesce(_c(c), F.lit(""))
    return F.coalesce(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("\t"))), F.lit(-1)), text)


def tabbed(c: Column | str) -> Column:
    """struct(target, spatial, level, area) of the first line's four tab-separated fields; null if there are fewer."""
    p = F.transform(F.split(first_line(c), "\t"), strip)
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.when(F.size(p) >= 4, F.struct(simple_answer(at(1)).alias("target"), simple_answer(at(2)).alias("spatial"), at(3).alias("level"), at(4).alias("area")))


def two_fields(c: Column | str) -> Column:
    """struct(level, area) of the first line's two fields; null if there are fewer."""
    p = F.transform(F.split(first_line(c), "\t"), strip)
    return F.when(F.size(p) >= 2, F.struct(F.try_element_at(p, F.lit(1)).alias("level"), F.try_element_at(p, F.lit(2)).alias("area")))


#: Canonical levels (fixed values).
SCALES = (
    "1. Global Scale", "2. Multi-national / Continental Scale", "3. National / Single-country Scale", "4. Multi-provincial / Sub-national Regional Scale", "5. Single-provincial / State Scale", "6. Multi-city / Megaregion Scale", "7. Single-city / Municipal Scale",
    "8. District / County Scale", "9. Micro / Neighborhood / Block Scale",
)
#: Countries and regions with the words that imply them (fixed values).
COUNTRIES = {
    "united kingdom": ("united kingdom", "u.k.", "uk", "british", "england", "scotland", "wales"),
    "united states": ("united states", "u.s.", "american", "federal"),
    "china": ("china", "chinese", "prc"),
    "european union": ("european union", "e.u.", "eu", "european commission", "european"),
    "hong kong": ("hong kong", "hksar"),
}
POLICY_WORDS = r"(?i)\b(government|ministry|department|agency|authority|commission|policy|plan|planning|programme|program|act|law|regulation|national|federal)\b"
BOUNDARY_WORDS = r"\b(city|site|case study|study area|urban area|project area|municipality|neighbou?rhood|district|block|corridor|development)\b"
#: Capitalised words that name no place (fixed values).
NO_ANCHOR = (
    "a", "an", "the", "selected", "local", "urban", "brownfield", "ecologically", "sensitive", "contentious", "case", "study", "city", "site", "area", "municipality", "neighborhood", "neighbourhood", "district", "block", "corridor", "development", "project",
)
EMPTY_AREAS = ("", "null", "none", "n/a", "na", "nan", "not mentioned", "not specified", "unspecified", "unknown")
TRUTHY, FALSY = ("true", "1", "1.0", "yes", "y", "spatial"), ("false", "0", "0.0", "no", "n", "non-spatial", "nonspatial", "")
NOT_MENTIONED = "Not mentioned"


def is_spatial(c: Column | str) -> Column:
    t = F.lower(F.regexp_replace(strip(F.coalesce(_c(c).cast("string"), F.lit(""))), "^[\"']+|[\"']+$", ""))
    return t.isin(*TRUTHY) | (F.coalesce(t.try_cast("double"), F.lit(0.0)) != 0) & ~F.isnan(F.coalesce(t.try_cast("double"), F.lit(0.0)))


def matched(c: Column | str) -> Column:
    """Text to look up in: curly quotes as straight ones, white space collapsed, trimmed, lower case."""
    t = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), "[‘’“”]", "'")
    return F.lower(strip(F.regexp_replace(t, r"\s+", " ")))


def trimmed(c: Column, marks: str = " .;:") -> Column:
    return F.btrim(c, F.lit(marks))


def clean_area(c: Column | str, default: str = NOT_MENTIONED) -> Column:
    return bind(strip(F.coalesce(_c(c).cast("string"), F.lit(""))), lambda t: F.when(trimmed(F.lower(t)).isin(*EMPTY_AREAS), default).otherwise(t))


def without_implicit(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?i)\([^)]*\bimplicit\b[^)]*\)", "")
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"(?i)\bimplicit(?:ly)?\b", ""), r"\s+", " "), " .;:,")


def has_anchor(c: Column) -> Column:
    """A capitalised word that may name a place."""
    return F.exists(F.regexp_extract_all(c, F.lit(r"\b[A-Z][A-Za-z-]+\b"), 0), lambda t: ~F.lower(t).isin(*NO_ANCHOR))


def is_generic(c: Column) -> Column:
    """A boundary noun and nothing that names a place."""
    return F.rlike(trimmed(matched(c)), F.lit(BOUNDARY_WORDS)) & ~has_anchor(c)


def is_placeholder(c: Column, terms: Sequence[str] = (), implicit_terms: Sequence[str] = ()) -> Column:


    def known(n: Column) -> Column:
        out = n.isin(*EMPTY_AREAS)
        for t in terms:
            out = out | F.contains(n, F.lit(t))
        for t in implicit_terms:
            out = out | (F.contains(n, F.lit("implicit")) & F.contains(n, F.lit(t)))
        return out

    return c.isNull() | bind(trimmed(matched(F.regexp_replace(c, "^[\"']+|[\"']+$", ""))), known) | is_generic(c)


def scale(c: Column | str) -> Column:
    """The canonical level of a text that begins with its digit or has its name; null if none."""


    def named(n: Column) -> Column:
        digit = F.regexp_extract(n, r"^([1-9])(?:\.|\b)", 1)
        out = F.when(digit != "", F.try_element_at(F.array(*(F.lit(s) for s in SCALES)), F.coalesce(digit.try_cast("int"), F.lit(1))))
        for s in SCALES:
            out = out.when(F.contains(n, F.lit(s.split(".", 1)[1].strip().lower())), s)
        return F.when(n != "", out)

    return bind(matched(clean_area(c, "")), named)


def scale_number(c: Column) -> Column:
    return F.regexp_extract(strip(F.coalesce(c, F.lit(""))), r"^([1-9])\.", 1).try_cast("int")


def core_area(c: Column) -> Column:
    return trimmed(matched(without_implicit(c)), " .;:,")


def is_country(c: Column) -> Column:
    return core_area(c).isin(*COUNTRIES)


def scale_mismatch(area: Column, level: Column) -> Column:
    """An area too large for its level: implied or a country at 6 or above, the world at anything but 1."""
    wrong = lambda x: x["n"].isNull() | (F.contains(x["m"], F.lit("implicit")) & (x["n"] >= 6)) | (x["country"] & (x["n"] >= 6)) | (x["m"].isin("global", "world", "worldwide") & (x["n"] != 1))
    return bind(F.struct(scale_number(level).alias("n"), matched(area).alias("m"), is_country(area).alias("country")), wrong)


def fragments(area: Column) -> Column:
    core = F.regexp_replace(without_implicit(area), r"(?i)\b(?:in|within|of)\b", ",")
    return F.filter(F.transform(F.split(core, r"(?i)\s*(?:,|;|/|&|\band\b)\s*"), lambda x: trimmed(x, " .;:,")), lambda x: x != "")


def implied_country(area: Column, source: Column) -> Column:
    """The first word of the source that implies the area's country, if the source also speaks of policy; else null."""
    table = F.create_map(*(x for name, words in COUNTRIES.items() for x in (F.lit(name), F.array(*(F.lit(w) for w in words)))))
    first = F.try_element_at(F.filter(F.try_element_at(table, core_area(area)), lambda w: F.contains(source, w)), F.lit(1))
    return F.when(F.rlike(source, F.lit(POLICY_WORDS)), first)


def support(area: Column, title: Column | str, abstract: Column | str) -> Column:
    """struct(ok, reason, evidence): does the title or abstract bear the area out?"""
    say = lambda ok, reason, evidence: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"), evidence.alias("evidence"))

    def judged(x: Column) -> Column:
        source, core, parts, named, implied = (x[n] for n in ("source", "core", "parts", "named", "implied"))
        return (
            F.when(source == "", say(False, "missing_source_text", F.lit("")))
            .when((named != "") & F.contains(source, named), say(True, "explicit_area_evidence", core))
            .when((F.size(parts) >= 2) & F.forall(parts, lambda p: F.contains(source, matched(p))), say(True, "explicit_area_fragment_evidence", F.array_join(parts, "; ")))
            .when(F.contains(matched(area), F.lit("implicit")) & implied.isNotNull(), say(True, "implicit_country_region_evidence", F.coalesce(implied, F.lit(""))))
            .otherwise(say(False, "area_not_supported_by_title_or_abstract", core))
        )

    def found(x: Column) -> Column:
        source, core = x["source"], x["core"]
        return bind(F.struct(source.alias("source"), core.alias("core"), fragments(core).alias("parts"), trimmed(matched(core)).alias("named"), implied_country(area, source).alias("implied")), judged)

    whole = matched(strip(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(abstract), F.lit("")))))
    return bind(F.struct(whole.alias("source"), without_implicit(area).alias("core")), found)


def spatial(c: Column | str, title: Column | str, abstract: Column | str) -> Column:
    """The attributes of the first JSON object in an answer, checked against the source text.

    struct(is_spatial, level, area, reasoning, confidence, status, reason,
    evidence). Text before and after the object is passed over; an answer
    without an object, or with a broken one, is not spatial.
    """
    text = F.coalesce(_c(c), F.lit(""))
    start = F.locate("{", text)
    schema = "Reasoning string, Is_Spatial_Research string, Spatial_Scale_Level string, Specific_Study_Area string, Confidence string"
    data = F.from_json(F.when(start > 0, F.substring(text, start, F.length(text))), schema)

    def judged(x: Column) -> Column:
        data, area, level, proof = (x[n] for n in ("data", "area", "level", "proof"))

        def say(status, reason, evidence, accepted=False):
            return F.struct(
                F.lit("1" if accepted else "0").alias("is_spatial"), (level if accepted else F.lit(NOT_MENTIONED)).alias("level"), (area if accepted else F.lit(NOT_MENTIONED)).alias("area"), F.coalesce(data["Reasoning"], F.lit("")).alias("reasoning"),
                F.coalesce(data["Confidence"], F.lit("Low")).alias("confidence"), F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), evidence.alias("evidence"),
            )

        broken = data.isNull() | F.coalesce(data["Is_Spatial_Research"], data["Spatial_Scale_Level"], data["Specific_Study_Area"], data["Reasoning"], data["Confidence"]).isNull()
        return (
            F.when(broken, say("not_spatial", "default_non_spatial", F.lit("")))
            .when(~is_spatial(data["Is_Spatial_Research"]), say("not_spatial", "model_non_spatial", F.lit("")))
            .when(is_placeholder(area), say("rejected", "placeholder_or_generic_area", area))
            .when(level.isNull(), say("rejected", "missing_or_invalid_scale", area))
            .when(scale_mismatch(area, level), say("rejected", "scale_area_mismatch", area))
            .when(~proof["ok"], say("rejected", proof["reason"], F.when(proof["evidence"] != "", proof["evidence"]).otherwise(area)))
            .otherwise(say("accepted", proof["reason"], proof["evidence"], True))
        )

    # each value is computed once for a row, and the plan has it once
    def proved(x: Column) -> Column:
        return bind(F.struct(x["data"].alias("data"), x["area"].alias("area"), x["level"].alias("level"), support(x["area"], title, abstract).alias("proof")), judged)

    def cleaned(d: Column) -> Column:
        return bind(F.struct(d.alias("data"), clean_area(d["Specific_Study_Area"]).alias("area"), scale(d["Spatial_Scale_Level"]).alias("level")), proved)

    return bind(data, cleaned)
