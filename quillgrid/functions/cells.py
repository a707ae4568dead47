"""Predicates and conversions of loosely typed cells: presence, flags, labels, levels.

Columns come as strings, numbers or both; each function takes a Column (or a
name) and gives a Column, without Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.text import bind, strip

#: Texts that stand for a missing cell, lower-cased (fixed values).
MISSING = ("", "nan", "none", "null")
NO_CLUSTER = (*MISSING, "-1", "-1.0")
UNKNOWN, OPEN_IN, OPEN_OUT = "Unknown", "Urban_Renewal_Other", "Nonurban_Other"
IN, OUT, NEITHER = "urban", "nonurban", "unknown"
#: The topic labels in order: 15 of the family in scope, 10 of the other.
TOPICS = (*(f"U{i}" for i in range(1, 16)), *(f"N{i}" for i in range(1, 11)))
FAMILIES = {**{t: IN if t[0] == "U" else OUT for t in TOPICS}, OPEN_IN: IN, OPEN_OUT: OUT}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """A cell as trimmed text; null as empty."""
    return strip(F.coalesce(col(c).cast("string"), F.lit("")))


def is_present(c: Column | str) -> Column:
    return ~F.lower(text_of(c)).isin(*MISSING)


def is_cluster(c: Column | str) -> Column:
    """Presence where -1 stands for no cluster, too."""
    return ~F.lower(text_of(c)).isin(*NO_CLUSTER)


def flag_number(c: Column | str) -> Column:
    """A number's whole part; 0 for anything that isn't a number."""
    return F.coalesce(col(c).cast("string").try_cast("double"), F.lit(0.0)).cast("int")


def binary(c: Column | str) -> Column:
    """1, 0, or -1 for everything else; every ".0" is dropped first, so "1.00" is -1."""
    t = F.regexp_replace(text_of(c), r"\.0", "")
    return F.when(t == "1", 1).when(t == "0", 0).otherwise(-1)


def decided(c: Column | str) -> Column:
    """1, 0, or null: the whole part of whatever is a number, if it is one of these."""
    n = F.floor(F.abs(text_of(c).try_cast("double"))) * F.signum(text_of(c).try_cast("double"))
    return F.when(n == 0, 0).when(n == 1, 1).cast("int")


def binary_text(c: Column | str) -> Column:
    """ "1", "0" or ""; null-safe."""
    t = F.regexp_replace(text_of(c), r"\.0", "")
    return F.when(t.isin("0", "1"), t).otherwise("")


def spatial_flag(c: Column | str) -> Column:
    t = F.lower(text_of(c))
    return F.when(t.isin("1", "1.0", "true", "spatial"), "Spatial").when(t.isin("0", "0.0", "false", "non-spatial", "nonspatial", ""), "Non-spatial").otherwise(t)


#: Level by an ordered list of words that a text may contain (fixed values).
LEVEL_WORDS = (
    (1, ("global", "world", "worldwide", "world-wide")),
    (2, ("multi-country", "cross-border", "continental", "eu ", "asean", "european union")),
    (3, ("country", "nation", "national")),
    (4, ("multi-provincial", "multi-state", "region", "regional")),
    (5, ("provincial", "state", "province")),
    (6, ("multi-city", "megaregion", "urban agglomeration", "bay area", "greater bay")),
    (7, ("single city", "municipal", "city-wide")),
    (8, ("district", "county", "neighborhood")),
    (9, ("micro", "neighborhood", "block", "street", "grid", "community")),
)
#: Level by the whole text (fixed values).
LEVEL_NAMES = {
    "全球": 1, "洲际": 2, "跨国": 2, "多国": 2, "多国/多地区": 2, "全国": 3, "地区": 3, "国家": 3, "全国/地区": 3, "多省": 4, "多州": 4, "省/州": 5, "全省/全州": 4, "多省/州": 4, "省": 5,
    "州": 5, "多城市": 6, "城市群": 6, "单城市": 7, "全城市": 7, "市": 7, "区": 8, "县": 8, "街道": 8, "社区": 8, "单街区": 8, "多街区": 8, "微观": 9, "邻里": 9,
}


def level(c: Column | str) -> Column:
    """Level 1 to 9 of a text: by its whole, by words it contains, by a digit that stands alone; else -1."""
    t = strip(F.coalesce(col(c).cast("string"), F.lit("nan")))
    names = F.create_map(*(F.lit(x) for kv in LEVEL_NAMES.items() for x in kv))
    out = F.try_element_at(names, t)
    low = F.lower(t)
    worded = F.when(F.lit(False), -1)
    for n, words in LEVEL_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        worded = worded.when(hit, n)
    digit = F.regexp_extract(t, r"(?U)\b([1-9])\b", 1)
    return F.coalesce(out, worded, digit.try_cast("int"), F.lit(-1)).cast("int")


def description(c: Column | str) -> Column:
    """Lower case, anything but word characters and white space as spaces, white space collapsed."""
    t = F.lower(strip(F.coalesce(col(c).cast("string"), F.lit("nan"))))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")


def same_level(a: Column | str, b: Column | str) -> Column:
    """Equal levels; if either has none, equal texts but for case."""
    x, y = level(a), level(b)
    plain = lambda c: F.lower(strip(F.coalesce(col(c).cast("string"), F.lit("nan"))))
    return F.when((x == -1) | (y == -1), plain(a) == plain(b)).otherwise(x == y)


def same_description(a: Column | str, b: Column | str, least: float = 0.6) -> Column:
    """Jaccard similarity of the words of at least ``least``; "not mentioned", and texts without words, must be equal."""
    x, y = description(a), description(b)
    wx, wy = (F.array_distinct(F.filter(F.split(t, " "), lambda w: w != "")) for t in (x, y))
    share = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(F.array_union(wx, wy)), F.lit(1))
    return F.when((x == "not mentioned") | (y == "not mentioned") | (F.size(wx) == 0) | (F.size(wy) == 0), x == y).otherwise(share >= least)


def topic(c: Column | str) -> Column:
    """A topic label as it is written: "" if missing, Unknown in any case, U and N labels in upper case."""
    return bind(text_of(c), lambda t: F.when(F.lower(t).isin(*MISSING), "").when(F.lower(t) == UNKNOWN.lower(), UNKNOWN).when(F.rlike(t, F.lit("^[UuNn][0-9]+$")), F.upper(t)).otherwise(t))


def family(c: Column | str) -> Column:
    """The family of a topic label: urban, nonurban, unknown, or "" for a missing label."""
    known = F.create_map(*(F.lit(x) for kv in {**FAMILIES, UNKNOWN: NEITHER, "": ""}.items() for x in kv))
    at = lambda t: F.try_element_at(known, t)
    return F.coalesce(at(col(c).cast("string")), bind(topic(c), lambda t: F.coalesce(at(t), F.lit(NEITHER))))  # most labels are as they should be


def family_of_group(c: Column | str) -> Column:
    t = F.lower(text_of(c))
    return F.when(t.isin(IN, OUT), t).otherwise(NEITHER)


def is_topic(c: Column | str) -> Column:
    return col(c).isin(*FAMILIES)


def topic_flag(c: Column | str) -> Column:
    """ "1" for the family in scope, "0" for the other, "" for neither."""
    f = family(c)
    return F.when(f == IN, "1").when(f == OUT, "0").otherwise("")


def looked_up(c: Column | str, names: dict[str, str], default: str) -> Column:
    """A name for a label, from a table that is a parameter."""
    if not names:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), col(c)), F.lit(default))


def paper_id(index: Column | str, title: Column | str) -> Column:
    """``007_Some_title``: the number, and the title's first 50 characters without marks, spaces as underscores."""
    t = F.regexp_replace(F.coalesce(col(title).cast("string"), F.lit("")), r"(?U)[^\w\s-]", "")
    return F.concat(F.lpad(col(index).cast("string"), 3, "0"), F.lit("_"), F.substring(F.regexp_replace(strip(t), r"(?U)\s+", "_"), 1, 50))
