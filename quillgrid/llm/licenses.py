"""Operator 10: license scans by ordered signature rules, in DataFrame functions only.

The rules are some hundred regular expressions over normalised words
(``license_rules``). Two keyword filters keep them off most texts, both of
strings that a match can't be without: a text must have one of ``ANCHORS``
before it is normalised at all, and one of a rule's own keys, which are derived
from its expression, before the expression is tried. Detections that lie within
another one of higher priority, or of the same priority and greater length, are
suppressed in one sweep over the sorted detections.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import folds
from quillgrid.llm.license_rules import written

OPEN, CLOSE = "﷐", "﷑"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a word; a word is the longest run of anything else.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text that isn't lower-cased yet.
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The contract's phrases and labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: A text with none of these (in lower case) can match no rule; ``rules`` sees to it that every rule needs one.
ANCHORS = (
    "licen", "under", "creative", "permission", "redistribut", "reserved", "public", "subject", "governed", "accordance", "pursuant", "spdx", "gpl", "cecill", "apache", "opensource", "mozilla", "warrant",
    "copyright", "proprietary", "prohibited", "provided", "distributed", "software", "permitted", "whatever", "just do what", "reproduced", "contributors", "everyone", "anyone", "same terms", "unmodified",
)
CONFIDENCE = {1: 0.3, 2: 0.5, 3: 0.7, 4: 0.9, 5: 0.99}


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` has one of ``anchors`` in it, and of each set of ``keys`` at least one."""

    label: str
    priority: int
    pattern: str
    anchors: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...]


def _spaced(pattern: str) -> str:
    """Between two words of the normalised text there are two spaces: one ends the first, one begins the next."""
    return f" (?:{pattern.replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')}) "


def _best(needed: list[frozenset[str]]) -> frozenset[str] | None:
    return max(needed, key=lambda d: (min(map(len, d)), -len(d)), default=None)


def mandatory(items) -> list[frozenset[str]]:
    """Sets of strings of a parsed expression: whatever it matches has at least one string of each set in it."""
    out, run = [], ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if run:
            out.append(frozenset({run}))
            run = ""
        if kind is op.SUBPATTERN:
            out += mandatory(value[3])
        elif kind is op.BRANCH:
            ways = [_best(mandatory(w)) for w in value[1]]
            if all(w is not None for w in ways):
                out.append(frozenset().union(*ways))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            out += mandatory(value[2])
    return out


def _anchors(needed: list[frozenset[str]]) -> tuple[str, ...] | None:
    """The anchors, as few as there are, of which a match has at least one; None if no set of strings gives any."""
    ways = []
    for strings in needed:
        own = [next((a for a in ANCHORS if a in k.replace("  ", " ")), None) for k in strings]
        if None not in own:
            ways.append(tuple(sorted(set(own))))
    return min(ways, key=lambda w: (len(w), max(map(ANCHORS.index, w))), default=None)


#: Words that many texts have; strings of these alone are looked for last.
COMMON = set("the of to a is and or for in by with under licensed released distributed published available provided covered license licence licen terms subject governed version this it you may not be as software file all public general".split())


def _keys(needed: list[frozenset[str]]) -> tuple[tuple[str, ...], ...]:
    """The sets of strings worth looking for, the rarest first; three are enough."""
    useful = {d for d in needed if min(map(lambda k: len(k.strip()), d)) >= 2}
    common = lambda d: any(set(k.split()) <= COMMON for k in d)
    order = sorted(useful, key=lambda d: (common(d), len(d), -min(map(len, d)), sorted(d)))
    return tuple(tuple(sorted(d)) for d in order[:3])


@lru_cache
def rules() -> tuple[Rule, ...]:
    out = []
    for label, priority, pattern in written():
        needed = mandatory(parser.parse(_spaced(pattern)))
        anchors, keys = _anchors(needed), _keys(needed)
        if not anchors or not keys:
            raise ValueError(f"no anchor for {label}: {pattern}")
        out.append(Rule(label, priority, _spaced(pattern), anchors, keys))
    return tuple(out)


def _words(s: Column) -> Column:
    """How many words of normalised text a piece has: each has two spaces."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _count_words(text: Column) -> Column:
    """Words of raw text: the pieces between breaks, less an empty one before a break that begins it and after one that ends it."""
    count = lambda p: F.greatest(F.size(p) - (p[0] == "").cast("int") - (F.element_at(p, -1) == "").cast("int"), F.lit(0))
    return folds.bind(F.split(text, RAW_BREAK), count).cast("bigint")


def _places(norm: Column, pattern: Column) -> Column:
    """First and last word (from 0, both inclusive) of each match, leftmost and non-overlapping."""

    def step(at: Column, part: Column):
        inside = _words(F.substring_index(part, CLOSE, 1))
        return at + _words(part), F.lit(True), F.struct(at.alias("first"), (at + inside - 1).alias("last"))

    parts = F.split(F.regexp_replace(norm, pattern, F.lit(f"{OPEN}$0{CLOSE}")), OPEN)
    return folds.bind(parts, lambda p: folds.scan(F.slice(p, F.lit(2), F.size(p)), _words(F.element_at(p, 1)), step, "struct<first:bigint,last:bigint>"))


FOUND = "struct<first:bigint,last:bigint,label:string,priority:int>"


def _unsuppressed(found: Column) -> Column:
    """The detections that don't lie within another one of higher priority, or of the same priority and greater length.

    Sorted by first word, then by last word and priority, both falling, whatever
    a detection lies within comes before it. The sweep keeps for each priority
    the furthest last word so far, and the first word of the detection that
    reached it first.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("up"), (-d["priority"]).alias("down"), d["label"].alias("label"))))
    levels = sorted(CONFIDENCE)
    state = F.expr("named_struct('prev', cast(null as struct<first:bigint,up:bigint,down:int,label:string>), " + ", ".join(f"'l{p}', -1L, 'f{p}', -1L" for p in levels) + ")")

    def step(s: Column, d: Column):
        last, priority = -d["up"], -d["down"]
        stronger, longer = F.lit(False), F.lit(False)
        fields = [d.alias("prev")]
        for p in levels:
            own, reach = priority == p, s[f"l{p}"]
            stronger = stronger | ((priority < p) & (reach >= last))
            longer = longer | (own & ((reach > last) | ((reach == last) & (s[f"f{p}"] < d["first"]))))
            further = own & (last > reach)
            fields += [F.when(further, last).otherwise(reach).alias(f"l{p}"), F.when(further, d["first"]).otherwise(s[f"f{p}"]).alias(f"f{p}")]
        fresh = ~F.coalesce(s["prev"] == d, F.lit(False))
        return F.struct(*fields), fresh & ~stronger & ~longer, F.struct(d["first"].alias("first"), last.alias("last"), d["label"].alias("label"), priority.alias("priority"))

    return folds.scan(order, state, step, FOUND)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that each text names, in one scan without a shuffle.

    Returns for each input row: ``id_col``, n_words, base (the places of the
    fixed phrases: first, label) and found (the detections that no other one
    suppresses: first and last word, label, priority). A null text counts as
    empty. Repeated and null ids are kept as they are; an empty table gives none.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text")).withColumn("n_words", _count_words(F.col("text"))).withColumn("low", F.lower("text"))
    gate = F.rlike("low", F.lit(f"cc{BREAK}by"))
    for a in reversed(ANCHORS):
        broken = F.rlike("low", F.lit(a.replace(" ", BREAK))) if " " in a else F.contains("low", F.lit(a))
        gate = broken | gate
    lowered = F.translate(F.concat(F.lit(" "), "text", F.lit(" ")), UPPER + OPEN + CLOSE, SMALL + "��")
    norm = F.regexp_replace(lowered, BREAK, "  ")  # two spaces before the first word and after the last, too
    rows = rows.withColumn("norm", F.when(gate, norm).otherwise(F.lit("")))
    rows = rows.withColumn("norm", F.when(F.length("norm") > 4, F.substring("norm", F.lit(2), F.length("norm") - 2)).otherwise(F.lit(""))).drop("text", "low")
    entry = lambda r: F.struct(F.array(*(F.array(*map(F.lit, k)) for k in r.keys)).alias("keys"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"))
    groups: dict[tuple[str, ...], list[Rule]] = {}
    for r in rules():
        groups.setdefault(r.anchors, []).append(r)
    table = F.array(*(F.struct(F.array(*(F.lit(a.replace(" ", "  ")) for a in anchors)).alias("anchors"), F.array(*map(entry, rs)).alias("rules")) for anchors, rs in groups.items()))
    has = lambda k: F.contains(F.col("norm"), k)
    near = F.flatten(F.transform(F.filter(table, lambda g: F.exists(g["anchors"], has)), lambda g: g["rules"]))
    fits = F.filter(near, lambda r: F.forall(r["keys"], lambda keys: F.exists(keys, has)) & F.rlike(F.col("norm"), r["pattern"]))
    places = lambda r: F.transform(_places(F.col("norm"), r["pattern"]), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["label"].alias("label"), r["priority"].alias("priority")))
    none = F.expr(f"cast(array() as array<{FOUND}>)")
    rows = rows.withColumn("all", F.when(F.length("norm") > 0, F.flatten(F.transform(fits, places))).otherwise(none))
    base = F.concat(*(F.transform(_places(F.col("norm"), F.lit(_spaced(phrase))), _labelled(label)) for phrase, label in BASE))
    some = F.expr("cast(array() as array<struct<first:bigint,label:string>>)")
    kept = F.when(F.size("all") > 0, F.array_sort(_unsuppressed(F.col("all")))).otherwise(none)
    return rows.select(F.col("id").alias(id_col), "n_words", F.when(F.length("norm") > 0, base).otherwise(some).alias("base"), kept.alias("found"))


def _labelled(label: str):
    return lambda p: F.struct(p["first"].alias("first"), F.lit(label).alias("label"))


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns; score is the confidence of the strongest detection, 0.9 at least for a base phrase, else 0."""
    labels = lambda *a: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda d: d["label"]) for x in a)))), ",")
    firsts = F.transform("base", lambda d: d["first"])
    strength = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    best = F.coalesce(F.array_max(F.transform("found", lambda d: F.element_at(strength, d["priority"]))), F.lit(0.0))
    return found.select(
        id_col, "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"), labels(F.col("base")).alias("base_labels"), labels(F.col("base"), F.col("found")).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for the contract's columns. Every rule is tried on every text: no anchors, no keys."""
    values = ", ".join(f"({n}, '{r.pattern}', '{r.label}', {r.priority})" for n, r in enumerate(rules()))
    hits = " UNION ALL ".join(f"SELECT k, norm, {n} AS n FROM t WHERE regexp_matches(norm, '{r.pattern}')" for n, r in enumerate(rules()))
    phrases = ", ".join(f"('{_spaced(p)}', '{label}')" for p, label in BASE)
    words = "CAST((length({0}) - length(replace({0}, ' ', ''))) / 2 AS BIGINT)"
    find = f"""SELECT k, label, priority, CAST({words.format("p[1]")} + coalesce(list_sum(list_transform(p[2:n - 1], lambda y: {words.format("y")})), 0) AS BIGINT) AS first, {words.format(f"string_split(p[n], '{CLOSE}')[1]")} AS width
  FROM (SELECT *, unnest(generate_series(2, len(p))) AS n FROM (SELECT k, label, priority, string_split(regexp_replace(norm, pattern, '{OPEN}\\0{CLOSE}', 'g'), '{OPEN}') AS p FROM {{0}}))"""
    return f"""WITH r(n, pattern, label, priority) AS (VALUES {values}),
b(pattern, label) AS (VALUES {phrases}),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}{OPEN}{CLOSE}', '{SMALL}��'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT k, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM d WHERE len(w) > 0),
h AS ({hits}),
a AS (SELECT DISTINCT k, label, priority, first, first + width - 1 AS last FROM ({find.format("h JOIN r USING (n)")})),
f AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a AS o WHERE o.k = a.k AND o.first <= a.first AND o.last >= a.last AND (o.priority > a.priority OR (o.priority = a.priority AND o.last - o.first > a.last - a.first)))),
p AS ({find.format("(SELECT t.k, t.norm, b.pattern, b.label, 0 AS priority FROM t, b WHERE regexp_matches(t.norm, b.pattern))")}),
pb AS (SELECT k, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word FROM p GROUP BY k),
bl AS (SELECT k, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT k, label FROM p) GROUP BY k),
al AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM p UNION SELECT k, label FROM f) GROUP BY k),
sc AS (SELECT k, max(CASE priority WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 WHEN 3 THEN 0.7 WHEN 4 THEN 0.9 ELSE 0.99 END) AS best FROM f GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 0.9 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN pb USING (k) LEFT JOIN bl USING (k) LEFT JOIN al USING (k) LEFT JOIN sc USING (k)"""
