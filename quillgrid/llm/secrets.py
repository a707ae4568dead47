"""Operator 7: secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (``trigrams``). One
scan of the texts makes the *postings*: for each trigram that a rule asks for,
the sorted keys of the rows whose lower-cased texts have it. They are dealt to
buckets by key, so that no list grows with the table, and are written to the
shared folder. Within a bucket the lists of a conjunction are intersected, the
rarest trigram's first, and the conjunctions of a rule united; the keys that are
left name the rows on which the rule is tried. A rule without mandatory trigrams
(long hexadecimal runs) is tried on every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import folds, storage, trigrams

#: Marks put around matches. They are noncharacters; where a text has one, it counts as U+FFFD, which no rule matches.
OPEN, CLOSE, INNER = "﷐", "﷑", "﷒"


@dataclass(frozen=True)
class Rule:
    """``head`` and ``value`` are regular expressions without groups; a match counts if its value has ``least`` characters."""

    kind: str
    head: str
    value: str
    least: int = 1
    base: bool = False
    strict: str = ""  # a pattern for the value that has the bound in it, for redaction; by default ``value``

    @property
    def pattern(self) -> str:
        return f"({self.head})({self.value})"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
RULES = (
    Rule("assign", rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6, True, "[A-Za-z0-9+/_.=-]{6,}"),
    Rule("access", "", "AKIA[A-Z0-9]+", 20, True, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "", "[0-9a-f]{24,}", 24, True),
    Rule("github", "", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
)


def queries(rules: tuple[Rule, ...] = RULES) -> list[trigrams.Query]:
    return [trigrams.derive(r.pattern) for r in rules]


#: Letters from frequent to rare; all other characters are rarer.
FREQUENT = "etaoinshrdlucmfwypvbgkjxqz"


def _rarity(gram: str) -> tuple[int, str]:
    return -sum(FREQUENT.find(c) % 64 for c in gram), gram


def asked(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries ask for: some hundred, fixed by the rules."""
    return sorted({g for q in queries(rules) if q is not None for c in q for g in c})


#: Bytes of texts for a bucket of postings.
BUCKET = 32 << 20


def postings(rows: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(bucket, gram, keys): the inverted index, a sorted list of distinct keys for each trigram and bucket, written to the shared folder."""
    buckets = max(8, storage.size_of(rows) // BUCKET)
    there = F.filter(F.array(*(F.lit(g) for g in asked(rules))), lambda g: F.contains("_low", g))
    has = rows.select(F.col(key).alias("key"), F.lower(text).alias("_low")).select("key", F.explode(there).alias("gram"))
    lists = has.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket"), "gram").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return storage.materialise(lists, "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules: numbers of the rules whose query the key's postings meet), for rules that have a query."""
    none = F.array().cast("array<bigint>")
    lists = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    posting = lambda g: F.coalesce(F.try_element_at("lists", F.lit(g)), none)
    found = []
    for n, query in enumerate(queries(rules)):
        if query is None:
            continue
        met = none
        for conjunction in sorted(query, key=sorted):
            first, *rest = sorted(conjunction, key=_rarity)
            keys = posting(first)
            for g in rest:
                keys = F.array_intersect(keys, posting(g))
            met = F.array_union(met, keys)
        found.append(F.struct(F.lit(n).alias("rule"), met.alias("keys")))
    if not found:
        return index.select(F.lit(0).cast("long").alias("key"), F.array().cast("array<int>").alias("rules")).limit(0)
    each = lists.select(F.explode(F.array(*found)).alias("_f")).select("_f.rule", F.explode("_f.keys").alias("key"))
    return each.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _with_candidates(rows: DataFrame, id_: Column, text: Column, rules: tuple[Rule, ...], name: str) -> DataFrame:
    """Adds an array of Booleans: for each rule, whether the text may match it.

    A row's key is a hash of its id and text: rows that share one are candidates
    of each other's rules, which are verified on each.
    """
    key, own = f"{name}_key", f"{name}_text"
    rows = rows.withColumn(key, F.xxhash64(id_.cast("string"), text))
    index = postings(rows.withColumn(own, text).select(key, own), key, own, rules)
    met = candidates(index, rules).select(F.col("key").alias(key), F.col("rules").alias(f"{name}_rules"))
    rows = rows.join(met.hint("shuffle_hash"), key, "left")
    may = [F.lit(True) if q is None else F.coalesce(F.array_contains(f"{name}_rules", n), F.lit(False)) for n, q in enumerate(queries(rules))]
    return rows.withColumn(name, F.array(*may)).drop(key, f"{name}_rules")


def _spans(text: Column, rule: Rule) -> Column:
    """The matches of a rule, leftmost and non-overlapping: array of (start, end) in code points."""

    def step(at: Column, part: Column):
        match = F.substring_index(part, CLOSE, 1)
        value = F.length(F.substring_index(match, INNER, -1))
        return (at + F.length(part) - 2), value >= rule.least, F.struct(at.alias("start"), (at + F.length(match) - 1).alias("end"))

    parts = F.split(F.regexp_replace(text, rule.pattern, f"{OPEN}$1{INNER}$2{CLOSE}"), OPEN)
    return folds.bind(parts, lambda p: folds.scan(F.slice(p, F.lit(2), F.size(p)), F.length(F.element_at(p, 1)).cast("bigint"), step, "struct<start:bigint,end:bigint>"))


def _named(place: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All secrets of every text.

    Returns for each input row: ``id_col``, text_hash (xxhash64 of the text) and
    found, an array of (start, place of the kind in ``rules``, end, kind), in
    that order; offsets are code points, the end exclusive. A null text counts
    as empty. Repeated and null ids are scanned row by row; an empty table gives
    none. Texts are scanned once for the index and once to verify, and are dealt
    by key to meet their candidates.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    rows = _with_candidates(rows, F.col("id"), F.col("text"), rules, "may")
    has_mark = F.contains("text", F.lit(OPEN)) | F.contains("text", F.lit(CLOSE)) | F.contains("text", F.lit(INNER))
    rows = rows.withColumn("text", F.when(has_mark, F.translate("text", OPEN + CLOSE + INNER, "�" * 3)).otherwise(F.col("text")))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    parts = []
    for n, rule in enumerate(rules):
        spans = F.when(F.col("may")[n] & F.rlike("text", F.lit(rule.pattern)), _spans(F.col("text"), rule)).otherwise(none)
        parts.append(F.transform(spans, _named(n, rule.kind)))
    return rows.select(F.col("id").alias(id_col), "text_hash", F.array_sort(F.concat(*parts)).alias("found"))


def digest(found: DataFrame, *, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = [n for n, r in enumerate(rules) if r.base]
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda n: F.size(F.filter("found", lambda s: s["place"] == n)).cast("long")
    return found.select(id_col, *(count(n).alias(f"n_{rules[n].kind}") for n in base), F.sha2(shown(F.filter("found", lambda s: s["place"].isin(base))), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every matched value replaced by ``mask`` (a rule's head, such as ``token = ``, stays), for texts with findings.

    Rules run in order, each over what the one before left. All columns and
    rows are kept; a null text stays null.
    """
    names = docs.columns
    may = "_may"
    while any(c.lower().startswith(may) for c in names):
        may = f"_{may}"
    rows = _with_candidates(docs, docs[id_col], F.coalesce(docs[text_col], F.lit("")), rules, may)
    text = F.col(text_col)  # a projection for each rule: nested, the expression would double with every rule
    for n, (rule, query) in enumerate(zip(rules, queries(rules))):
        changed = F.regexp_replace(text, f"({rule.head})({rule.strict or rule.value})", f"$1{mask}")
        rows = rows.withColumn(text_col, changed if query is None else F.when(F.col(may)[n], changed).otherwise(text))
    return rows.select(*names)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the contract's columns."""
    quote = lambda s: s.replace("'", "''")
    ctes, all_ = [], []
    for n, r in enumerate(rules):
        ctes.append(f"""r{n} AS (SELECT k, string_split(regexp_replace(t, '{quote(r.pattern)}', '{OPEN}\\1{INNER}\\2{CLOSE}', 'g'), '{OPEN}') AS p FROM d WHERE regexp_matches(t, '{quote(r.pattern)}')),
s{n} AS (SELECT k, a AS s, a + length(m) - 1 AS e FROM (SELECT k, length(p[1]) + coalesce(list_sum(list_transform(p[2:i - 1], lambda x: length(x) - 2)), 0) AS a, string_split(p[i], '{CLOSE}')[1] AS m FROM (SELECT k, p, unnest(generate_series(2, len(p))) AS i FROM r{n}))
  WHERE length(string_split(m, '{INNER}')[2]) >= {r.least})""")
        all_.append(f"SELECT k, CAST(s AS BIGINT) AS s, {n} AS n, CAST(e AS BIGINT) AS e, '{r.kind}' AS kind FROM s{n}")
    base = [n for n, r in enumerate(rules) if r.base]
    counts = ", ".join(f"coalesce(count(s) FILTER (n = {n}), 0) AS n_{rules[n].kind}" for n in base)
    one = "kind || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{OPEN}{CLOSE}{INNER}', '���') AS t FROM documents),
{", ".join(ctes)},
f AS ({" UNION ALL ".join(all_)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY s, n, e) FILTER (n IN ({", ".join(map(str, base))})), '')) AS base_sha256, coalesce(string_agg({one}, ',' ORDER BY s, n, e), '') AS spans
FROM d LEFT JOIN f USING (k) GROUP BY k, doc_id"""
