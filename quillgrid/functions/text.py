"""Text normalisation and tokens, as column expressions."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Java's \s, and the no-break space.
_EDGE = r"^[\s ]+|[\s ]+$"
SEPARATOR = " [SEP] "
#: Every spelling of "nan".
_NAN = tuple("".join(x) for x in itertools.product("nN", "aA", "nN"))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seal(c: Column) -> Column:
    """The same value, but an expression that the optimiser doesn't copy into each place that reads a field of it."""
    return F.element_at(F.array(c), 1)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row, in lambdas too."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), _EDGE, "")


def normalize(c: Column | str) -> Column:
    """Trimmed text; null and "nan" in any case are empty."""
    return bind(strip(F.coalesce(_c(c).cast("string"), F.lit(""))), lambda t: F.when(t.isin(*_NAN), "").otherwise(t))


def phrase(c: Column | str) -> Column:
    """Lower case, white space collapsed."""
    return F.regexp_replace(F.lower(normalize(c)), r"[\s ]+", " ")


def plain(c: Column | str) -> Column:
    """A phrase with hyphens as spaces."""
    return F.replace(phrase(c), F.lit("-"), F.lit(" "))


def multi(c: Column | str) -> Column:
    """The parts of a text separated by semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(normalize(c), r"\s*;\s*"), strip), lambda x: x != "")


def phrases(c: Column | str) -> Column:
    """The distinct phrases of an array, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(_c(c), phrase), lambda x: x != ""))


def keyword_list(c: Column | str) -> Column:
    return phrases(multi(c))


def keywords(first: Column | str, second: Column | str) -> Column:
    """Two fields' keywords as one list, in text form."""
    return F.array_join(phrases(F.concat(multi(first), multi(second))), "; ")


def domains(first: Column | str, second: Column | str) -> Column:
    return phrases(F.concat(multi(first), multi(second)))


def unigrams(c: Column | str) -> Column:
    return F.filter(F.split(phrase(c), "[^a-z0-9]+"), lambda x: x != "")


def tokens(c: Column | str) -> Column:
    """Unigrams, then the pairs of neighbours joined by an underscore."""
    return bind(unigrams(c), lambda one: F.concat(one, pairs(one)))


def token_count(c: Column | str) -> Column:
    """The size of ``tokens``: each unigram, and each pair of neighbours."""
    edges = lambda p: F.size(p) - (p[0] == "").cast("int") - (F.element_at(p, -1) == "").cast("int")
    return bind(F.split(phrase(c), "[^a-z0-9]+"), lambda p: F.greatest(2 * edges(p) - 1, F.lit(0)))


def pairs(one: Column) -> Column:
    left, right = F.slice(one, 1, F.greatest(F.size(one) - 1, F.lit(0))), F.slice(one, 2, F.greatest(F.size(one) - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit("_"), b))


def joined(columns: Sequence[Column | str], by: str = SEPARATOR) -> Column:
    """The texts that aren't empty, joined."""
    parts = [normalize(c) for c in columns]
    return F.concat_ws(by, *(F.when(p != "", p) for p in parts))


def weighted(title: Column | str, abstract: Column | str) -> Column:
    """The title twice and the abstract three times."""
    parts = F.concat(F.array_repeat(normalize(title), 2), F.array_repeat(normalize(abstract), 3))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def key(c: Column | str) -> Column:
    """Join key of a title: trimmed, lower case, white space collapsed; null is the key "nan"."""
    return F.regexp_replace(F.lower(strip(F.coalesce(_c(c).cast("string"), F.lit("nan")))), r"[\s ]+", " ")


def contained(text: Column, terms: Sequence[str]) -> Column:
    """Which of the terms a text contains, in their order."""
    return bind(text, lambda x: F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(x, t))) if terms else F.array().cast("array<string>")


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return bind(text, lambda x: F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(x, t))) if terms else F.lit(False)


def word_set(c: Column | str) -> Column:
    """Distinct runs of a-z and 0-9 of a lower-cased name."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(c)), "[^a-z0-9]+"), lambda x: x != ""))


def digest(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def redacted(c: Column | str, most: int = 4000) -> Column:
    """Text fit for a log: keys and addresses masked, control characters dropped, cut to ``most`` characters."""
    t = F.coalesce(_c(c).cast("string"), F.lit(""))
    t = F.regexp_replace(t, r"(?i)\b(sk|pk|api|key)[-_][A-Za-z0-9_-]{8,}", "[REDACTED]")
    t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED]")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)
