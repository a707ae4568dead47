"""Boolean trigram queries from regular expressions.

A query is in disjunctive form: a set of conjunctions, each a set of lower-case
trigrams; a text can match the expression only if it has all trigrams of one
conjunction. None stands for no condition: the expression must be tried on
every text.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

Query = frozenset[frozenset[str]] | None
#: Literal runs branch out to so many strings at most; beyond, a run is closed.
WIDTH = 64


def absorb(query) -> Query:
    """Without conjunctions that a shorter one implies; None if one is empty."""
    out: list[frozenset[str]] = []
    for c in sorted(query, key=len):
        if not c:
            return None
        if not any(o <= c for o in out):
            out.append(c)
    return frozenset(out)


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return absorb({x | y for x in a for y in b})


def either(queries: list[Query]) -> Query:
    return None if any(q is None for q in queries) else absorb({c for q in queries for c in q})


def of_strings(strings: set[str]) -> Query:
    return absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _exact(item) -> set[str] | None:
    """The lower-cased strings that an item matches, if they are few; else None."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        chars = set()
        for k, v in value:
            if k is op.LITERAL:
                chars.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < 4:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 6 else None
    if kind is op.SUBPATTERN:
        return _all_exact(value[3])
    if kind is op.BRANCH:
        parts = [_all_exact(b) for b in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] is not op.MAXREPEAT and value[1] <= 4:
        inner = _all_exact(value[2])
        if inner is None:
            return None
        out, now = set(), {""}
        for n in range(value[1] + 1):
            if n >= value[0]:
                out |= now
            now = {a + b for a in now for b in inner}
            if len(out | now) > WIDTH:
                return None
        return out
    return {""} if kind is op.AT else None


def _all_exact(items) -> set[str] | None:
    out = {""}
    for i in items:
        e = _exact(i)
        if e is None or len(out) * len(e) > WIDTH:
            return None
        out = {a + b for a in out for b in e}
    return out


def _sequence(items) -> Query:
    query, run = None, {""}
    for i in items:
        e = _exact(i)
        if e is not None and len(run) * len(e) <= WIDTH:
            run = {a + b for a in run for b in e}
            continue
        query = both(query, of_strings(run))
        run = e if e is not None and len(e) <= WIDTH else {""}
        if e is None:
            query = both(query, _inner(i))
    return both(query, of_strings(run))


def _inner(item) -> Query:
    kind, value = item
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        return either([_sequence(b) for b in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
        whole = _all_exact(value[2])
        if whole is not None and len(whole) == 1:  # a repeated literal: so many copies in a row
            return of_strings({next(iter(whole)) * min(value[0], 8)})
        return _sequence(value[2])
    return None


def derive(pattern: str) -> Query:
    """The trigram query of a pattern over ASCII-lower-cased text."""
    return _sequence(parser.parse(pattern))
