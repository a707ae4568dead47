"""Folds over array columns that give an array, in DataFrame functions.

``aggregate`` copies its accumulator's list for every element that is appended,
so a list of n grows in n squared steps. Here blocks of elements are folded into
lists of their own, and the lists are joined once at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """Fold ``items`` from left to right; gives array<``kind``>.

    ``step`` of (state, item) gives (the next state, whether to put something
    out, what to put out). No items: an empty array.
    """
    none, nones = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(acc: Column, item: Column) -> Column:
        after, want, out = step(acc["state"], item)
        return F.struct(after.alias("state"), F.when(want, F.concat(acc["found"], F.array(out))).otherwise(acc["found"]).alias("found"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("found")), one)
        return bind(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["found"], F.array(r["found"])).alias("found")))

    def whole(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(state.alias("state"), nones.alias("found")), block, lambda acc: acc["found"]))

    return bind(items, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(none))
