"""Which of many terms each text contains, by an inverted index from q-grams to terms.

A term of q letters or more can only occur in a text that has all of its q-grams,
so it is entered under one of them, the one that fewest terms share; shorter
terms are entered under themselves, as a gram of their own length. Grams without
a space are preferred: those lie within words, so a text's distinct words have
them all. A text's distinct grams are looked up, and the terms they lead to are
*verified* as substrings. The work grows with the texts and with what is found in
them, not with the number of terms.

Looking a gram up costs about as much as searching a text for one short term does, so for fewer
than several hundred terms, searching for each of them (``text.contained``) is faster.

The index is either a literal (``Index``), looked up within the row, for a lexicon that the plan
holds, or a table (``join_terms``), joined by gram, for one of any size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text
from quillgrid.sources import tables as S

Q = 3
#: Rows of an index that are sent to all tasks: some MB, which the driver holds several times over.
SENT = 1 << 16
#: Between terms of one bucket; no normalised text or term has it.
_SEP = "\x02"
_EDGE = "\x01"


def grams(c: Column, q: int = Q, inner: bool = False) -> Column:
    """The distinct q-grams of a text; with ``inner`` those without a space, from its distinct words."""
    one = "[^ ]" if inner else "."
    words = F.array_join(F.array_distinct(F.split(c, " ")), " ") if inner else c
    return F.array_distinct(F.regexp_extract_all(words, F.lit(f"(?s)(?=({one * q}))"), F.lit(1)))


class Index:
    """An inverted index as a literal: buckets of terms, by the crc32 of their gram."""

    def __init__(self, terms: Iterable[str], q: int = Q):
        self.q, self.terms = q, tuple(dict.fromkeys(t for t in terms if t))
        own = {t: [g for g in dict.fromkeys(t[i : i + q] for i in range(len(t) - q + 1)) if " " not in g] for t in self.terms}
        self.short = tuple(t for t in self.terms if not own[t])
        long = [t for t in self.terms if own[t]]
        shared = Counter(g for gs in own.values() for g in gs)
        self.size = 1 << max(6, (2 * len(long)).bit_length())
        buckets: list[list[str]] = [[] for _ in range(self.size)]
        for t in long:
            g = min(own[t], key=lambda g: shared[g])  # of equal ones the first
            buckets[zlib.crc32(g.encode()) % self.size].append(t)
        self._buckets = [_SEP.join(b) for b in buckets]

    def candidates(self, c: Column) -> Column:
        """Terms that a text may contain: those of its grams' buckets, and those too short to have one."""
        table = F.split(F.lit(_EDGE.join(self._buckets)), _EDGE)
        led = F.filter(F.transform(grams(c, self.q, inner=True), lambda g: F.get(table, (F.crc32(g) % self.size).cast("int"))), lambda b: b != "")
        found = F.filter(F.split(F.array_join(led, _SEP), _SEP), lambda t: t != "")
        return F.array_distinct(F.concat(found, F.array(*map(F.lit, self.short)))) if self.short else F.array_distinct(found)

    def found(self, c: Column, candidates: Column | None = None) -> Column:
        """The terms that a text contains, in no order. ``candidates`` may come from a longer text that contains this one."""
        return text.bind(c, lambda x: F.filter(self.candidates(x) if candidates is None else candidates, lambda t: F.contains(x, t)))


def sent(df: DataFrame, n: int | None = None, most: int | None = None) -> DataFrame:
    """A side of a join that is sent to all tasks if it has been counted and has few rows, and else is not.

    Spark takes sizes from compressed files and blocks, and so would send, by way of the driver, tables of a million short names.
    """
    return F.broadcast(df) if (df.count() if n is None else n) <= (SENT if most is None else most) else df.hint("merge")


def index_table(lexicon: DataFrame, term: str = "term", q: int = Q) -> DataFrame:
    """(gram, term): each distinct term that isn't empty under the gram of its own that fewest terms share (ties: the least), or under itself if it's short."""
    terms = lexicon.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
    inner = grams(F.col("term"), q, inner=True)
    each = terms.select("term", F.explode(F.when(F.length("term") < q, F.array("term")).when(F.size(inner) > 0, inner).otherwise(grams(F.col("term"), q))).alias("gram"))
    # a gram's terms are counted first and joined back, so that no gram's terms come to one task as a whole
    counts = S.kept(each.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    return each.join(sent(counts), "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("gram", "term")


def _led(df: DataFrame, columns: list[str], column: str, lexicon: DataFrame, term: str, q: int, most: int) -> DataFrame:
    """(columns, term): for each text the terms that its grams lead to, each once, since a term is entered under one gram."""
    index = index_table(lexicon, term, q)
    about = index.agg(F.count("*").alias("n"), F.collect_set(F.length("gram")).alias("lengths"), F.coalesce(F.bool_or(F.contains("gram", F.lit(" "))), F.lit(False)).alias("spaced")).first()
    index = sent(index, about["n"], most)
    # only grams of the kinds that the index has
    kinds = [grams(F.col(column), n, inner=n == q and not about["spaced"]) for n in sorted(about["lengths"])] or [F.array().cast("array<string>")]
    return df.select(*columns, F.explode(F.flatten(F.array(*kinds))).alias("gram")).join(index, "gram").drop("gram")


def join_pairs(df: DataFrame, key: str, column: str, lexicon: DataFrame, term: str = "term", q: int = Q, most: int = SENT) -> DataFrame:
    """(key, term) of each term that a short text contains. The text goes with each candidate, so that no text's or term's candidates come together."""
    return _led(df, list(dict.fromkeys((key, column))), column, lexicon, term, q, most).where(F.contains(column, "term")).select(key, "term")


def join_terms(df: DataFrame, key: str, column: str, lexicon: DataFrame, term: str = "term", q: int = Q, most: int = SENT, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also, terms): for each text of ``column`` the array of terms that it contains, sorted; texts without any are left out.

    ``key`` tells rows apart. Texts' distinct grams are joined with the index,
    which is sent to all tasks only if it has been counted and has ``most`` rows at most.
    Candidates are gathered by text (never more than the lexicon has), and only
    texts that have some are verified. A null text has no terms.
    """
    led = _led(df, [key], column, lexicon, term, q, most).groupBy(key).agg(F.collect_set("term").alias("_terms"))
    checked = df.select(key, column, *(c for c in also if c != column)).join(led, key).select(key, *also, text.bind(F.col(column), lambda x: F.array_sort(F.filter("_terms", lambda t: F.contains(x, t)))).alias("terms"))
    return checked.where(F.size("terms") > 0)
