"""Spelling variants: words one edit apart, and the more frequent form that each one stands for.

One edit leaves one half of a word as it is: two words that differ by a single
inserted, deleted or replaced code point share the first half of the shorter one
as a prefix, or its second half as a suffix. A forward dictionary (words sorted
by their beginning) therefore has such a pair in one block of a shared prefix, or
a reversed dictionary in one block of a shared suffix.

A block is (m, a, b): words of m or m + 1 code points that share their first
``a`` and their last ``m - b``, so that the edit lies in between. A block of more
than ``MOST`` words is split by the same argument, since an edit within a..b
leaves a half of that intact as well: both halves become blocks of their own.
Splitting ends at a single place, where a block has no more words than the
alphabet has letters; so no block grows with the vocabulary, none is cut, and no
pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import storage

#: Words that a block may have before it is split. A block of one place has at most the letters' number plus one.
MOST = 4096
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 5, typos: int = 0) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased within A-Z, of ``least`` code points or more, and how often each occurs.

    With ``typos``, a run whose crc32 of ``<doc_id>:<run>`` that number divides
    loses one code point first. Counts are combined before the shuffle, so a word
    that a third of all runs are costs no more than another. A null or empty text
    has no runs; a null id is an empty string.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(F.expr(f"regexp_extract_all({text}, '{RUN}', 0)")).alias("_run"))
    w = runs.select("_id", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    if typos:
        w = w.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run")))
        at = (F.col("_h") % F.length("_run")).cast("int")
        cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
        w = w.select(F.when(F.col("_h") % typos == 0, cut).otherwise(F.col("_run")).alias("_run"))
    return w.where(F.length("_run") >= least).groupBy(F.col("_run").alias("word")).agg(F.count("*").alias("n"))


def _first_blocks(words_: DataFrame) -> DataFrame:
    """Each word in both dictionaries, as the shorter and as the longer one of a pair."""
    size = F.length("word")
    shorter = F.explode(F.array(*[F.struct((size - d).alias("m"), half.alias("a"), end.alias("b")) for d in (0, 1) for half, end in (_halves(F.lit(0), size - d))]))
    return words_.select("word", shorter.alias("_k")).select("word", "_k.*")


def _halves(a, b):
    """The two blocks that a block splits into: the edit is in its second half, or in its first."""
    mid = F.floor((a + b) / 2).cast("int")
    return [(mid, b), (a, mid)]


def _finer(big: DataFrame) -> DataFrame:
    """Blocks split in two. One place is split by the kind of the edit: a replacement there, an insertion before or after it."""
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    halves = [F.struct(m.alias("m"), x.alias("a"), y.alias("b"), F.lit(0).alias("kind")) for x, y in _halves(a, b)]
    kinds = [F.struct(m.alias("m"), a.alias("a"), b.alias("b"), F.lit(1).alias("kind")), F.struct(m.alias("m"), a.alias("a"), a.alias("b"), F.lit(2).alias("kind")), F.struct(m.alias("m"), b.alias("a"), b.alias("b"), F.lit(2).alias("kind"))]
    out = big.select("word", F.explode(F.when(b - a > 1, F.array(*halves)).otherwise(F.array(*kinds))).alias("_k")).select("word", "_k.*")
    return out.where((F.col("kind") != 1) | (F.length("word") == F.col("m")))


def _keyed(blocks: DataFrame) -> DataFrame:
    """The block's key: its place, and the shared prefix and suffix themselves."""
    tail = F.col("m") - F.col("b")
    return blocks.withColumn("key", F.concat_ws("/", "m", "a", "b", "kind", F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - tail + 1, tail)))


_PAIRS = pa.schema([("word", pa.string()), ("other", pa.string())])


def near(block: list[str], m: int, a: int, b: int) -> Iterator[tuple[str, str]]:
    """Pairs (shorter or equal, other) of a block's words that differ by one edit between the shared ends.

    Each word is entered under what is left of it without one code point of the
    part in question: equal rests at one place mean a replacement, and a whole
    shorter word that equals a longer one's rest an insertion. Both are exact.
    """
    tail = m - b
    same: dict[tuple[int, str], list[str]] = {}
    whole = {w for w in block if len(w) == m}
    for w in block:
        rests = set()
        for p in range(a, len(w) - tail):
            rest = w[:p] + w[p + 1 :]
            if len(w) == m:
                same.setdefault((p, rest), []).append(w)
            elif rest in whole:
                rests.add(rest)
        for rest in rests:
            yield rest, w
    for group in same.values():
        for i, w in enumerate(group):
            for v in group[:i]:
                yield v, w


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left: list[str] = []
    right: list[str] = []
    key, block, place = None, [], (0, 0, 0)

    def settle():
        for x, y in near(block, *place):
            left.append(min(x, y))
            right.append(max(x, y))

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], schema=_PAIRS)
        left.clear()
        right.clear()
        return made

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "word", "m", "a", "b")]
        for k, w, m, a, b in zip(*cols):
            if k != key:
                settle()
                key, block, place = k, [], (m, a, b)
                if len(left) > 50_000:
                    yield out()
            block.append(w)
    settle()
    yield out()


def near_pairs(words_: DataFrame, most: int = MOST) -> DataFrame:
    """(word, other), word < other: all pairs of distinct words one edit apart, each once.

    ``words_`` has distinct words. Rounds go on until no block that can be split
    has more than ``most`` words; a round writes just the words of those that do
    to the shared folder. Their keys are at most the words' number over ``most``,
    and are broadcast only if they are counted and few.
    """
    blocks = storage.materialise(_keyed(_first_blocks(words_).withColumn("kind", F.lit(0))), "blocks")
    found = None
    while True:
        big = blocks.where((F.col("b") > F.col("a")) & (F.col("kind") == 0)).groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("key")
        big = storage.materialise(big, "big-blocks")
        n = big.count()
        big = F.broadcast(big) if n <= 10_000 else big
        settled = blocks.join(big, "key", "left_anti") if n else blocks
        pairs = settled.select("key", "word", "m", "a", "b").repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "word string, other string")
        found = pairs if found is None else found.union(pairs)
        if not n:
            return found.distinct()
        blocks = storage.materialise(_keyed(_finer(blocks.join(big, "key", "left_semi"))), "blocks")


def variants(words_: DataFrame, least: int = 3, ratio: int = 2, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n and root of each distinct word that occurs ``least`` times or more.

    A word's form is its most frequent near word (ties: the first in code-point
    order) if that is ``ratio`` times as frequent or more; the root is where
    following the forms ends. A word without a form is its own root, one without
    near words has n_near 0; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms could go round in circles below a ratio of 2")
    known = storage.materialise(words_.where(F.col("n") >= least), "words")
    pairs = storage.materialise(near_pairs(known.select("word"), most), "pairs")
    both = pairs.union(pairs.select("other", "word"))
    best = both.join(known.select(F.col("word").alias("other"), F.col("n").alias("_n")), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("minus"), "other")).alias("_best"))
    formed = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(-F.col("_best.minus") >= ratio * F.col("n"), c).alias(x) for c, x in ((F.col("_best.other"), "form"), (-F.col("_best.minus"), "form_n"))])
    formed = storage.materialise(formed, "forms")
    return formed.join(roots(formed.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that begins at each word ends, by pointer doubling.

    ``n`` grows along a chain, so chains have no circles and the rounds are the
    logarithm of the longest one. A word whose pointer has reached a root takes
    no part in later rounds.
    """
    now = storage.materialise(forms.select("word", F.coalesce("form", "word").alias("to"), F.col("form").isNull().alias("done")), "pointers")
    while not now.where("not done").isEmpty():
        step = now.select(F.col("word").alias("to"), F.col("to").alias("next"), F.col("done").alias("end"))
        moved = now.where("not done").join(step, "to").select("word", F.col("next").alias("to"), F.col("end").alias("done"))
        now = storage.materialise(now.where("done").union(moved), "pointers")
    return now.select("word", F.col("to").alias("root"))
