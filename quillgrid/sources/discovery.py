"""Discovery over listings: files are rows, and which belong to which is a join.

A listing comes from a folder (``files``) or from any table with a column of
names. Names are matched as ``tables.in_scope``, ``matches_strategy`` and
``bind_truth`` match single ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators import qgrams
from quillgrid.sources import tables as S
from quillgrid.sources.tables import STRICT_TRACKS


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, parts, bytes, modified) of what lies in a folder of any file system: a file, or a directory with all that is in it. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    last = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.split_part(F.element_at(F.split("path", "/" + _quoted(last) + "/"), -1), F.lit("/"), F.lit(1))
    rows = found.groupBy(name.alias("name")).agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    return rows.where(F.col("name").rlike("^" + ".*".join(_quoted(p) for p in pattern.split("*")) + "$"))


def _quoted(x: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" else "\\" + c for c in x)


def stem(name: Column | str) -> Column:
    """A name without its last ending, in lower case."""
    return F.lower(F.regexp_replace(cells.col(name), r"(?<=.)\.[^.]*$", ""))


def in_scope(name: Column | str, scope: str) -> Column:
    low = F.lower(cells.col(name))
    own = F.lit(scope not in ("urban_renewal", "spatial", "merged")) | F.startswith(low, F.lit(f"{scope}_"))
    return ~F.startswith(low, F.lit("eval_")) & ~F.startswith(low, F.lit("~$")) & own


def prediction_files(listing: DataFrame, scope: str = "urban_renewal") -> DataFrame:
    """The files of a listing that are predictions of a scope."""
    return listing.where(in_scope("name", scope))


def truth_files(listing: DataFrame, folder: str, track: str) -> DataFrame:
    """(folder, names, error): each folder's truth files in order; strict tracks need exactly one."""
    one = listing.groupBy(folder).agg(F.array_sort(F.collect_set("name")).alias("names"))
    wrong = F.lit(track in STRICT_TRACKS) & (F.size("names") != 1)
    return one.select(folder, F.when(~wrong, F.col("names")).alias("names"), F.when(wrong, "ValueError").otherwise("").alias("error"))


def training_files(listing: DataFrame, markers: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """The files whose name has a marker, with ``leaks``: whether it has a forbidden word too (evaluation data)."""
    low = F.lower("name")
    has = lambda words: F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    return listing.where(has(markers)).withColumn("leaks", has(forbidden))


def matches_strategy(name: Column | str, wanted: Column | str) -> Column:
    """Is it a file of a strategy: by stem, by a part between underscores, by its first two parts, or by prefix?"""
    s, w = stem(name), F.lower(cells.col(wanted))
    parts = F.split(s, "_")
    return (s == w) | F.array_contains(parts, w) | (F.array_join(F.slice(parts, 1, 2), "_") == w) | F.startswith(s, w)


def bind(predictions: DataFrame, truths: DataFrame, most: int = qgrams.SENT) -> DataFrame:
    """(name, truth, how) of each prediction file: the only truth file, that of the same stem, one whose stem contains the other's, the one with most words in common, the first.

    Of several, the first by name counts. Both columns are called ``name``;
    names are distinct. Containment is looked up by the stems' q-grams, in either
    direction; an index is sent to all tasks only if it has been counted and has ``most`` rows at most.
    Common words are counted over an inverted index of words, in which only
    predictions without a better match take part, one for each set of words that truths have;
    pairs that share no word are never made.
    """
    p, t = S.kept(predictions.select("name", stem("name").alias("stem")).distinct(), "predictions"), S.kept(truths.select(F.col("name").alias("truth"), stem("name").alias("truth_stem")).distinct(), "truths")
    n = t.agg(F.count("*").alias("n"), F.min("truth").alias("first"))
    rows = t.count()
    few = qgrams.sent(t, rows, most)
    exact = p.join(few, p["stem"] == t["truth_stem"]).groupBy("name").agg(F.min("truth").alias("exact"))
    inside = qgrams.join_pairs(p, "name", "stem", t, "truth_stem", most=most).join(few, F.col("term") == F.col("truth_stem")).select("name", "truth")
    around = qgrams.join_pairs(t, "truth", "truth_stem", p, "stem", most=most).join(p.hint("merge"), F.col("term") == F.col("stem")).select("name", "truth")
    contains = inside.union(around).groupBy("name").agg(F.min("truth").alias("contained"))
    known = S.kept(p.hint("merge").join(exact, "name", "left").hint("merge").join(contains, "name", "left"), "bound")
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")))
    open_ = known.where(F.col("exact").isNull() & F.col("contained").isNull())
    listed = S.kept(t.select("truth", words("truth_stem").alias("word")), "truth-words")
    sets = S.kept(open_.select("name", words("stem").alias("word")).join(qgrams.sent(listed.select("word").distinct(), rows, most), "word").groupBy("name").agg(F.array_sort(F.collect_list("word")).alias("words")), "word-sets")
    shared = sets.select("words").distinct().select("words", F.explode("words").alias("word")).join(qgrams.sent(listed, rows, most), "word").groupBy("words", "truth").agg(F.count("*").alias("n"))
    overlap = shared.groupBy("words").agg(F.min(F.struct((-F.col("n")).alias("minus"), "truth"))["truth"].alias("overlapping"))
    all_ = known.hint("merge").join(sets.hint("merge").join(overlap, "words").select("name", "overlapping"), "name", "left").join(F.broadcast(n))
    single = F.col("n") == 1
    best = F.when(single, F.col("first")).otherwise(F.coalesce("exact", "contained", "overlapping", "first"))
    how = F.when(single, "single_truth").when(F.col("exact").isNotNull(), "exact_stem_match").when(F.col("contained").isNotNull(), "contains_match").when(F.col("overlapping").isNotNull(), "token_overlap_match").otherwise("fallback_first_truth")
    return all_.select("name", best.alias("truth"), how.alias("how"))
