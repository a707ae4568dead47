"""A topic model over embedded documents: zero-shot topics, clusters, outliers, and the terms that tell topics apart.

1. A document whose vector is as near to a given topic's as ``similarity`` belongs to it.
2. The others are clustered around centres. Vectors are scaled to length one and
   rounded to whole numbers, so that products and sums are exact, and one seed has
   one result, however rows are dealt and whatever the order of summation.
3. Documents of few words, those far from every centre, and those of clusters
   that stay small are outliers (-1).
4. Topics' terms are words, pairs and triples by class-based TF-IDF.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import text
from quillgrid.operators.topics import STOP
from quillgrid.sources import tables as S

OUTLIER = -1
_WORD = re.compile("[a-z0-9_]{2,}")
#: Whole numbers stand for components of unit vectors; sums of their products stay below 2**53, and so do a task's sums of 2**28 rows.
SCALE = 1 << 25


@dataclass(frozen=True)
class Config:
    """Settings (fixed values)."""

    similarity: float = 0.68
    least_size: int = 20
    least_words: int = 3
    far: float = 0.30
    topics: int = 16
    rounds: int = 8
    seed: int = 20260427
    n_gram: int = 3
    min_df: int = 3
    max_df: float = 0.92
    terms: int = 10


def whole(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as whole numbers, in doubles; a null vector stays null."""
    v = np.nan_to_num(np.asarray(vectors, np.float64))
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return np.rint(v / np.where(length > 0, length, 1.0) * SCALE)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each whole vector, of equally near ones the first; their product)."""
    products = vectors @ centres.T
    best = products.argmax(1)
    return best, products[np.arange(len(best)), best]


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of arrays as a matrix; a null or shorter array is filled up with zeros."""
    c = batch.column(batch.schema.get_field_index(name))
    out = np.zeros((len(c), width))
    for i, x in enumerate(c.to_pylist()):
        if x:
            y = np.array([0.0 if v is None else v for v in x[:width]])
            out[i, : len(y)] = y
    return out


def _assign(key_type, centres: np.ndarray, vector: str):
    schema = pa.schema([("_key", key_type), ("topic", pa.int32()), ("product", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, product = nearest(whole(_rows(b, vector, centres.shape[1])), centres)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(product)], schema=schema)

    return run


def _sums(centres: np.ndarray, vector: str):
    """For each task and centre: how many rows are nearest to it, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for b in batches:
            w = whole(_rows(b, vector, centres.shape[1]))
            w = w[(w != 0).any(1)]
            best, _ = nearest(w, centres)
            np.add.at(total, best, w)
            n += np.bincount(best, minlength=len(centres))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(total[at].astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["topic", "n", "sums"])

    return run


def assign(vectors: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(key, topic, similarity): the nearest of the whole centres, which go to the tasks with the function: some hundred rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.schema[key].dataType
    out = vectors.select(F.col(key).alias("_key"), vector).mapInArrow(_assign(to_arrow_type(kind), centres, vector), f"_key {kind.simpleString()}, topic int, product double")
    return out.select(F.col("_key").alias(key), "topic", F.round(F.col("product") / float(SCALE) / float(SCALE), 6).alias("similarity"))


def centres_of(vectors: DataFrame, key: str, vector: str, cfg: Config = Config()) -> np.ndarray:
    """Whole centres after ``rounds`` of moving each to the mean of the rows nearest to it; they begin at the rows whose md5 of seed and key is least."""
    first = vectors.where(F.size(vector) > 0).orderBy(F.md5(F.concat(F.lit(f"{cfg.seed}:"), F.col(key).cast("string"))), key).limit(cfg.topics).select(vector).collect()
    if not first:
        return np.zeros((0, 1))
    width = max(len(r[0]) for r in first)
    centres = whole(np.array([list(r[0]) + [0.0] * (width - len(r[0])) for r in first], np.float64))
    for _ in range(cfg.rounds):
        parts = vectors.select(vector).mapInArrow(_sums(centres, vector), "topic int, n long, sums array<long>")
        # a row for each task and centre becomes one for each centre and component, before it is summed
        sums = parts.select("topic", F.posexplode("sums").alias("at", "x")).groupBy("topic", "at").agg(F.sum("x").alias("x")).collect()
        moved = np.zeros(centres.shape)
        for r in sums:
            moved[r["topic"], r["at"]] = r["x"]
        moved = np.where((moved != 0).any(1, keepdims=True), whole(moved), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def fit(docs: DataFrame, key: str, vector: str, doc: str, zero: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """(key, topic, kind, similarity) of each document. ``zero`` (topic string, vector) are given topics; clusters are called c0, c1 ...

    ``kind``: zero_shot, cluster or outlier. Keys tell documents apart. A null or zero vector is far
    from everything; so is a document of fewer than ``least_words`` words.
    """
    words = F.size(F.filter(F.split(text.phrase(doc), "[^a-z0-9]+"), lambda w: w != ""))
    rows = S.kept(docs.select(key, vector, words.alias("_words")), "topic-rows")
    given = sorted((r["topic"], list(r["vector"])) for r in zero.select("topic", "vector").collect()) if zero is not None else []
    names = [t for t, _ in given]
    near = None
    if given:
        z = assign(rows, key, vector, whole(np.array([v for _, v in given], np.float64))).where(F.col("similarity") >= cfg.similarity)
        near = S.kept(z.select(key, F.get(F.array(*map(F.lit, names)), F.col("topic")).alias("topic"), "similarity"), "zero-shot")
    left = rows if near is None else rows.join(near, key, "left_anti")
    left = S.kept(left, "clustered")
    enough = left.where(F.col("_words") >= cfg.least_words)
    centres = centres_of(enough, key, vector, cfg)
    none = left.select(key, F.lit("").alias("topic"), F.lit("outlier").alias("kind"), F.lit(0.0).alias("similarity"))
    if len(centres):
        a = S.kept(assign(enough, key, vector, centres), "assigned")
        close = a.where(F.col("similarity") >= cfg.far)
        big = close.groupBy("topic").agg(F.count("*").alias("_n")).where(F.col("_n") >= cfg.least_size).select("topic", F.lit(True).alias("_big"))
        c = a.join(F.broadcast(big), "topic", "left").withColumn("_in", F.col("_big").isNotNull() & (F.col("similarity") >= cfg.far))
        c = c.select(key, F.when(F.col("_in"), F.concat(F.lit("c"), F.col("topic").cast("string"))).otherwise("").alias("topic"), F.when(F.col("_in"), "cluster").otherwise("outlier").alias("kind"), "similarity")
        none = c.unionByName(left.where((F.col("_words") < cfg.least_words) | F.col("_words").isNull()).select(key, F.lit("").alias("topic"), F.lit("outlier").alias("kind"), F.lit(0.0).alias("similarity")))
    return none if near is None else near.select(key, "topic", F.lit("zero_shot").alias("kind"), "similarity").unionByName(none)


#: Distinct terms that a task counts before it hands them on.
_HELD = 1 << 18


def n_grams(words: list[str], most: int = 3) -> list[str]:
    """Runs of one to ``most`` of a text's words, joined by spaces."""
    out = list(words)
    for k in range(2, most + 1):
        out.extend(map(" ".join, zip(*(words[i:] for i in range(k)))))
    return out


def _gram_counts(schema: pa.Schema, most: int, stop: frozenset[str]):
    """(topic, term, tf, df) of a task's (topic, phrase) rows, combined over as many rows as ``_HELD`` distinct terms have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        n = 0

        def out():
            rows = [(topic, term, k, df[term]) for topic, (tf, df) in held.items() for term, k in tf.items()]
            held.clear()
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for b in batches:
            for topic, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tf, df = held.setdefault(topic, (Counter(), Counter()))
                found = Counter(n_grams([w for w in _WORD.findall(phrase) if w not in stop], most))
                n -= len(tf)
                tf.update(found)
                df.update(found.keys())
                n += len(tf)
                if n >= _HELD:
                    yield out()
                    n = 0
        yield out()

    return run


def class_terms(docs: DataFrame, topic: str, doc: str, cfg: Config = Config()) -> DataFrame:
    """(topic, term, score, rank): each topic's ``terms`` best terms by class-based TF-IDF, of ties the first by name.

    A term's score in a topic is its share of the topic's terms, times
    ln(1 + terms of an average topic / occurrences in all). Terms of fewer than
    ``min_df`` documents, or of more than a share of ``max_df``, are left out. Each task
    counts its documents' terms and combines them; they are dealt once, by term,
    which both a topic's and the overall counts are taken from, and only the
    terms that stay are written.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n = docs.count()
    schema = T.StructType([T.StructField(topic, docs.schema[topic].dataType), *T._parse_datatype_string("term string, tf long, df long").fields])
    parts = docs.select(topic, text.phrase(doc)).mapInArrow(_gram_counts(to_arrow_schema(schema), cfg.n_gram, frozenset(STOP)), schema)
    counts = parts.repartition("term").groupBy(topic, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    own = Window.partitionBy("term")
    overall = counts.withColumns({"all_tf": F.sum("tf").over(own), "all_df": F.sum("df").over(own)})
    kept = S.kept(overall.where((F.col("all_df") >= cfg.min_df) & (F.col("all_df") <= cfg.max_df * n)), "terms")
    size = kept.groupBy(topic).agg(F.sum("tf").alias("size"))
    average = kept.agg(F.sum("tf").alias("s"), F.count_distinct(topic).alias("k")).select((F.col("s") / F.col("k")).alias("average"))
    scored = kept.join(F.broadcast(size), topic).join(F.broadcast(average)).withColumn("score", F.round(F.col("tf") / F.col("size") * F.ln(1 + F.col("average") / F.col("all_tf")), 9))
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= cfg.terms).select(topic, "term", "score", "rank")
