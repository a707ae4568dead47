"""Operator 4: base quality counts, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import arrays, textstats

_U = np.uint64
#: Each kind of n-gram has this many hashed features of its own.
BINS = 1 << 15
WORD_SIZES, CHAR_SIZES = (1, 2), (3, 4)
KINDS = len(WORD_SIZES) + len(CHAR_SIZES)


def ngrams(data: np.ndarray, offs: np.ndarray):
    """For each kind of n-gram: (feature of each n-gram, its text's first n-gram)."""
    texts = len(offs) - 1
    starts, ends, hashes, firsts = arrays.words(data, offs, arrays.DARK, lower=False)
    text = np.repeat(np.arange(texts), np.diff(firsts))
    for kind, size in enumerate(WORD_SIZES):
        at = np.arange(max(0, len(hashes) - size + 1))
        at = at[text[at] == text[at + size - 1]] if len(at) else at
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = arrays.mix(h + hashes[at + k])
        yield (h >> _U(49)).astype(np.int64) % BINS + kind * BINS, np.searchsorted(text[at], np.arange(texts + 1))
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    owner = np.searchsorted(offs, chars, "right") - 1
    edges = np.append(chars, len(data))
    for kind, size in enumerate(CHAR_SIZES, len(WORD_SIZES)):
        at = np.arange(max(0, len(chars) - size + 1))
        at = at[owner[at] == owner[at + size - 1]] if len(at) else at
        h = arrays.span_hashes(data, edges[at], edges[at + size])
        yield (h >> _U(49)).astype(np.int64) % BINS + kind * BINS, np.searchsorted(owner[at], np.arange(texts + 1))


@dataclass(frozen=True)
class Model:
    """Weights by feature; a text's margin is the sum over kinds of the mean weight of its n-grams.

    The probability is 1 / (1 + exp(-(slope * margin + shift))), fitted on rows
    that the weights weren't. ``threshold``: kept at this probability or more.
    """

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    threshold: float = 0.5

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.full(len(offs) - 1, self.bias)
        for feature, first in ngrams(data, offs):
            out += arrays.per_text(self.weights[feature].astype(np.float64), first) / np.maximum(np.diff(first), 1)
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _sparse(batches):
    for batch in batches:
        for part, data, offs in arrays.chunks(batch, "text"):
            texts = len(offs) - 1
            keys, values = [], []
            for feature, first in ngrams(data, offs):
                count = np.diff(first)
                owner = np.repeat(np.arange(texts), count)
                k, n = np.unique(owner * (KINDS * BINS) + feature, return_counts=True)
                keys.append(k)
                values.append(n / count[k // (KINDS * BINS)])
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            at = np.searchsorted(key[order] // (KINDS * BINS), np.arange(texts + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in ((key[order] % (KINDS * BINS)).astype(np.int32), value[order].astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["label", "fold", "features", "shares"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled texts (by a hash of their ids), with label and fold; the documents aren't shuffled.

    The fold is crc32 of the id as text, modulo 5; rows of fold 0 stay out. An
    id counts once: of documents that repeat it, the one whose text hash is
    smallest; of labels, the largest.
    """
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)).cast("int")
    some = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)").withColumn("fold", fold).where("fold <> 0")
    some = some.groupBy("id").agg(F.max("label").alias("label"), F.first("fold").alias("fold")).orderBy(F.xxhash64("id"), "id").limit(most)
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("hash")).join(F.broadcast(some), "id")
    one = found.groupBy("id").agg(F.min_by(F.struct("label", "fold", "text"), F.struct("hash", "text")).alias("row"))  # at most `most` texts are shuffled, of each id's rows one a task
    return one.select("row.label", "row.fold", "row.text", "id")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 3000, steps: int = 150, l2: float = 1e-4, threshold: float = 0.5) -> Model:
    """Fit on at most ``most`` labelled rows: weights on folds 1 to 3, calibration on fold 4, fold 0 left out.

    Both classes have the same total weight in the fit; the calibration is by
    the rows as they are. Labels that are all alike, or none, give a model that
    keeps everything.
    """
    some = sample(docs, labels, id_col, text_col, label_col, most).orderBy("id").select("label", "fold", "text")  # the same sums however the rows arrive
    rows = some.mapInArrow(_sparse, "label int, fold int, features array<int>, shares array<float>").toArrow()
    label, fold = rows["label"].to_numpy().astype(float), rows["fold"].to_numpy()
    size = KINDS * BINS
    if len(label) == 0 or len(set(label[fold != 4])) < 2 or len(set(label[fold == 4])) < 2:
        return Model(np.zeros(size, np.float32), 0.0, 0.0, 30.0, threshold)
    lists = rows["features"].combine_chunks()
    feature, share = lists.flatten().to_numpy(), rows["shares"].combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(label), dtype=np.int32), lists.value_lengths().to_numpy())
    del rows, lists
    train = fold != 4  # other rows have no importance, so their residuals are 0
    importance = np.where(train, np.where(label == 1, 0.5 / (label[train] == 1).sum(), 0.5 / (label[train] == 0).sum()), 0)
    weights, bias, rate = np.zeros(size), 0.0, 8.0
    seen, seen_bias = np.full(size, 1e-12), 1e-12
    for _ in range(steps):
        z = np.bincount(owner, share * weights[feature], len(label)) + bias
        r = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        g = np.bincount(feature, share * r[owner], size) + l2 / size * weights
        seen += g * g
        seen_bias += r.sum() ** 2
        weights -= rate * g / np.sqrt(seen)
        bias -= 0.1 * r.sum() / np.sqrt(seen_bias)
    z = np.bincount(owner, share * weights[feature], len(label)) + bias
    slope, shift = platt(z[~train], label[~train])
    return Model(weights.astype(np.float32), float(bias), slope, shift, threshold)


def platt(z: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to margins, by Newton's method with smoothed targets."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    b = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - t)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """Counts and verdict of every text, in one scan of Arrow batches.

    Returns for each input row ``id_col``, the ``COUNTS``, base_failed (fewer
    than ``min_words`` words, or more than ``most_repeat`` in 100 words in
    repeats), probability and kept. A null text counts as empty: no words, so
    base_failed. Repeated and null ids are kept as they are.
    """
    own = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for part, data, offs in arrays.chunks(batch, "text"):
                c = textstats.base_counts(data, offs)
                p = own.value.probability(own.value.margins(data, offs))
                failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > most_repeat * c["n_words"])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= own.value.threshold))], ["id", *COUNTS, "base_failed", "probability", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, probability double, kept boolean"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(judge, schema).withColumnRenamed("id", id_col)
