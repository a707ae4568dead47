"""Operator 9: a quality classifier as a sparse rule ensemble, compiled to Spark column expressions.

Small boosted trees over text statistics give conjunctive rules (the path to
each of their nodes); a lasso logistic regression keeps and weighs some of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import arrays, textstats
from quillgrid.llm.quality_rules import sample

#: A condition is (statistic, True for "at most" and False for "above", bound).
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[float, Rule], ...] = ()

    def score(self) -> Column:
        """The probability of label 1 from columns of statistics."""
        z = F.lit(self.bias)
        for weight, rule in self.rules:
            z = z + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.4f} if " + " and ".join(f"{n} {'<=' if low else '>'} {b:.6g}" for n, low, b in r) for w, r in sorted(self.rules, key=lambda x: -abs(x[0]))]


def condition(rule: Rule) -> Column:
    out = None
    for name, low, bound in rule:
        one = F.col(name) <= F.lit(bound) if low else F.col(name) > F.lit(bound)
        out = one if out is None else out & one
    return out


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """``textstats.STATISTICS`` of every text; a null text counts as empty. ``also`` names columns to carry along."""
    last = None if keep_text else -1

    def count(batches):
        for batch in batches:
            for part, data, offs in arrays.chunks(batch, "text"):
                s = textstats.statistics(data, offs)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *(pa.array(s[k]) for k in textstats.STATISTICS)], [*part.schema.names[:last], *textstats.STATISTICS])

    kept = [docs[id_col].alias("id"), *(docs[c].alias(f"c{i}") for i, c in enumerate(also))]
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *also)]
    names = ["id", *(f"c{i}" for i in range(len(also)))]
    schema = ", ".join([f"{n} {k}" for n, k in zip(names, kinds)] + ["text string"] * keep_text + [f"{s} double" for s in textstats.STATISTICS])
    return docs.select(*kept, docs[text_col].alias("text")).mapInArrow(count, schema)


def grow(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, hess: np.ndarray, depth: int, columns: np.ndarray, least: int) -> list[tuple[list[tuple[int, bool, float]], np.ndarray, float]]:
    """A regression tree by Newton gain: (path, rows, value) of each node but the root, leaves last."""
    out, todo = [], [([], np.arange(len(x)), depth)]
    leaves = []
    while todo:
        path, rows, left = todo.pop()
        g, h = target[rows].sum(), hess[rows].sum()
        if path:
            out.append((path, rows, g / (h + 1.0)))
        best = (1e-9, None, None)
        if left:
            for c in columns:
                v = x[rows, c]
                bins = np.searchsorted(cuts[c], v, "left")
                gs, hs = np.cumsum(np.bincount(bins, target[rows], len(cuts[c]) + 1)), np.cumsum(np.bincount(bins, hess[rows], len(cuts[c]) + 1))
                n = np.cumsum(np.bincount(bins, minlength=len(cuts[c]) + 1))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if len(gain) > 1 and (k := int(np.argmax(gain[:-1]))) is not None and gain[k] > best[0]:
                    best = (gain[k], c, cuts[c][k])
        if best[1] is None:
            leaves.append((path, rows, g / (h + 1.0)))
            continue
        _, c, cut = best
        low = x[rows, c] <= cut
        todo += [(path + [(int(c), True, float(cut))], rows[low], left - 1), (path + [(int(c), False, float(cut))], rows[~low], left - 1)]
    return out + [("leaf", rows, v) for _, rows, v in leaves]


def lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias isn't penalised."""
    n, m = a.shape
    full = np.concatenate([a, np.ones((n, 1), a.dtype)], 1)
    step = 4.0 / max(1e-9, np.linalg.eigvalsh((full * weight[:, None]).T @ full)[-1])
    b, prev, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(steps):
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = b + (t - 1) / nt * (b - prev)
        r = weight * (1 / (1 + np.exp(-np.clip(full @ v, -30, 30))) - y)
        new = v - step * (full.T @ r)
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        prev, b, t = b, new, nt
    return b[:m], float(b[m])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 8000, trees: int = 40, depth: int = 3, penalties: tuple[float, ...] = (1e-2, 3e-3, 1e-3, 3e-4), seed: int = 7) -> Ensemble:
    """Fit on at most ``most`` labelled rows; those with crc32(id as text) mod 5 = 0 are never used.

    Trees and lasso are fitted on folds 1 to 3, the penalty is chosen by the
    log-likelihood on fold 4. Labels that are all alike, or none, give a
    constant score.
    """
    got = statistics(sample(docs, labels, id_col, text_col, label_col, most), id_col="id", text_col="text", also=("label", "fold")).toArrow()
    y, fold = got["c0"].to_numpy().astype(float), got["c1"].to_numpy()
    x = np.stack([got[s].to_numpy() for s in textstats.STATISTICS], 1) if len(y) else np.zeros((0, 1))
    order = np.lexsort((*x.T, y, got["id"].to_numpy())) if len(y) else np.zeros(0, int)  # the same fit however the rows arrive
    x, y, fold = x[order], y[order], fold[order]
    train = fold != 4
    if len(set(y[train])) < 2 or not (~train).any():
        mean = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    xt, yt = x[train], y[train]
    cuts = [np.unique(np.quantile(xt[:, c], np.linspace(0.01, 0.99, 64))) for c in range(x.shape[1])]
    margin, rules = np.full(len(yt), np.log(yt.mean() / (1 - yt.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = rng.permutation(len(yt))[: max(200, len(yt) * 6 // 10)]
        columns = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        nodes = grow(xt[rows], cuts, (yt - p)[rows], (p * (1 - p))[rows], depth, columns, max(5, len(rows) // 400))
        for path, _, _ in (n for n in nodes if n[0] != "leaf"):
            rules[tuple(sorted((textstats.STATISTICS[c], low, cut) for c, low, cut in path))] = None
        paths = [n for n in nodes if n[0] != "leaf"]
        for path, _, value in paths:
            if len(path) == depth or not any(len(q) > len(path) and q[: len(path)] == path for q, _, _ in paths):
                inside = np.ones(len(yt), bool)
                for c, low, cut in path:
                    inside &= (xt[:, c] <= cut) == low
                margin[inside] += 0.3 * value
    rules = list(rules)
    at = {s: i for i, s in enumerate(textstats.STATISTICS)}
    a = np.ones((len(y), len(rules)))
    for k, r in enumerate(rules):
        for name, low, cut in r:
            a[:, k] *= (x[:, at[name]] <= cut) == low
    best = None
    for penalty in penalties:
        w, b = lasso(a[train], yt, np.full(len(yt), 1 / len(yt)), penalty)
        p = np.clip(1 / (1 + np.exp(-np.clip(a[~train] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        fit_ = float((y[~train] * np.log(p) + (1 - y[~train]) * np.log(1 - p)).mean())
        if best is None or fit_ > best[0] + 1e-4:
            best = (fit_, w, b)
    _, w, b = best
    return Ensemble(b, tuple((float(w[k]), rules[k]) for k in np.flatnonzero(np.abs(w) > 1e-6)))


def classify(docs: DataFrame, model: Ensemble, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Score and prediction of every text.

    Returns for each input row ``id_col``, held_out (crc32 of the id as text is
    a multiple of 5; null for a null id), score (0 to 1) and predicted (1 if
    score >= ``threshold``). A null text counts as empty and gets a score too.
    """
    found = statistics(docs, id_col=id_col, text_col=text_col).select("id", model.score().alias("score"))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ensemble, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't rejected (score >= ``threshold``); one scan, no join."""
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(rest))).alias("row"), docs[text_col].alias("text"))
    good = statistics(src, id_col="row", text_col="text", keep_text=True).where(model.score() >= threshold)
    return good.select(*(F.col("text").alias(c) if c == text_col else F.col(f"id.c{rest.index(c)}").alias(c) for c in docs.columns))
