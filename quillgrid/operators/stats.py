"""Bootstrap intervals and paired tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells
from quillgrid.operators import metrics as M


def bootstrap(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), samples: int = 400, seed: int = 20260416) -> DataFrame:
    """95 % percentile intervals of accuracy and F1 for each group.

    Both depend on five counts only, so resampling rows is one multinomial draw
    over the counts: the cost doesn't grow with the rows. At least 50 samples.
    """
    n = max(50, samples)
    keys = list(by)
    counted = M.binary(df, truth, pred, keys)
    if not keys:
        counted, keys = counted.withColumn("__all", F.lit(0)), ["__all"]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        counts = np.array([r.tp, r.tn, r.fp, r.fn, r.total - r.tp - r.tn - r.fp - r.fn], float)
        rng = np.random.default_rng([seed, *(sum(map(ord, str(r[k]))) for k in keys)])
        s = rng.multinomial(int(r.total), counts / counts.sum(), n)
        tp, tn, fp, fn = s[:, 0], s[:, 1], s[:, 2], s[:, 3]
        acc = np.round((tp + tn) / r.total * 100, 4)
        f1 = np.round(np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0), 6)
        rows = [(*(r[k] for k in keys), name, float(point), round(float(np.quantile(x, 0.025)), 6), round(float(np.quantile(x, 0.975)), 6), n) for name, point, x in (("accuracy", r.accuracy, acc), ("f1", r.f1, f1))]
        return pd.DataFrame(rows, columns=[*keys, "metric", "point_estimate", "ci_lower", "ci_upper", "samples"])

    kinds = ", ".join(f"`{k}` {counted.schema[k].dataType.simpleString()}" for k in keys)
    out = counted.where("total > 0").groupBy(*keys).applyInPandas(draw, f"{kinds}, metric string, point_estimate double, ci_lower double, ci_upper double, samples int")
    return out if by else out.drop("__all")


def mcnemar_p(statistic: float) -> float:
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2)) if statistic > 0 else 1.0


def mcnemar(df: DataFrame, truth: str, preds: Sequence[str]) -> DataFrame:
    """The continuity-corrected test of the two predictions of highest F1 (ties by name): rows where just one is right.

    Equal normalised values count as right, unreadable ones too.
    """
    t = cells.binary(truth)
    cell = lambda p, x, y: F.count_if((t == x) & (cells.binary(p) == y))
    one = df.agg(*(cell(p, x, y).alias(f"{i}_{x}{y}") for i, p in enumerate(preds) for x, y in ((1, 1), (0, 1), (1, 0)))).first()
    f1 = lambda i: round(2 * one[f"{i}_11"] / max(1, 2 * one[f"{i}_11"] + one[f"{i}_01"] + one[f"{i}_10"]), 6)
    scored = sorted((-f1(i), p) for i, p in enumerate(preds))[:2]
    if len(scored) < 2:
        return df.sparkSession.createDataFrame([], "file_a string, file_b string, b long, c long, statistic double, p_value double")
    a, b = (p for _, p in scored)
    ra, rb = t == cells.binary(a), t == cells.binary(b)
    n = df.agg(F.count_if(ra & ~rb).alias("b"), F.count_if(~ra & rb).alias("c"))
    both = F.col("b") + F.col("c")
    st = F.when(both > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0)) / both).otherwise(0.0)
    erfc = F.udf(mcnemar_p, "double")  # one row
    return n.select(F.lit(a).alias("file_a"), F.lit(b).alias("file_b"), "b", "c", F.round(st, 6).alias("statistic"), F.round(erfc(st), 6).alias("p_value"))
