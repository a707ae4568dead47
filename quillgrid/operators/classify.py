"""Token odds, and the second stage: topics with the odds' say in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import cells, text
from quillgrid.operators import phrases as P
from quillgrid.operators.metrics import token_documents
from quillgrid.sources import tables as S


def document_tokens(df: DataFrame, key: str, tokens: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each distinct token of a document."""
    return df.select(key, *also, F.explode(F.array_distinct(tokens)).alias("token"))


def fit_odds(tokens: DataFrame, key: str, label: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(weights: token, weight; bias: one row) of smoothed log odds over documents that have tokens.

    The weights stay distributed; counting combines before it shuffles.
    """
    docs = tokens.select(key, label).distinct().agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    counts = token_documents(tokens, label, least)
    w = counts.join(F.broadcast(docs)).select("token", (F.ln((F.col("pos") + 1) / (F.col("p") + 2)) - F.ln((F.col("neg") + 1) / (F.col("n") + 2))).alias("weight"))
    return w, docs.select(F.ln((F.col("p") + 1) / (F.col("n") + 1)).alias("bias"))


def odds_score(tokens: DataFrame, key: str, weights: DataFrame, bias: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(key, odds, probability) of each document with tokens: bias plus the weights of its distinct tokens.

    The weights are counted; up to ``most`` are sent to all tasks, and tokens are
    summed by document before they are shuffled.
    """
    weights = S.kept(weights, "weights")
    if weights.count() <= most:
        weights = F.broadcast(weights)
    s = tokens.join(weights, "token", "left").groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    out = s.join(F.broadcast(bias)).select(key, (F.col("w") + F.col("bias")).alias("odds"))
    return out.withColumn("probability", probability("odds"))


def probability(odds: Column | str) -> Column:
    z = F.least(F.greatest(cells.col(odds) / 4, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(-z))


def aligned(topics: Column, p: Column) -> Column:
    """Scores with up to 1.5 added to the family that the probability favours; best first, ties by label."""
    a = F.least(F.greatest((p - 0.5) * 2, F.lit(-1.0)), F.lit(1.0))
    plus = lambda label: F.when(cells.family(label) == cells.IN, F.greatest(a, F.lit(0.0))).otherwise(F.greatest(-a, F.lit(0.0))) * 1.5
    new = F.transform(topics, lambda x: F.struct((-F.round(x["score"] + plus(x["label"]), 4)).alias("minus"), x["label"].alias("label"), F.round(x["score"] + plus(x["label"]), 4).alias("score"), x["matches"].alias("matches")))
    return F.array_sort(new)


def is_unknown(label: Column, score: Column, margin: Column, p: Column) -> Column:
    """A topic too weak to stand: by general floors, then by those of its label."""
    weak = F.abs(p - 0.5) < 0.12
    out = (score < 2.4) | ((margin < 1.1) & weak) | ((score <= 0) & weak)
    for name, (s, m, floor, ceiling, below) in P.UNKNOWN_POLICIES.items():
        own = (score < s) | (margin < m)
        own = own | (p >= floor) if floor is not None else own | ((p <= ceiling) & (score < below))
        out = out | ((label == name) & own)
    return out


def confidence(score: Column, margin: Column, p: Column, matched: Column, unknown: Column, tokens: Column) -> Column:
    """How sure the second stage is, to four digits.

    Summed in decimals, so that a value half way between two results is rounded
    up wherever it is computed.
    """
    exact = lambda x: F.lit(x).cast("decimal(4,3)")
    part = lambda x, each, most: F.least(F.greatest(x.cast("decimal(14,6)") * exact(each), F.lit(0)), exact(most))
    c = exact("0.16") + part(score, "0.045", "0.36") + part(margin, "0.055", "0.22") + part(F.abs(p.cast("decimal(14,6)") - exact("0.5")), "0.32", "0.16") + F.when(matched, exact("0.05")).otherwise(exact("0"))
    c = F.when(unknown, F.least(c, exact("0.49"))).otherwise(c)
    c = F.when(tokens < 8, F.least(c, exact("0.45"))).when(tokens < 18, F.least(c, exact("0.68"))).otherwise(c)
    return F.round(F.least(F.greatest(c, exact("0.2")), exact("0.99")), 4).cast("double")


def second_stage(df: DataFrame, p: str | None = None, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Adds ``local`` from ``topics`` and the odds' probability (0.5 without a model)."""
    prob = F.coalesce(F.col(p), F.lit(0.5)) if p else F.lit(0.5)
    df = df.withColumns({"_p": prob, "_n": text.token_count(text.joined([title, abstract]))}).withColumn("_l", text.seal(aligned(F.col("topics"), F.col("_p"))))
    best, second = F.col("_l")[0], F.try_element_at("_l", F.lit(2))
    margin = F.round(F.greatest(best["score"] - F.coalesce(second["score"], F.lit(0.0)), F.lit(0.0)), 4)
    unknown = is_unknown(best["label"], best["score"], margin, F.col("_p"))
    label = F.when(unknown, cells.UNKNOWN).otherwise(best["label"])
    local = F.struct(
        label.alias("label"), cells.family(label).alias("group"), confidence(best["score"], margin, F.col("_p"), F.size(best["matches"]) > 0, unknown, F.col("_n")).alias("confidence"), margin.alias("margin"), F.round("_p", 4).alias("p"), F.slice(best["matches"], 1, F.when(unknown, 8).otherwise(10)).alias("matches"),
        F.transform(F.slice("_l", 1, 3), lambda x: F.format_string("%s:%.2f", x["label"], x["score"])).alias("top3"), F.transform("_l", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("scored"),
    )
    return df.withColumn("local", text.seal(local)).drop("_p", "_n", "_l")
