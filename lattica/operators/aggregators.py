"""Set aggregators: pools over a group's members, and forward passes of small set models given their weights.

Pools are column expressions. Models with matrices run in an Arrow-backed pandas
function over batches; weights are a broadcast of a fixed size. Training, encoders and
image decoders are out of scope: the engine reads features, it does not learn them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import total


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def median(v: Column) -> Column:
    s, n = F.array_sort(v), F.size(v)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def trimmed(v: Column) -> Column:
    """Without the smallest and largest member where there are three or more."""
    return F.when(F.size(v) >= 3, (total(v) - F.array_max(v) - F.array_min(v)) / (F.size(v) - 2)).otherwise(mean(v))


POOLS: dict[str, Callable[[Column], Column]] = {"mean": mean, "max": F.array_max, "median": median, "trimmed": trimmed}


def softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def linear(x: np.ndarray, w: dict, name: str = "") -> np.ndarray:
    return x @ w[f"{name}weight"].T + w[f"{name}bias"]


def mean_feature(x: np.ndarray, w: dict) -> np.ndarray:
    return linear(x.mean(-2), w)


def max_feature(x: np.ndarray, w: dict) -> np.ndarray:
    return linear(x.max(-2), w)


def mean_logit(x: np.ndarray, w: dict) -> np.ndarray:
    return linear(x, w).mean(-2)


def max_logit(x: np.ndarray, w: dict) -> np.ndarray:
    return linear(x, w).max(-2)


def probability_mean(x: np.ndarray, w: dict) -> np.ndarray:
    return np.log(np.maximum(softmax_rows(linear(x, w)).mean(-2), 1e-12))


def deep_sets(x: np.ndarray, w: dict) -> np.ndarray:
    inner = np.maximum(linear(x, w, "phi_"), 0)
    return linear(np.maximum(linear(inner.mean(-2), w, "rho_"), 0), w)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def rival_conditioned(x: np.ndarray, w: dict) -> np.ndarray:
    """Views weigh by a learned reliability and by how far they stand towards the leading class and away from each of its `rivals` next ones; what they select moves the mean by a gate. Further weights: norm_, hidden_ and out_ (the reliability's layers), scale, gate."""
    views = linear(x, w)
    first = views.mean(-2)
    ranked = np.argsort(-first, axis=-1, kind="stable")[..., : min(int(w["rivals"]), first.shape[-1] - 1) + 1]
    away = w["weight"][ranked[..., :1]] - w["weight"][ranked[..., 1:]]
    away = away / np.maximum(np.linalg.norm(away, axis=-1, keepdims=True), 1e-12)
    centre = x.mean(-2, keepdims=True)
    normed = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * w["norm_weight"] + w["norm_bias"]
    reliable = linear(gelu(linear(normed, w, "hidden_")), w, "out_")[..., 0]
    towards = away @ np.swapaxes(x - centre, -1, -2)  # rivals by views
    selected = softmax_rows(reliable[..., None, :] + w["scale"] * towards) @ x
    weight = softmax_rows(np.take_along_axis(first, ranked[..., 1:], -1))
    gate = 1 / (1 + np.exp(-w["gate"]))
    centre = centre[..., 0, :]
    return linear(centre + gate * ((weight[..., None] * selected).sum(-2) - centre), w)


#: A model maps features [..., views, width] and weights to logits [..., classes]; add to it to plug one in.
MODELS: dict[str, Callable[[np.ndarray, dict], np.ndarray]] = {
    "mean_feature": mean_feature, "max_feature": max_feature, "mean_logit": mean_logit, "max_logit": max_logit, "probability_mean": probability_mean, "deep_sets": deep_sets, "rival_conditioned": rival_conditioned,
}


def classify(groups: DataFrame, key: str, features: str, model: str, weights: dict) -> DataFrame:
    """key, probabilities: a softmax of the model's logits for each group's array of feature vectors. Groups with as many views go through the model together."""
    forward = MODELS[model]
    held = groups.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes, out = np.array([len(v) for v in f[features]]), [None] * len(f)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                found = softmax_rows(forward(np.array([np.stack(f[features].iloc[i]) for i in at]), held.value))
                for i, p in zip(at, found.tolist(), strict=True):
                    out[i] = p
            yield pd.DataFrame({key: f[key], "probabilities": out})

    kind = groups.schema[key].dataType.simpleString()
    return groups.select(key, features).mapInPandas(run, f"{key} {kind}, probabilities array<double>")


def aligned(features: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Feature rows by key, never by position; a missing or repeated key raises when read."""
    counted = features.groupBy(key).agg(F.count("*").alias("times"), F.first("feature").alias("feature"))
    both = wanted.join(counted, key, "left")
    bad = F.when(F.coalesce(F.col("times"), F.lit(0)) != 1, F.raise_error(F.concat(F.lit(f"feature rows of {key} "), F.col(key).cast("string"), F.lit(" are not one"))).cast("int"))
    return both.withColumn("feature", F.when(bad.isNull(), F.col("feature"))).drop("times")
