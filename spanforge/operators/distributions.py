"""Two-sample comparisons on (keys, metric, side, value) tables, side A or B."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ranking import running


def counts(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, value, na, nb): how often each side has each value."""
    return values.groupBy(*keys, value).agg(F.count_if(F.col("side") == "A").alias("na"), F.count_if(F.col("side") == "B").alias("nb"))


def ecdf_distances(c: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of (keys, value, na, nb): ks_similarity, wasserstein_similarity and wasserstein_distance.

    KS is 1 - max |F_a - F_b|; an empty side gives 0.  Wasserstein-1 is the area between
    the two step functions, scaled by the largest of pooled deviation, |mean a|, |mean b|.
    """
    v, na, nb = F.col("value"), F.col("na"), F.col("nb")
    size = F.sum(na + nb)
    mean = F.sum(v * (na + nb)) / size
    sizes = c.groupBy(*keys).agg(
        F.sum("na").alias("ta"), F.sum("nb").alias("tb"),
        F.sqrt(F.greatest(F.sum(v * v * (na + nb)) / size - mean * mean, F.lit(0.0))).alias("sd"),
        F.abs(F.sum(v * na) / F.nullif(F.sum("na"), F.lit(0))).alias("ma"), F.abs(F.sum(v * nb) / F.nullif(F.sum("nb"), F.lit(0))).alias("mb"),
    )
    steps = running(c, keys, "value", ["na", "nb"]).join(sizes, keys)
    gap = F.abs(F.col("na_upto") / F.nullif(F.col("ta"), F.lit(0)) - F.col("nb_upto") / F.nullif(F.col("tb"), F.lit(0)))
    area = gap * (F.coalesce("next_value", "value") - F.col("value"))
    scale = F.greatest(F.first("sd"), F.coalesce(F.first("ma"), F.lit(0.0)), F.coalesce(F.first("mb"), F.lit(0.0)), F.lit(1e-9))
    return steps.groupBy(*keys).agg(
        F.coalesce(1 - F.max(gap), F.lit(0.0)).alias("ks_similarity"),
        F.coalesce(F.greatest(1 - F.sum(area) / scale, F.lit(0.0)), F.lit(0.0)).alias("wasserstein_similarity"),
        F.coalesce(F.sum(area), F.lit(0.0)).alias("wasserstein_distance"),
    )


def js_similarity(c: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of (keys, value, na, nb): 1 - Jensen-Shannon distance (base 2) on the union support, smoothed by 1e-12."""
    totals = c.groupBy(*keys).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count(F.lit(1)).alias("support"))
    smooth = 1e-12

    def mass(n: str, t: str):
        share = F.coalesce(F.col(n) / F.nullif(F.col(t), F.lit(0)), F.lit(0.0)) + smooth
        return share / (F.when(F.col(t) > 0, 1.0).otherwise(0.0) + smooth * F.col("support"))

    rows = c.join(totals, keys).withColumn("p", mass("na", "ta")).withColumn("q", mass("nb", "tb")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = F.col("p") * F.log2(F.col("p") / F.col("m")) / 2 + F.col("q") * F.log2(F.col("q") / F.col("m")) / 2
    return rows.groupBy(*keys).agg((1 - F.sqrt(F.greatest(F.sum(part), F.lit(0.0)))).alias("js_similarity"))


def mmd_similarity(features: DataFrame, keys: list[str], columns: list[str], capped: DataFrame) -> DataFrame:
    """Per key: mmd and mmd_similarity = exp(-mmd), with an RBF kernel on z-scored features.

    ``features`` (keys, side, graph_id, columns) set the z-score; ``capped`` (keys,
    graph_id) names the graphs the quadratic kernel sees, a fixed number a side by
    definition, so one key's points are one small matrix.  The bandwidth is the median
    nonzero squared distance; the estimate is biased (it keeps the diagonal).  An empty side gives 0.
    """
    scale = features.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = F.array(*[(F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-9) for c in columns])
    points = features.join(capped, [*keys, "graph_id"]).join(scale, keys).select(*keys, "side", "graph_id", z.alias("z"))

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("graph_id")
        out = group[keys].head(1).assign(mmd_similarity=0.0, mmd=0.0)
        a, points = (group["side"] == "A").to_numpy(), np.stack(group["z"].to_numpy())
        if a.any() and not a.all():
            square = np.zeros((len(points), len(points)))
            for column in points.T:
                square += (column[:, None] - column[None, :]) ** 2
            apart = square[square > 0]
            near = np.exp(-square / (2 * (np.median(apart) if len(apart) else 1.0)))
            out["mmd"] = max(near[np.ix_(a, a)].mean() + near[np.ix_(~a, ~a)].mean() - 2 * near[np.ix_(a, ~a)].mean(), 0.0)
            out["mmd_similarity"] = np.exp(-out["mmd"])
        return out

    schema = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)
    return points.groupBy(*keys).applyInPandas(kernel, f"{schema}, mmd_similarity double, mmd double")
