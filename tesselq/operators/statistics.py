"""Histograms, weighted quantiles, moments and curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def bin_of(value: Column, edges: list[float]) -> Column:
    """1-based bin with edges[k] <= value < edges[k + 1]; the last bin is closed; 0 outside and for null."""
    out = F.when(value == edges[-1], len(edges) - 1)
    for k in range(len(edges) - 1):
        out = out.when((value >= edges[k]) & (value < edges[k + 1]), k + 1)
    return out.otherwise(0)


def histogram(df: DataFrame, bins: dict[str, Column], weight: Column) -> DataFrame:
    """Weight share by bin; rows outside (bin 0) are dropped; shares add up to one."""
    inside = df.select(*(c.alias(k) for k, c in bins.items()), weight.alias("_w"))
    for k in bins:
        inside = inside.where(F.col(k) > 0)
    sums = inside.groupBy(*bins).agg(F.sum("_w").alias("_w"))
    return sums.select(*bins, (F.col("_w") / inside.agg(F.sum("_w")).scalar()).alias("share"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, median: the least value at which the running weight exceeds half; the midpoint to the next where it is exactly half.

    Equal values are added up first, so a group's window holds distinct values only.
    """
    merged = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = merged.select(
        *keys, F.col(value).alias("_v"), F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"), F.sum("_w").over(Window.partitionBy(*keys)).alias("_all"), F.lead(value).over(w).alias("_next")
    )
    at = run.where(F.col("_run") * 2 >= F.col("_all")).withColumn("_m", F.when(F.col("_run") * 2 == F.col("_all"), (F.col("_v") + F.coalesce("_next", "_v")) / 2).otherwise(F.col("_v").cast("double")))
    return at.groupBy(*keys).agg(F.min_by("_m", "_v").alias("median"))


def entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, entropy: -sum p ln max(p, 1e-6) of the values' shares."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return shares.groupBy(key).agg((-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-6))))).alias("entropy"))


def geometric_mean(value: Column, floor: float = 1e-10) -> Column:
    return F.exp(F.avg(F.log(F.greatest(value, F.lit(floor)))))


def roc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One point for each distinct score, from the highest: rows so far of truth 0 and 1 (fp, tp), rates and precision.

    Rows are counted by score first, then running sums are taken within ranges of scores and carried over, so no
    task sorts all rows.
    """
    counts = df.where(F.col(truth).isNotNull()).groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("t"), F.count_if(F.col(truth) != 1).alias("f"))
    # Stored, so that both uses below see the same ranges.
    ranged = stored(counts.repartitionByRange(F.col(score).desc()).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range only
    offsets = ranged.groupBy("_p").agg(F.sum("t").alias("_t"), F.sum("f").alias("_f"))
    offsets = offsets.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t"), F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_f"))
    own = Window.partitionBy("_p").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    points = ranged.withColumn("tp", F.sum("t").over(own)).withColumn("fp", F.sum("f").over(own)).join(F.broadcast(offsets), "_p")
    points = points.select(F.col(score).alias("score"), (F.col("tp") + F.col("_t")).alias("tp"), (F.col("fp") + F.col("_f")).alias("fp"))
    pos, neg = counts.agg(F.sum("t")).scalar(), counts.agg(F.sum("f")).scalar()
    return points.select("score", "tp", "fp", (F.col("tp") / pos).alias("recall"), (F.col("fp") / neg).alias("fall_out"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def pca_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the means, and the population covariance of each pair."""
    out = [F.avg(c).alias(f"mean_{c}") for c in columns]
    out += [F.covar_pop(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(*out)


def order_statistic(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th least value (from 1) of a numeric column, exactly; null takes no part, None beyond the last.

    Counts by bin narrow the range until one value is left, so nothing is sorted and at most ``bins`` rows come back a round.
    """
    x = F.col(column).cast("double")
    low, high, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not 1 <= k <= n:
        return None
    while low < high:
        place = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
        found = df.where((x >= low) & (x <= high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for r in sorted(found, key=lambda r: r["b"]):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def spaced(low: float, high: float, n: int, logarithmic: bool = True) -> list[float]:
    return (np.geomspace if logarithmic else np.linspace)(low, high, n).tolist()


def resample_roc(points: DataFrame, key: str, rate: str, value: str, targets: list[float]) -> DataFrame:
    """key, target, value: the curve (``rate`` falls as ``value`` rises, ends at (0, 1)) read at each of the rates ``targets``.

    Between the last point at or above the target and the first below, linearly; a target above the whole curve gets its
    first point, one of zero the curve's last point and the end alike. One aggregation, with two small states a target.
    """
    ended = points.select(key, F.col(rate).cast("double").alias("r"), F.col(value).cast("double").alias("v")).where("r is not null and v is not null")
    at = lambda t: (F.min(F.when(F.col("r") >= t, F.struct("r", (-F.col("v")).alias("v")))), F.max(F.when(F.col("r") < t, F.struct("r", (-F.col("v")).alias("v")))), F.max(F.struct("r", (-F.col("v")).alias("v"))))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("target"), *(c.alias(n) for c, n in zip(at(float(t)), ("above", "below", "first"), strict=True))) for t in targets))
    found = ended.groupBy(key).agg(rows.alias("t")).select(key, F.explode("t").alias("t")).select(key, "t.*")
    found = found.withColumn("below", F.coalesce("below", F.struct(F.lit(0.0).alias("r"), F.lit(-1.0).alias("v"))))
    share = F.when(F.col("above.r") == F.col("below.r"), 0.5).otherwise((F.col("target") - F.col("below.r")) / (F.col("above.r") - F.col("below.r")))
    read = share * -F.col("above.v") + (1 - share) * -F.col("below.v")
    return found.select(key, "target", F.when(F.col("above").isNull(), -F.col("first.v")).otherwise(read).alias("value"))


def ankles(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """The points of each curve where it turns: its ends, and those that leave the last kept x and whose y changes next. A curve is one group."""

    def run(pdf):
        pdf = pdf.sort_values(order)
        a, b = pdf[x].tolist(), pdf[y].tolist()
        kept = []
        for i in range(len(a)):
            if i in (0, len(a) - 1) or (a[i] != a[kept[-1]] and b[i] != b[i + 1]):
                kept.append(i)
        return pdf.iloc[kept]

    return points.groupBy(key).applyInPandas(run, points.schema)


def weighted_cdf(df: DataFrame, keys: list[str], bin_: Column, weight: Column) -> DataFrame:
    """keys, bin and cdf: the share of the weight in bins up to this one; bins are added up first, so a window holds one row a bin."""
    sums = df.groupBy(*keys, bin_.alias("bin")).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    return sums.select(*keys, "bin", (F.sum("_w").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_w").over(w)).alias("cdf"))
