"""Tables behind reports: filters, labels, counts, histograms and the context of a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions import geometry as g
from gapweave.functions.ids import hash01

#: Methods that compact reports name, and what the names of others hold.
COMPACT = (
    "linear", "heading_hermite", "rtg_bridge", "brownian_bridge", "pretrained_motif_guarded", "pretrained_motif_robust_global",
    "pretrained_motif_oracle_distilled_selector", "pretrained_motif_conservative_oracle_switcher",
)
COMPACT_PARTS = ("residual_flow_weighted_cost_rank_K20_b0.35_lamconf", "residual_linear_weighted_cost_rank_K20_b0.35_lamconf", "v26")


def compact(metrics: DataFrame) -> DataFrame:
    """Rows of the methods that compact reports show."""
    method, keep = F.col("method"), F.col("method").isin(*COMPACT)
    for part in COMPACT_PARTS:
        keep |= method.contains(part)
    return metrics.filter(keep)


def finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a number: not null, NaN or infinite."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def clipped(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, most: int | None = None, uid: str = "task_uid") -> DataFrame:
    """Finite rows between two percentiles; with `most`, that many of them, the first by hash of the id."""
    rows = finite(df, value)
    ends = rows.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_e"))
    inside = rows.crossJoin(F.broadcast(ends)).filter(F.col(value).between(F.col("_e")[0], F.col("_e")[1])).drop("_e")  # one row
    return inside.orderBy(hash01(F.col(uid)), uid).limit(most) if most else inside


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 24) -> DataFrame:
    """Counts of a value's finite rows in bins of one width over its range; the last bin holds its upper end. Rows keys, bin (from 0), lower, upper, n."""
    rows = finite(df, value)
    ends = rows.agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    met = rows.crossJoin(F.broadcast(ends)).withColumn("bin", at)  # one row
    out = met.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("_a").alias("_a"), F.first(width).alias("_w"))
    return out.select(*keys, "bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("lower"), (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("upper"), "n")


def attach(metrics: DataFrame, labels: DataFrame, columns: Sequence[str], key: str = "task_uid") -> DataFrame:
    """Metrics with the labels of their gaps: label columns that the metrics have are dropped first, repeated ids of labels count once."""
    have = [c for c in columns if c in labels.columns]
    once = labels.groupBy(key).agg(F.min(F.struct(*have)).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in have])
    return metrics.drop(*have).join(once, key, "left")


def context_fixes(tracks: DataFrame, gaps: DataFrame, hours: float = 12.0) -> DataFrame:
    """The fixes of a gap's animal within so many hours of the gap's middle, ends included; rows task_uid and the fix.

    A gap meets the days that its window touches, so the join is by animal and day.
    """
    own = ["dataset", "taxon", "animal_id"]
    half = F.make_dt_interval(secs=(F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 2e6).cast("decimal(18,6)"))
    reach = F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)"))
    w = gaps.select("task_uid", *own, (F.col("start_time") + half).alias("_mid")).withColumns({"_from": F.col("_mid") - reach, "_to": F.col("_mid") + reach})
    w = w.withColumn("_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))
    t = tracks.withColumn("_day", F.to_date("time"))
    return w.join(t, [*own, "_day"]).filter(F.col("time").between(F.col("_from"), F.col("_to"))).drop("_day", "_from", "_to", "_mid")


def curvature(path: Column) -> Column:
    """The greatest distance of a path from its chord, in chords (at least a metre); 0 for paths of under three points or without a chord."""
    a, b = path[0], F.element_at(path, -1)
    length = g.distance(a, b)
    off = F.transform(path, lambda p: F.abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) / length)
    return F.when((F.size(path) >= 3) & (length > 0), F.array_max(off) / F.greatest(length, F.lit(1.0))).otherwise(0.0)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """For each group the first value by order, the most frequent one, and all as `value:count` joined by `;`; null is `unknown`."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("unknown"))
    n = df.select(*keys, v.alias("_v"), F.col(order).alias("_o")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.min("_o").alias("_o"))
    lists = n.groupBy(*keys).agg(F.min_by("_v", F.struct("_o", "_v")).alias(f"top_{value}"), F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_o").alias("o"), F.col("_v").alias("v")))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda e: F.concat(e["v"], F.lit(":"), (-e["n"]).cast("string"))), ";")
    return lists.select(*keys, f"top_{value}", F.col("_l")[0]["v"].alias(f"dominant_{value}"), text.alias(f"{value}_counts"))


def weighted_means(df: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Weighted means by group; weights sum to one, all alike where they sum to nothing. Null and NaN values count as 0, and a column of such alone is null."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    total = F.sum(known(weight))
    mean = lambda c: F.when(total > 0, F.sum(known(weight) * F.coalesce(known(c), F.lit(0.0))) / total).otherwise(F.sum(known(c)) / F.count("*"))
    return df.groupBy(*keys).agg(*[F.when(F.count(known(c)) > 0, mean(c)).alias(f"weighted_{c}") for c in values])


def method_priors(paired: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Median ratio and mean wins of each method on validation rows; with `pool`, its rows with their method's priors, 1 and 0 where there are none."""
    priors = paired.filter("split = 'validation'").groupBy("method").agg(F.median("ade_ratio_to_linear").alias("prior_median_ratio"), F.avg("better_than_linear").alias("prior_mean_win"))
    if pool is None:
        return priors
    return pool.join(F.broadcast(priors), "method", "left").na.fill({"prior_median_ratio": 1.0, "prior_mean_win": 0.0})  # a row a method


def common_gaps(metrics: DataFrame, methods: Sequence[str]) -> DataFrame:
    """The ids of gaps that every one of the methods has a row for."""
    some = metrics.filter(F.col("method").isin(*methods))
    return some.groupBy("task_uid").agg(F.count_distinct("method").alias("_n")).filter(F.col("_n") == len(set(methods))).select("task_uid")


def guarded_paths(scored: DataFrame, most_ratio: float = 3.0, most_violation: float = 0.2, k: int = 5) -> DataFrame:
    """The candidates of a gap that pass the guards; where none does, its k that break them least. Adds guard_rank, by cost, and n_usable."""
    gap = Window.partitionBy("task_uid")
    ok = F.coalesce((F.col("path_ratio") <= most_ratio) & (F.col("step_violation_fraction") <= most_violation), F.lit(False))
    least = F.row_number().over(gap.orderBy("step_violation_fraction", "path_ratio", "total_cost", "candidate_order"))
    x = scored.withColumns({"_ok": ok, "_least": least}).withColumn("_any", F.max("_ok").over(gap)).filter(F.when(F.col("_any"), F.col("_ok")).otherwise(F.col("_least") <= k))
    return x.drop("_ok", "_least", "_any").withColumns({"guard_rank": F.row_number().over(gap.orderBy("total_cost", "candidate_order")), "n_usable": F.count("*").over(gap)})


def select_paths(scored: DataFrame, k: int = 5, k_mean: int = 20, beta: float = 0.5) -> DataFrame:
    """One row for each gap: its first k guarded candidates as an array, and the mean of the first k_mean weighted by exp(-beta cost)."""
    from gapweave.operators.families import softmax, weighted_mean

    entry = F.struct("guard_rank", "candidate_id", "total_cost", "path")
    lists = guarded_paths(scored, k=k).groupBy("task_uid").agg(F.array_sort(F.collect_list(entry)).alias("_a"))
    near = F.slice("_a", 1, k_mean)
    mean = weighted_mean(F.transform(near, lambda e: e["path"]), softmax(F.transform(near, lambda e: -e["total_cost"]), beta))
    return lists.select("task_uid", F.slice("_a", 1, k).alias("top"), F.size("_a").alias("n_usable"), mean.alias("path"))
