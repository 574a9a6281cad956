"""Path evaluation against truth, the paired linear baseline, and summaries by any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions import geometry as g

#: Metric columns and what their ratios to the baseline are called.
PAIRED = {
    "ADE": "ade", "RMSE": "rmse", "spatial_RMSE": "spatial_rmse", "Frechet": "frechet", "DTW": "dtw",
    "path_length_log_error": "path_length_log_error", "directness_error": "directness_error",
}


def baselines(tasks: DataFrame) -> DataFrame:
    """One row for each gap and closed-form baseline: linear, heading_hermite, rtg_bridge."""
    s, e, n = F.col("start"), F.col("end"), F.col("n_points")
    paths = F.array(
        F.struct(F.lit("linear").alias("method"), g.linear_path(s, e, n).alias("path")),
        F.struct(F.lit("heading_hermite").alias("method"), g.hermite_path(s, e, n, F.col("prev"), F.col("next")).alias("path")),
        F.struct(F.lit("rtg_bridge").alias("method"), g.rtg_path(s, e, n).alias("path")),
    )
    return tasks.withColumn("_p", F.explode(paths)).select(*tasks.columns, "_p.method", "_p.path")


def evaluate(paths: DataFrame, couplings: bool = False) -> DataFrame:
    """Adds the metrics of each path against its truth; with `couplings` also Fréchet and DTW."""
    p, t = F.col("path"), F.col("truth")
    out = paths.withColumns({"path_length_m": g.path_length(p), "truth_path_length_m": g.path_length(t), "_d": g.directness(p), "_td": g.directness(t)})
    length, truth = F.col("path_length_m"), F.col("truth_path_length_m")
    known = truth > g.EPS
    more = {"Frechet": g.frechet(p, t), "DTW": g.dtw(p, t)} if couplings else {}
    out = out.withColumns(
        {
            "ADE": g.ade(p, t), "RMSE": g.rmse(p, t), "spatial_RMSE": g.spatial_rmse(p, t), **more,
            "path_length_log_error": F.abs(F.log((length + 1.0) / (truth + 1.0))),
            "path_length_ratio": F.when(known, length / truth),
            "path_length_ratio_error": F.when(known, F.abs(F.log(F.greatest(length, F.lit(g.EPS)) / truth))),
            "directness_error": F.abs(F.col("_d") - F.col("_td")),
        }
    )
    return out.withColumns({"within_50m": (F.col("ADE") <= 50).cast("double"), "within_100m": (F.col("ADE") <= 100).cast("double")}).drop("_d", "_td")


def add_linear(metrics: DataFrame, baseline: str = "linear") -> DataFrame:
    """Adds each metric's ratio to, and gain over, the same gap's baseline."""
    have = [c for c in PAIRED if c in metrics.columns]
    gap = Window.partitionBy("task_uid")
    out = metrics.withColumns({f"linear_{c}": F.max(F.when(F.col("method") == baseline, F.col(c))).over(gap) for c in have})
    ratio = {f"{PAIRED[c]}_ratio_to_linear": F.try_divide(F.col(c), F.nullif(F.col(f"linear_{c}"), F.lit(0.0))) for c in have}
    out = out.withColumns(ratio)
    out = out.withColumns({f"{PAIRED[c]}_gain_pct_vs_linear": 100.0 * (1.0 - F.col(f"{PAIRED[c]}_ratio_to_linear")) for c in have})
    delta = F.col("ADE") - F.col("linear_ADE")
    return out.withColumns({"delta_ADE_vs_linear": delta, "better_than_linear": F.coalesce((delta < 0).cast("double"), F.lit(0.0))})


def summary(metrics: DataFrame, keys: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Counts, means, medians and rates of paired metrics by any keys.

    Medians are exact, so all distinct values of a group end in one task; `accuracy` asks for sketches instead, whose
    ranks are off by one in so many at most, for groups that no task can hold.
    """
    median = lambda c: F.percentile_approx(c, 0.5, accuracy) if accuracy else F.median(c)
    stats: list[Column] = [F.count_distinct("task_uid").alias("n_tasks")]
    for c in ("ADE", "RMSE"):
        stats += [F.avg(c).alias(f"{c}_mean"), median(c).alias(f"{c}_median")]
    stats += [median(c).alias(f"{c}_median") for c in ("path_length_log_error", "path_length_ratio_error", "directness_error", "Frechet", "DTW") if c in metrics.columns]
    stats += [F.avg("within_50m").alias("within_50m_rate"), F.avg("within_100m").alias("within_100m_rate"), F.avg("better_than_linear").alias("better_than_linear_rate")]
    for c in ("ade", "rmse", "frechet", "dtw"):
        if f"{c}_ratio_to_linear" in metrics.columns:
            for kind in ("ratio_to_linear", "gain_pct_vs_linear"):
                stats += [median(f"{c}_{kind}").alias(f"{c}_{kind}_median"), F.avg(f"{c}_{kind}").alias(f"{c}_{kind}_mean")]
    return metrics.groupBy(*keys).agg(*stats)


def formal_summary(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, mean and upper quantiles of the error; the baseline's own win rate is 0."""
    out = metrics.groupBy(*keys).agg(
        F.count_distinct("task_uid").alias("n_tasks"), F.avg("ADE").alias("ADE_mean"),
        F.percentile("ADE", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("_q"), F.avg("better_than_linear").alias("_win"),
    )
    win = F.when(F.col("method") == "linear", 0.0).otherwise(F.col("_win")) if "method" in keys else F.col("_win")
    return out.withColumns({f"ADE_q{q}": F.col("_q")[i] for i, q in enumerate((50, 75, 90))}).withColumn("better_than_linear_rate", win).drop("_q", "_win")


def pivot_methods(metrics: DataFrame, value: str, methods: Sequence[str]) -> DataFrame:
    """One row for each gap, one column for each method."""
    return metrics.groupBy("task_uid").pivot("method", list(methods)).agg(F.first(value))


def metric_bundle(paired: DataFrame, folder: str, prefix: str, keys: dict[str, Sequence[str]] | None = None) -> None:
    """Writes the metrics and their summaries by method, setting, species and individual."""
    keys = keys or {"method": ["method"], "setting": ["dataset", "taxon", "setting_name", "method"], "species": ["taxon", "method"], "individual": ["dataset", "animal_id", "method"]}
    rows = paired.persist()
    rows.write.mode("overwrite").parquet(f"{folder}/{prefix}_task.parquet")
    for name, by in keys.items():
        summary(rows, by).write.mode("overwrite").parquet(f"{folder}/{prefix}_{name}.parquet")
    rows.unpersist()
