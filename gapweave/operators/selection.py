"""Method selection on validation rows, candidate sets, reporting labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of each family in a balanced set of ten, and the order of families.
QUOTA = {"motif_diverse_sr": 5, "latent_direct": 2, "ecological_constrained_decoder": 2, "ecological_step_selection": 1}
PREFIXES = {
    "motif_diverse_sr": "probabilistic_tg_diverse_sr_rank", "latent_direct": "direct_sr_conditional_latent_decoder_sample",
    "ecological_constrained_decoder": "ecological_tg_constrained_decoder", "ecological_step_selection": "ecological_tg_step_selection",
}


def selection_summary(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians, gains and win rates of each method, as method selection weighs them."""
    gain = 100.0 * (1.0 - F.col("ade_ratio_to_linear"))
    return paired.groupBy(*keys).agg(
        F.count_distinct("task_uid").alias("n_tasks"), F.median("ADE").alias("ADE_median"), F.median("RMSE").alias("RMSE_median"),
        F.median("path_length_log_error").alias("length_error"), F.median("delta_ADE_vs_linear").alias("delta_median"), F.avg("delta_ADE_vs_linear").alias("delta_mean"),
        F.avg("better_than_linear").alias("win_rate"), F.median("ade_ratio_to_linear").alias("ade_ratio"), F.median("rmse_ratio_to_linear").alias("rmse_ratio"),
        F.median(gain).alias("gain_pct"),
    )


def robust_global(paired: DataFrame, methods: Column, least_win: float = 0.55, most_ratio: float = 1.0) -> DataFrame:
    """The one method that validation rows favour: the eligible one of the best win rate, then ratios, then name."""
    val = selection_summary(paired.filter((F.col("split") == "validation") & methods), ["method"])
    ok = (F.col("win_rate") >= least_win) & (F.col("ade_ratio") <= most_ratio)
    order = [F.desc(ok.cast("int")), F.desc("win_rate"), "ade_ratio", "rmse_ratio", "length_error", "method"]
    reason = F.when(ok, "selected_global_robust").otherwise("best_available_no_global_eligible")
    return val.withColumn("selection_reason", F.coalesce(reason, F.lit("best_available_no_global_eligible"))).orderBy(*order).limit(1)


def selection_score() -> Column:
    return (
        -0.08 * F.coalesce("gain_pct", F.lit(-1e6)) - 0.75 * F.coalesce("win_rate", F.lit(0.0)) + 0.02 * F.coalesce("delta_median", F.lit(1e6))
        + 0.02 * F.coalesce("RMSE_median", F.lit(1e6)) + 0.35 * F.coalesce("length_error", F.lit(0.0))
    )


def guarded(paired: DataFrame, methods: Column, keys: Sequence[str], least_gain: float = 1.0, least_win: float = 0.52, most_worse: float = 0.0, least_pct: float = 1.0) -> DataFrame:
    """For each stratum the eligible method of the least selection score, from its own validation rows or, where none is
    eligible, from the coarser strata, at last from all. keys: from coarse to fine; rows keys, method, level."""
    val = paired.filter((F.col("split") == "validation") & methods)
    strata = val.select(*keys).distinct()
    found = []
    for depth in range(len(keys), -1, -1):
        own = list(keys[:depth])
        s = selection_summary(val, [*own, "method"]).withColumn("score", selection_score())
        ok = ((-F.col("delta_median") >= least_gain) | (F.col("gain_pct") >= least_pct)) & (F.col("win_rate") >= least_win) & (F.col("delta_mean") <= most_worse)
        s = s.filter(ok) if depth else s
        best = F.min_by("method", F.struct("score", "ADE_median", "RMSE_median", "method")).alias(f"_m{depth}")
        picked = s.groupBy(*own).agg(best) if own else s.agg(best)
        strata = strata.join(picked, own, "left") if own else strata.crossJoin(picked)  # one row
        found.append((depth, F.col(f"_m{depth}")))
    level = F.coalesce(*[F.when(c.isNotNull(), F.lit(d)) for d, c in found])
    return strata.select(*keys, F.coalesce(*[c for _, c in found]).alias("method"), level.alias("level"))


def apply_choice(paired: DataFrame, choices: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The rows of each stratum's chosen method under a new name, with where they are from."""
    rows = paired.join(choices.select(*keys, "method"), [*keys, "method"])
    return rows.withColumn("source_method", F.col("method")).withColumn("method", F.lit(name))


def topk_oracle(rows: DataFrame, sizes: Sequence[int] = (1, 3, 5, 10), rank: str = "source_rank", name: str = "topk") -> DataFrame:
    """For each gap and set size, the row of least error among the first ranks. A diagnostic that uses truth, and marked so."""
    sized = rows.withColumn("candidate_set_k", F.explode(F.array(*[F.lit(k) for k in sizes]))).filter(F.col(rank) <= F.col("candidate_set_k"))
    best = sized.groupBy("task_uid", "candidate_set_k").agg(F.min_by(F.struct("method", "ADE"), F.struct("ADE", "method")).alias("b"), F.count("*").alias("n_in_set"))
    return best.select(
        "task_uid", "candidate_set_k", F.concat(F.lit(f"{name}_top"), F.col("candidate_set_k"), F.lit("_minADE_candidate_set")).alias("method"),
        F.col("b.method").alias("source_method"), F.col("b.ADE").alias("ADE"), "n_in_set", F.lit(True).alias("oracle_within_generated_set"),
    )


def candidate_family(method: Column) -> Column:
    out = None
    for family, prefix in PREFIXES.items():
        hit = F.startswith(method, F.lit(prefix))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def balanced_set(rows: DataFrame, proxy: str, quota: dict[str, int] = QUOTA, size: int = 10) -> DataFrame:
    """Each gap's set: the best of each family up to its quota, then the best of the rest up to `size`. rows: task_uid, method, family."""
    quotas = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    by_family = Window.partitionBy("task_uid", "family").orderBy(proxy, "method")
    x = rows.withColumn("_in", F.row_number().over(by_family) <= F.coalesce(F.try_element_at(quotas, F.col("family")), F.lit(0)))
    w = Window.partitionBy("task_uid").orderBy(F.desc("_in"), proxy, "method")
    return x.withColumn("set_rank", F.row_number().over(w)).filter(F.col("set_rank") <= size).withColumnRenamed("_in", "by_quota")


#: What orders candidates of a pooled set without truth, with its weight.
PROXY = {
    "total_cost": 1.0, "score": 1.0, "cost": 1.0, "path_cost": 1.0, "ecological_energy": 0.75,
    "path_to_straight_ratio": 0.25, "directness": -0.25, "source_rank": 0.25, "candidate_rank": 0.25,
}


def proxy_score(rows: DataFrame) -> Column:
    """What orders candidates without truth: the figures of PROXY that a row has, its rank and its family's place.

    A row's rank is `source_rank`, 999 where there is none; null and NaN figures count nothing.
    """
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).otherwise(0.0)
    figures = [w * finite(c) for c, w in PROXY.items() if c in rows.columns]
    order = F.create_map(*[F.lit(x) for kv in {f: i for i, f in enumerate(PREFIXES)}.items() for x in kv])
    rank = F.coalesce(F.col("source_rank"), F.lit(999)) if "source_rank" in rows.columns else F.lit(999)
    return sum(figures, F.lit(0.0)) + 0.10 * rank + 0.20 * F.coalesce(F.try_element_at(order, F.col("family")), F.lit(9))


def pooled_oracle(kept: DataFrame, name: str = "balanced_pooled_extension_top10_minADE_candidate_set") -> DataFrame:
    """The row of least error of each gap's set, as a method of its own; it uses truth, and is marked so."""
    best = kept.groupBy("task_uid").agg(F.min_by(F.struct("method", "ADE"), F.struct("ADE", "method")).alias("b"), F.count("*").alias("n_in_set"))
    return best.select("task_uid", F.lit(name).alias("method"), F.col("b.method").alias("source_method"), F.col("b.ADE").alias("ADE"), "n_in_set", F.lit(True).alias("oracle_within_generated_set"))


#: How many ranks of diverse and of latent paths an expanded set unites.
UNIONS = ((3, 3), (5, 5), (10, 10))


def expanded_oracle(rows: DataFrame, unions: Sequence[tuple[int, int]] = UNIONS) -> DataFrame:
    """For each gap and union the row of least error among the first ranks of diverse and of latent paths; it uses truth, and is marked so.

    rows: task_uid, method, family, source_rank, ADE. A set is named by how many methods it
    unites over all gaps. No rows where either family has none; null and NaN errors never win.
    """
    diverse = F.col("family") == "motif_diverse_sr"
    some = rows.filter(F.col("family").isin("motif_diverse_sr", "latent_direct")).withColumn("_p", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in unions])))
    sized = some.filter(F.col("source_rank") <= F.when(diverse, F.col("_p.a")).otherwise(F.col("_p.b")))
    names = sized.groupBy("_p").agg(F.count_distinct(F.when(diverse, F.col("method"))).alias("diverse_sr_k"), F.count_distinct(F.when(~diverse, F.col("method"))).alias("latent_direct_k"))
    whole = rows.agg((F.count_if(diverse) > 0).alias("_d"), (F.count_if(F.col("family") == "latent_direct") > 0).alias("_l")).filter("_d AND _l")
    names = names.crossJoin(whole)  # a row a union, one row
    best = sized.filter(F.col("ADE").isNotNull() & ~F.isnan("ADE")).groupBy("task_uid", "_p").agg(F.min_by(F.struct("method", "ADE"), F.struct("ADE", "method")).alias("b")).join(F.broadcast(names), "_p")
    k = F.col("diverse_sr_k") + F.col("latent_direct_k")
    return best.select(
        "task_uid", F.concat(F.lit("expanded_sr_top"), k, F.lit("_minADE_candidate_set")).alias("method"), F.col("b.method").alias("source_method"), F.col("b.ADE").alias("ADE"),
        k.alias("candidate_set_k"), "diverse_sr_k", "latent_direct_k", F.lit(True).alias("oracle_within_generated_set"),
    )


#: What reports call the methods.
LABELS = {
    "linear": "Linear", "heading_hermite": "Heading Hermite", "brownian_bridge": "Brownian bridge", "rtg_bridge": "RTG bridge",
    "pretrained_motif_robust_global": "Motif (robust)", "balanced_pooled_extension_top10_minADE_candidate_set": "Balanced top-10 set",
}


def reported(metrics: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """Rows of the reported methods, relabelled; candidate sets are not deployable."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    out = metrics.filter(F.col("method").isin(list(labels)))
    return out.withColumn("paper_label", F.try_element_at(names, F.col("method"))).withColumn("is_deployable_top1", ~F.contains(F.col("method"), F.lit("candidate_set")))
