"""Movement priors, candidate paths, their costs, ranks and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions import geometry as g
from gapweave.functions.ids import make_uid

LEVELS = (("dataset_taxon_setting", ("dataset", "taxon", "setting_name")), ("dataset_taxon", ("dataset", "taxon")), ("taxon", ("taxon",)), ("global", ()))
MAX_CANDIDATES = 45
#: Mirror and lateral scale of the variants of a motif, in order.
VARIANTS = tuple((mirror, scale) for mirror in (False, True) for scale in (0.75, 1.0, 1.2))
#: Weights of the cost terms.
PROFILE = {
    "motif": 1.00, "step": 0.95, "turn": 0.35, "detour": 0.45, "directness": 0.20, "lateral": 0.25, "timegeo": 1.10,
    "progress": 0.35, "origin": 0.45, "context": 0.60, "direction": 0.25, "efficiency": 0.35, "source_shape": 0.25,
}


def movement_priors(tasks: DataFrame) -> DataFrame:
    """Quantiles of steps, path ratios and directness at four levels, in one pass of grouping sets each.

    Rows level, key, n_steps, n_tasks, step_q50/90/95, path_ratio_q25/50/75/90, directness_q25/50/75.
    """
    t = tasks.filter(F.size("truth") > 1).select("task_uid", "dataset", "taxon", "setting_name", g.path_ratio(F.col("truth")).alias("ratio"), g.directness(F.col("truth")).alias("directness"), g.steps(F.col("truth")).alias("steps"))
    keys = ["dataset", "taxon", "setting_name"]
    sets = [[F.col(c) for c in cols] for _, cols in LEVELS]
    q = lambda c, *at: F.percentile(c, F.array(*[F.lit(x) for x in at]))
    gid = F.grouping_id(*keys).alias("gid")
    by_step = t.select(*keys, F.explode("steps").alias("step")).groupingSets(sets, *keys).agg(gid, F.count("*").alias("n_steps"), q("step", 0.5, 0.9, 0.95).alias("s"))
    by_task = t.groupingSets(sets, *keys).agg(gid, F.count("*").alias("n_tasks"), q(F.when(F.col("ratio") > 0, F.col("ratio")), 0.25, 0.5, 0.75, 0.9).alias("r"), q("directness", 0.25, 0.5, 0.75).alias("d"))
    same = F.col("a.gid") == F.col("b.gid")
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = by_step.alias("a").join(by_task.alias("b"), same)
    gids = {0: "dataset_taxon_setting", 1: "dataset_taxon", 5: "taxon", 7: "global"}
    level = F.create_map(*[F.lit(x) for kv in gids.items() for x in kv])[F.col("a.gid").cast("int")]
    key = F.when(F.col("a.gid") == 7, "global").otherwise(F.concat_ws("|", "a.dataset", "a.taxon", "a.setting_name"))
    one = lambda c, i: F.coalesce(F.col(c)[i], F.lit(1.0))
    return both.select(
        level.alias("level"), key.alias("key"), "n_steps", "n_tasks", *[F.col("s")[i].alias(f"step_q{x}") for i, x in enumerate((50, 90, 95))],
        *[one("r", i).alias(f"path_ratio_q{x}") for i, x in enumerate((25, 50, 75, 90))], *[one("d", i).alias(f"directness_q{x}") for i, x in enumerate((25, 50, 75))],
    )


def with_priors(tasks: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds prior: the row of the finest level that has the gap's labels. Priors have a row per label, so Spark broadcasts them if they are small."""
    out, found = tasks, []
    for i, (level, cols) in enumerate(LEVELS):
        row = priors.filter(F.col("level") == level).select(F.col("key").alias(f"_k{i}"), F.struct(*priors.columns).alias(f"_p{i}"))
        key = F.concat_ws("|", *cols) if cols else F.lit("global")
        out = out.join(row, key == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_p{i}"))
    return out.withColumn("prior", F.coalesce(*found)).drop(*[f"_{x}{i}" for i in range(len(LEVELS)) for x in "kp"])


def candidates(tasks: DataFrame, hits: DataFrame, motifs: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """The candidate paths of each gap: the chord, heading continuity, then the motifs' variants, at most `most`,
    without paths that equal an earlier one of their style to a millimetre."""
    s, e, n = F.col("start"), F.col("end"), F.col("n_points")
    keep = ["task_uid", "dataset", "taxon", "setting_name", "n_points", "start", "end", "prev", "next", "truth", *(["prior"] if "prior" in tasks.columns else [])]
    turn = F.col("prev").isNotNull() | F.col("next").isNotNull()
    zero = [F.lit(0.0).alias(c) for c in ("context_temporal_cost", "context_environment_cost", "context_demographic_cost")]

    def inner(style: str, order: int, path: Column, score: float, scale: float, ratio: float | None) -> DataFrame:
        return tasks.select(
            *keep, F.lit(style).alias("style"), F.lit(order).alias("place"), path.alias("path"), F.lit(style).alias("motif_id"), F.lit(0).alias("retrieval_rank"),
            F.lit(score).alias("retrieval_score"), F.lit(scale).alias("lateral_scale"), F.lit(False).alias("mirror"), F.lit(ratio).cast("double").alias("source_path_ratio"),
            F.lit(0.0).alias("source_lateral_sign"), F.lit(0.0).alias("source_lateral_abs"), *zero,
        )

    direct = inner("direct_identity", 0, g.linear_path(s, e, n), 0.12, 0.0, 1.0)
    headed = inner("heading_continuity", 1, g.hermite_path(s, e, n, F.col("prev"), F.col("next")), 0.18, 1.0, None).filter(turn)
    variants = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(m).alias("mirror"), F.lit(x).alias("scale")) for i, (m, x) in enumerate(VARIANTS)])
    few = hits.filter(F.col("retrieval_rank") <= -(-most // len(VARIANTS)))
    shapes = motifs.select("motif_id", "frame", "motif_path_ratio", "motif_lateral_sign", "motif_lateral_abs")
    taken = few.join(tasks.select(*keep), "task_uid").join(shapes, "motif_id")
    laid = taken.withColumn("shape", g.resample(F.col("frame"), n)).withColumn("w", F.explode(variants))
    sign = F.when(F.col("w.mirror"), -1.0).otherwise(1.0)
    place = turn.cast("int") + 1 + (F.col("retrieval_rank") - 1) * len(VARIANTS) + F.col("w.v")
    moved = laid.select(
        *keep, F.lit("retrieved_motif").alias("style"), place.alias("place"), g.out_of_frame(F.col("shape"), s, e, F.col("w.scale") * sign).alias("path"), "motif_id", "retrieval_rank",
        "retrieval_score", F.col("w.scale").alias("lateral_scale"), F.col("w.mirror").alias("mirror"), F.col("motif_path_ratio").alias("source_path_ratio"),
        (F.col("motif_lateral_sign") * sign).alias("source_lateral_sign"), F.col("motif_lateral_abs").alias("source_lateral_abs"),
        "context_temporal_cost", "context_environment_cost", "context_demographic_cost",
    ).filter(F.col("place") < most)
    return numbered(direct.unionByName(headed).unionByName(moved))


def numbered(found: DataFrame) -> DataFrame:
    """Drops repeated paths of a style and numbers the rest; ids name the gap, place, motif and variant.

    A gap has few candidates, so they are compared within one array; the gap's rows stay where they are for what follows.
    """
    digits = F.transform("path", lambda p: F.struct(F.bround(p.x, 3), F.bround(p.y, 3)))
    rest = [c for c in found.columns if c != "task_uid"]
    entry = F.struct("place", F.col("style").alias("_s"), digits.alias("_d"), F.struct(*rest).alias("_r"))
    lists = found.groupBy("task_uid").agg(F.sort_array(F.collect_list(entry)).alias("_a"))
    twin = lambda c, i: F.exists(F.slice("_a", F.lit(1), i), lambda e: (e["_s"] == c["_s"]) & (e["_d"] == c["_d"]))
    first = lists.select("task_uid", F.posexplode(F.filter("_a", lambda c, i: ~twin(c, i))).alias("candidate_order", "_e")).select("task_uid", "_e._r.*", "candidate_order")
    uid = make_uid(F.col("task_uid"), F.lit("motif_timegeo_sr"), F.col("place"), F.col("motif_id"), F.initcap(F.col("mirror").cast("string")), F.col("lateral_scale"), F.col("style"))
    return first.withColumn("candidate_id", uid)


def side(tasks_start: Column, end: Column, before: Column, after: Column) -> Column:
    """The side to which the legs around a gap bend: the sign of the mean of their signs."""
    lateral = lambda v: F.signum(v.y * (end.x - tasks_start.x) - v.x * (end.y - tasks_start.y))
    into = F.when(before.isNotNull(), lateral(g.point(tasks_start.x - before.x, tasks_start.y - before.y)))
    out = F.when(after.isNotNull(), lateral(g.point(after.x - end.x, after.y - end.y)))
    return F.when(g.distance(tasks_start, end) > g.EPS, F.signum(F.coalesce(into, F.lit(0.0)) + F.coalesce(out, F.lit(0.0)))).otherwise(0.0)


def costs(found: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds the thirteen cost terms of each candidate (cost_*), its shape figures and step capacity."""
    tiny = F.lit(g.EPS)
    x = found if "prior" in found.columns else with_priors(found, priors)
    x = x.withColumns(
        {
            "steps": g.steps(F.col("path")), "shape": g.in_frame(F.col("path"), F.col("start"), F.col("end")), "disp": g.distance(F.col("start"), F.col("end")),
            "capacity": F.coalesce(F.greatest(F.col("prior.step_q90") * 1.10, F.lit(1.0)), F.lit(1.0)),
            "prior_ratio": F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(6.0), F.col("prior.path_ratio_q50"))), F.lit(1.0)),
            "prior_directness": F.coalesce(F.greatest(F.lit(0.02), F.least(F.lit(1.0), F.col("prior.directness_q50"))), F.lit(1.0)),
        }
    )
    x = x.withColumns({"path_length_m": g.total(F.col("steps")), "step_q90": g.quantile(F.col("steps"), 0.9), "step_mean": g.mean(F.col("steps")), **g.lateral_stats(F.col("shape"))})
    ratio = F.col("path_length_m") / F.greatest(F.col("disp"), tiny)
    x = x.withColumns({"path_ratio": ratio, "directness": F.when(F.col("path_length_m") > g.EPS, g.chord(F.col("path")) / F.col("path_length_m"))})
    cap, src, style = F.col("capacity"), F.col("source_path_ratio"), F.col("style")
    clip = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    borrowed = (style == "retrieved_motif") & (src > 0)
    expected = F.when(borrowed, 0.5 + 0.25 * clip(F.col("prior_ratio"), 1.0, 2.5) + 0.25 * clip(src, 1.0, 2.5)).otherwise(0.7 + 0.3 * clip(F.col("prior_ratio"), 1.0, 2.0))
    usual = F.greatest(F.lit(1.0), F.least(F.greatest(F.col("disp") / F.greatest(F.size("path") - 1, F.lit(1)), F.lit(1.0)), F.greatest(cap, F.lit(1.0))))
    log_ratio = F.log(F.greatest(F.col("path_ratio"), tiny))
    bend = side(F.col("start"), F.col("end"), F.col("prev"), F.col("next"))
    wanted = F.when(bend != 0, bend).when(F.col("source_lateral_abs") >= 0.02, F.col("source_lateral_sign")).otherwise(0.0)
    over = F.transform("steps", lambda v: F.pow(F.greatest(v - cap, F.lit(0.0)) / cap, F.lit(2.0)))
    least = F.when(style == "direct_identity", 0.16).when(style == "heading_continuity", 0.20).when(style == "fallback_linear", 1.0).otherwise(0.0)
    terms = {
        "motif": F.greatest(F.col("retrieval_score"), least),
        "step": F.abs(F.log((F.col("step_mean") + 1e-6) / (usual + 1e-6))) + F.greatest(F.lit(0.0), F.col("step_q90") / F.greatest(cap, F.lit(1e-6)) - 1.0),
        "turn": g.turns(F.col("path")),
        "detour": F.abs(log_ratio - F.log(clip(expected, 1.0, 2.5))),
        "directness": F.coalesce(F.abs(F.col("directness") - F.col("prior_directness")), F.lit(0.0)),
        "lateral": F.col("mean_abs_lateral") + 0.5 * F.col("max_abs_lateral"),
        "timegeo": g.mean(over),
        "progress": F.col("backtrack"),
        "origin": F.when(style == "direct_identity", 0.35).when(style == "heading_continuity", 0.25).when(style == "fallback_linear", 1.0).otherwise(0.0),
        "context": 0.40 * F.col("context_temporal_cost") + 0.45 * F.col("context_environment_cost") + 0.25 * F.col("context_demographic_cost"),
        "direction": ((F.col("mean_abs_lateral") >= 0.03) & (wanted != 0) & (F.col("lateral_sign") != 0) & (F.col("lateral_sign") != wanted)).cast("double"),
        "efficiency": F.abs(log_ratio),
        "source_shape": F.when(borrowed, F.abs(log_ratio - F.log(F.greatest(F.least(src, F.lit(2.5)), tiny)))).otherwise(0.0),
    }
    violation = g.mean(F.transform("steps", lambda v: (v > cap).cast("double")))
    return x.withColumns({f"cost_{k}": c for k, c in terms.items()} | {"step_violation_fraction": violation}).drop("shape", "steps", "prior")


def score(found: DataFrame, priors: DataFrame, profile: dict[str, float] = PROFILE) -> DataFrame:
    """Adds total_cost to nine digits, rank (ties, such as mirrored paths, by candidate order) and listwise_probability."""
    x = costs(found, priors)
    cost = sum((F.lit(w) * F.coalesce(F.col(f"cost_{k}"), F.lit(0.0)) for k, w in profile.items()), F.lit(0.0))
    return ranked(x.withColumn("total_cost", F.round(cost, 9)))


def ranked(x: DataFrame, cost: str = "total_cost", order: str = "candidate_order") -> DataFrame:
    """Ranks a gap's rows by cost and gives each its share of exp(-cost)."""
    w = Window.partitionBy("task_uid")
    x = x.withColumns({"rank": F.row_number().over(w.orderBy(cost, order)), "_z": F.min(cost).over(w) - F.col(cost)})
    return x.withColumn("listwise_probability", F.exp("_z") / F.sum(F.exp("_z")).over(w)).drop("_z")


def diversity_threshold(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(75.0), 0.08 * g.distance(start, end)))


def half_sine(t: Column, phase: float = 0.0) -> Column:
    return F.sin(math.pi * t + phase)
