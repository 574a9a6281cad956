"""Motif library: gap descriptors, standardizing, exact k-nearest neighbours, context re-ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions import context, geometry as g
from gapweave.functions.ids import make_uid, sex_label
from gapweave.operators.splits import first_by_hash

MAX_MOTIFS = 25_000
PER_TASK, PREFETCH = 20, 8
#: Weights of the retrieval score.
DESCRIPTOR_WEIGHT, TAXON_PENALTY, DATASET_PENALTY = 0.85, 0.12, 0.05
TEMPORAL_WEIGHT, ENVIRONMENT_WEIGHT, DEMOGRAPHIC_WEIGHT = 0.12, 0.22, 0.08
#: Library rows that are held by an executor at once.
BLOCK = 50_000


def heading(vec: Column, size: Column, base: Column, base_size: Column) -> tuple[Column, Column, Column]:
    """Alignment of a leg with the gap's chord, its absolute lateral part, and the log ratio of their lengths; 0 without either."""
    ok = vec.isNotNull() & (base_size > g.EPS) & (size > g.EPS)
    cos = (vec.x * base.x + vec.y * base.y) / (size * base_size)
    sin = (vec.y * base.x - vec.x * base.y) / (size * base_size)
    zero = F.lit(0.0)
    return F.when(ok, cos).otherwise(zero), F.when(ok, F.abs(sin)).otherwise(zero), F.when(ok, F.log((size + 1) / (base_size + 1))).otherwise(zero)


def descriptor(tasks: DataFrame, leaky: bool = False) -> dict[str, Column]:
    """The descriptor of a gap, in order. Its shape part uses hidden truth only if `leaky`."""
    s, e, p, n = (F.col(c) for c in ("start", "end", "prev", "next"))
    d = g.distance(s, e)
    base = g.point(e.x - s.x, e.y - s.y)
    into, out = F.when(p.isNotNull(), g.point(s.x - p.x, s.y - p.y)), F.when(n.isNotNull(), g.point(n.x - e.x, n.y - e.y))
    size = lambda v: F.sqrt(v.x * v.x + v.y * v.y)
    ia, il, ir = heading(into, size(into), base, d)
    oa, ol, orr = heading(out, size(out), base, d)
    shape = F.coalesce(g.directness(F.col("truth")), F.lit(1.0)) if leaky else F.lit(1.0)
    sex = sex_label(F.col("sex")) if "sex" in tasks.columns else F.lit("unknown")
    age = F.lower(F.col("age_class")) if "age_class" in tasks.columns else F.lit("unknown")
    out_ = {
        "n_points_scaled": F.col("n_points") / 20.0, "log_coarse_dt": F.log1p("coarse_dt_min"), "log_fine_dt": F.log1p("fine_dt_min"),
        "log_displacement": F.log1p(d), "log_base_step": F.log1p(d / F.greatest(F.col("n_points") - 1, F.lit(1))), "endpoint_directness_proxy": shape,
        "prev_step_log_ratio": ir, "next_step_log_ratio": orr, "has_prev": p.isNotNull().cast("double"), "has_next": n.isNotNull().cast("double"),
        "incoming_alignment": ia, "outgoing_alignment": oa, "incoming_lateral_abs": il, "outgoing_lateral_abs": ol,
    }
    times = context.temporal(F.col("start_time"), F.col("end_time"))
    out_ |= {k: c for k, c in times.items() if k.endswith(("_sin", "_cos"))}
    return out_ | {
        "context_sex_female": (sex == "female").cast("double"), "context_sex_male": (sex == "male").cast("double"),
        "context_age_adult": (age.contains("adult") & ~age.contains("sub")).cast("double"), "context_age_subadult": age.contains("sub").cast("double"),
    }


def described(tasks: DataFrame, leaky: bool = False) -> DataFrame:
    """Adds features, the descriptor as an array; mid_*, month_*, diel_bin; and the gap's mean elevation at its ends."""
    found = descriptor(tasks, leaky)
    times = context.temporal(F.col("start_time"), F.col("end_time"))
    features = F.array(*[F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in found.values()])
    keep = {k: times[k] for k in ("mid_hour_sin", "mid_hour_cos", "month_sin", "month_cos", "diel_bin")}
    first, last = F.element_at("truth_env", 1), F.element_at("truth_env", -1)
    return tasks.withColumns({"features": features, **keep, "env_mean": (first + last) / 2, "env_delta": last - first})


def build(tasks: DataFrame, max_motifs: int | None = MAX_MOTIFS, leaky: bool = False) -> DataFrame:
    """The motifs of gaps with truth: labels, features, context, normalized shape and its figures.

    A larger training set is cut to max_motifs by the hash of the gap's id; with None all gaps are motifs.
    """
    known = tasks.filter(F.size("truth") > 1)
    some = known if max_motifs is None else first_by_hash(known, "task_uid", max_motifs)
    d = described(some, leaky).withColumn("frame", g.frame(F.col("truth")))
    y = F.transform(F.when(F.size("frame") > 2, F.slice("frame", F.lit(2), F.size("frame") - 2)).otherwise(F.col("frame")), lambda p: p.y)
    lateral = g.mean(y)
    return d.select(
        make_uid(F.lit("motif"), F.col("task_uid")).alias("motif_id"), F.col("task_uid").alias("source_task_uid"), "dataset", "taxon", "animal_id", "setting_name", "sex",
        "n_points", "features", "mid_hour_sin", "mid_hour_cos", "month_sin", "month_cos", "diel_bin", "env_mean", "env_delta", "frame",
        g.path_ratio(F.col("truth")).alias("motif_path_ratio"), g.directness(F.col("truth")).alias("motif_directness"), lateral.alias("motif_lateral_mean"),
        g.mean(F.transform(y, lambda v: F.abs(v))).alias("motif_lateral_abs"), F.when(F.abs(lateral) >= 1e-4, F.signum(lateral)).otherwise(0.0).alias("motif_lateral_sign"),
    )


def scaler(df: DataFrame, features: str, size: int) -> list[tuple[float, float]]:
    """Mean and population deviation of each feature; a deviation of zero counts as one."""
    at = [F.get(features, F.lit(i)) for i in range(size)]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).collect()[0]
    return [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i in range(size)]


def scaled(features: Column, by: Sequence[tuple[float, float]]) -> Column:
    means, devs = F.array(*[F.lit(m) for m, _ in by]), F.array(*[F.lit(s) for _, s in by])
    return F.zip_with(F.zip_with(features, means, lambda v, m: v - m), devs, lambda v, s: v / s)


def nearest(queries: DataFrame, library: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k library rows nearest to each query by Euclidean distance, exact; ties go to the smaller id.

    Both have id and vec. Library and queries are dealt into blocks; each pair of a block of either meets in one cell on
    an executor, whose queries keep their k best there, and the best of those remain. Nothing goes through the driver, a
    cell holds `block` library rows at most, about.
    """
    tasks = int(library.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-library.count() // block))
    groups = max(1, -(-tasks // blocks))
    deal = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = library.select(deal(library, blocks).alias("lib"), every(groups).alias("grp"), F.lit(None).cast(dict(queries.dtypes)["id"]).alias("id"), F.col("id").alias("hit"), "vec")
    asks = queries.select(every(blocks).alias("lib"), deal(queries, groups).alias("grp"), "id", F.lit(None).cast(dict(library.dtypes)["id"]).alias("hit"), "vec")
    dealt = rows.unionByName(asks).repartition(max(tasks, blocks * groups), "lib", "grp").sortWithinPartitions("lib", "grp", F.col("hit").isNull(), "hit")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ids, parts, mat = None, [], [], None
        for x in frames:
            for key, some in x.groupby(["lib", "grp"], sort=True):
                if key != cell:
                    cell, ids, parts, mat = key, [], [], None
                own = some["hit"].notna().to_numpy()
                if own.any():
                    ids += some["hit"][own].tolist()
                    parts.append(np.array(some["vec"][own].tolist(), float))
                if not own.all() and ids:
                    mat = np.concatenate(parts) if mat is None else mat
                    yield from cell_nearest(some[~own], ids, mat, k)

    found = dealt.mapInPandas(run, f"id {dict(queries.dtypes)['id']}, hit {dict(library.dtypes)['id']}, distance double")
    w = Window.partitionBy("id").orderBy("distance", "hit")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cell_nearest(asks: pd.DataFrame, ids: list, mat: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k nearest of the rows `mat`, in order of their ids, to each of the queries."""
    top, norms, names = min(k, len(ids)), (mat * mat).sum(axis=1), np.array(ids, object)
    for at in range(0, len(asks), 256):
        some = asks.iloc[at : at + 256]
        q = np.array(some["vec"].tolist(), float)
        rough = norms - 2 * q @ mat.T
        least = np.partition(rough, top - 1, axis=1)[:, top - 1] + 1e-9 * (norms.max() + (q * q).sum(axis=1))
        row, near = np.nonzero(rough <= least[:, None])  # all ties of the last place take part, by exact distance and id
        exact = np.sqrt(((mat[near] - q[row]) ** 2).sum(axis=1))
        order = np.lexsort((near, exact, row))
        place = np.arange(len(order)) - np.searchsorted(row, np.arange(len(q)))[row]
        order = order[place < top]
        yield pd.DataFrame({"id": some["id"].to_numpy()[row[order]], "hit": names[near[order]], "distance": exact[order]})


def context_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Robust scale of each column: the larger of 1.4826 MAD and IQR / 1.349; none for fewer than five values."""
    q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns], *[F.count(c).alias(f"n_{c}") for c in columns]).collect()[0]
    have = [c for c in columns if q[f"n_{c}"] >= 5]
    if not have:
        return {}
    mad = df.agg(*[F.median(F.abs(F.col(c) - q[c][1])).alias(c) for c in have]).collect()[0]
    return {c: max(1.4826 * mad[c], (q[c][2] - q[c][0]) / 1.349, 1e-6) for c in have}


def context_costs(scales: dict[str, float]) -> tuple[Column, Column, Column]:
    """Temporal, environmental and demographic mismatch of a gap t and a motif m."""
    t, m = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"m.{c}"))
    cyc = lambda c: context.cyclic_distance(t(f"{c}_sin"), t(f"{c}_cos"), m(f"{c}_sin"), m(f"{c}_cos"))
    time = cyc("mid_hour") + 0.75 * cyc("month") + F.when(t("diel_bin") == m("diel_bin"), 0.0).otherwise(0.25)
    terms = []
    for c in ("env_mean", "env_delta"):
        scale = F.lit(scales[c]) if c in scales else F.greatest(F.abs(t(c)), F.abs(m(c)), F.lit(1.0))
        terms.append(F.when(t(c).isNotNull() & m(c).isNotNull(), F.least(F.abs(t(c) - m(c)) / scale, F.lit(5.0))))
    env = F.coalesce(g.mean(F.filter(F.array(*terms), lambda v: v.isNotNull())), F.lit(0.0))
    a, b = sex_label(t("sex")), sex_label(m("sex"))
    return time, env, F.when((a != "unknown") & (b != "unknown") & (a != b), 1.0).otherwise(0.0)


def retrieve(tasks: DataFrame, motifs: DataFrame, per_task: int = PER_TASK, prefetch: int = PREFETCH, leaky: bool = False) -> DataFrame:
    """The best motifs of each gap: the nearest per_task * prefetch, re-ranked by labels and context.

    Rows task_uid, motif_id, retrieval_rank, retrieval_score, descriptor_distance and the three context costs.
    """
    d = described(tasks, leaky)
    size = len(descriptor(tasks))
    by = scaler(motifs, "features", size)
    queries = d.select(F.col("task_uid").alias("id"), scaled(F.col("features"), by).alias("vec"))
    hits = nearest(queries, motifs.select(F.col("motif_id").alias("id"), scaled(F.col("features"), by).alias("vec")), per_task * prefetch)
    scales = context_scales(motifs, ["env_mean", "env_delta"])
    labels = ["dataset", "taxon", "sex", "mid_hour_sin", "mid_hour_cos", "month_sin", "month_cos", "diel_bin", "env_mean", "env_delta"]
    t, m = d.select("task_uid", *labels).alias("t"), motifs.select("motif_id", *labels).alias("m")
    joined = hits.alias("h").join(t, F.col("h.id") == F.col("t.task_uid")).join(m, F.col("h.hit") == F.col("m.motif_id"))
    time, env, demo = context_costs(scales)
    scored = joined.select(
        "task_uid", "motif_id", F.col("distance").alias("descriptor_distance"), F.col("rank").alias("stage"), time.alias("context_temporal_cost"), env.alias("context_environment_cost"),
        demo.alias("context_demographic_cost"),
        (F.when(F.col("t.taxon") == F.col("m.taxon"), 0.0).otherwise(TAXON_PENALTY) + F.when(F.col("t.dataset") == F.col("m.dataset"), 0.0).otherwise(DATASET_PENALTY)).alias("penalty"),
    ).withColumn(
        "retrieval_score",
        DESCRIPTOR_WEIGHT * F.col("descriptor_distance") + F.col("penalty") + TEMPORAL_WEIGHT * F.col("context_temporal_cost")
        + ENVIRONMENT_WEIGHT * F.col("context_environment_cost") + DEMOGRAPHIC_WEIGHT * F.col("context_demographic_cost"),
    )
    w = Window.partitionBy("task_uid").orderBy("retrieval_score", "stage")
    return scored.withColumn("retrieval_rank", F.row_number().over(w)).filter(F.col("retrieval_rank") <= per_task).drop("stage", "penalty")
