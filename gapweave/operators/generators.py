"""Seeded path generators: residual artifacts of training gaps, and kernels over blocks of gaps of one size.

Every random number is a hash of (gap, stream, place), so a path depends on its gap
alone and not on the block, task or order that it is made in. Kernels work on whole
blocks: a leading axis of gaps, one of samples, then points and coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions import geometry as g
from gapweave.functions.ids import hash01

#: Residuals kept for each number of points, draws of the decoder, paths of a family.
TEMPLATES, DRAWS, SAMPLES = 80, 80, 10
#: Step bound and path ratio where no training gap tells.
NO_STEP, NO_RATIO = 1000.0, 1.2
#: Gaps that a kernel takes at once.
BLOCK = 512
ROWS = "task_uid string, method string, source_rank int, path array<struct<x:double,y:double>>"
STREAMS = {"step_noise": 1, "bank": 2, "shares": 3, "amplitude": 4, "phase": 5, "shrink": 6, "latent": 7, "bridge": 8}


def uniforms(seeds: np.ndarray, stream: str, *shape: int) -> np.ndarray:
    """Numbers in (0, 1) for each seed, by a 64-bit finaliser over seed, stream and place."""
    place = np.arange(int(np.prod(shape)), dtype=np.uint64)
    x = seeds.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(STREAMS[stream] << 56)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53).reshape(len(seeds), *shape)


def normals(seeds: np.ndarray, stream: str, *shape: int) -> np.ndarray:
    """Standard normal numbers for each seed, by the polar form of two uniform ones."""
    u = uniforms(seeds, stream, 2, *shape)
    return np.sqrt(-2.0 * np.log(u[:, 0])) * np.cos(2.0 * np.pi * u[:, 1])


# --- what training gaps leave ------------------------------------------------------------------


def residuals(tasks: DataFrame) -> DataFrame:
    """Truth minus chord of each gap, the ends zero."""
    base = g.linear_path(F.col("start"), F.col("end"), F.col("n_points"))
    diff = F.zip_with("truth", base, lambda p, q: g.point(p.x - q.x, p.y - q.y))
    edge = F.transform(diff, lambda p, i: F.when((i == 0) | (i == F.size(diff) - 1), g.point(F.lit(0.0), F.lit(0.0))).otherwise(p))
    return tasks.filter(F.size("truth") > 1).withColumn("resid", edge)


def artifacts(tasks: DataFrame) -> DataFrame:
    """Rows (level, taxon, setting_name, n_points, template, step_q90, ratio_median, bank), a few for each number of points.

    Level `condition` has the median residual of a taxon, setting and number of points; `n_points` that of the number of
    points, the 0.9 quantile of steps, the median path ratio and the first residuals by hash; `global` the last two figures
    over all gaps.
    """
    r = residuals(tasks)
    label = ["taxon", "setting_name", "n_points"]
    points = r.select(*label, F.posexplode("resid").alias("i", "p"))
    medians = points.groupingSets([[F.col(c) for c in [*label, "i"]], [F.col("n_points"), F.col("i")]], *label, "i").agg(
        F.grouping("taxon").alias("gid"), F.median("p.x").alias("x"), F.median("p.y").alias("y")
    )
    template = medians.groupBy("gid", *label).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("t"))
    template = template.select(*label, "gid", F.transform("t", lambda e: g.point(e.x, e.y)).alias("template"))
    wide = lambda df, *aggs: df.groupingSets([[F.col("n_points")], []], "n_points").agg(F.grouping("n_points").alias("all"), *aggs)
    steps = wide(r.select("n_points", F.explode(g.steps(F.col("truth"))).alias("s")), F.percentile("s", 0.9).alias("step_q90"))
    ratio = wide(r, F.median(g.path_ratio(F.col("truth"))).alias("ratio_median"))
    figures = steps.alias("s").join(ratio.alias("r"), (F.col("s.all") == F.col("r.all")) & F.col("s.n_points").eqNullSafe(F.col("r.n_points"))).select("s.all", "s.n_points", "step_q90", "ratio_median")
    w = Window.partitionBy("n_points").orderBy(hash01(F.col("task_uid")), "task_uid")
    first = r.select("n_points", "task_uid", "resid").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= TEMPLATES)
    bank = first.groupBy("n_points").agg(F.array_sort(F.collect_list(F.struct("k", "resid"))).alias("b")).select("n_points", F.transform("b", lambda e: e.resid).alias("bank"))
    by_n = template.filter("gid = 1").select("n_points", "template").join(figures.filter("all = 0").drop("all"), "n_points").join(bank, "n_points")
    cols = ["level", *label, "template", "step_q90", "ratio_median", "bank"]
    put = lambda df, level: df.withColumns({"level": F.lit(level), **{c: F.lit(None).cast(kind) for c, kind in KINDS.items() if c not in df.columns}}).select(*cols)
    return put(template.filter("gid = 0").drop("gid"), "condition").unionByName(put(by_n, "n_points")).unionByName(put(figures.filter("all = 1").drop("all", "n_points"), "global"))


KINDS = {
    "taxon": "string", "setting_name": "string", "n_points": "int", "template": "array<struct<x:double,y:double>>",
    "step_q90": "double", "ratio_median": "double", "bank": "array<array<struct<x:double,y:double>>>",
}


@dataclass
class Known:
    """Artifacts as arrays."""

    templates: dict[tuple, np.ndarray]
    banks: dict[int, np.ndarray]
    figures: dict[int | None, tuple[float, float]]

    def template(self, taxon: str, setting: str, n: int) -> np.ndarray:
        found = self.templates.get((taxon, setting, n), self.templates.get((None, None, n)))
        return np.zeros((n, 2)) if found is None else found

    def figure(self, n: int) -> tuple[float, float]:
        return self.figures.get(n) or self.figures.get(None) or (NO_STEP, NO_RATIO)


def known(made: DataFrame) -> Known:
    """Collects artifacts: a row for each label and number of points, TEMPLATES residuals at most for each of the latter."""
    xy = lambda p: np.array([[q.x, q.y] for q in p], float)
    out = Known({}, {}, {})
    for r in made.collect():
        if r.template is not None:
            out.templates[r.taxon, r.setting_name, r.n_points] = xy(r.template)
        if r.bank is not None:
            out.banks[r.n_points] = np.array([xy(p) for p in r.bank])
        if r.step_q90 is not None:
            out.figures[r.n_points] = (r.step_q90, NO_RATIO if r.ratio_median is None else r.ratio_median)
    return out


# --- kernels -------------------------------------------------------------------------------------


def chords(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return a[:, None] + np.linspace(0.0, 1.0, n)[:, None] * (b - a)[:, None]


def pinned(paths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    paths[..., 0, :], paths[..., -1, :] = a[:, None], b[:, None]
    return paths


def energies(paths: np.ndarray, reach: np.ndarray, step_q90: float, usual_ratio: float) -> np.ndarray:
    """Overlong steps, an unusual path ratio and turning of each path; both ends are met by construction."""
    legs = paths[..., 1:, :] - paths[..., :-1, :]
    size = np.hypot(legs[..., 0], legs[..., 1])
    excess = np.square(np.clip(size - step_q90, 0.0, None)).mean(axis=-1) / max(step_q90**2, 1.0)
    ratio = size.sum(axis=-1) / np.clip(reach, 1e-6, None)[:, None]
    heading = np.arctan2(legs[..., 1], legs[..., 0])
    bend = (np.diff(heading, axis=-1) + np.pi) % (2.0 * np.pi) - np.pi
    turning = np.abs(bend).mean(axis=-1) if bend.shape[-1] else np.zeros(size.shape[:-1])
    return 2.0 * excess + np.abs(ratio - usual_ratio) + 0.25 * turning


def step_paths(seeds: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, templates: np.ndarray, step_q90: float) -> np.ndarray:
    """All samples advance together: a share of the way left, some of the template's step, noise that grows with the
    sample, and a pull back to where the end can still be reached."""
    reach = np.hypot(*(b - a).T)
    spread = (0.05 + 0.02 * np.arange(1, SAMPLES + 1)) * np.maximum(reach, step_q90)[:, None] / max(n, 2)
    noise = normals(seeds, "step_noise", SAMPLES, max(n - 2, 0), 2) * spread[..., None, None]
    drift = 0.45 * np.diff(templates, axis=1)
    paths = np.broadcast_to(chords(a, b, n)[:, None], (len(a), SAMPLES, n, 2)).copy()
    for j in range(1, n - 1):
        left = n - j
        at = paths[:, :, j - 1]
        at = at + (b[:, None] - at) / left + drift[:, None, j - 1] + noise[:, :, j - 1]
        short = at - b[:, None]
        far = np.hypot(short[..., 0], short[..., 1])
        pull = np.minimum(1.0, step_q90 * left / np.maximum(far, 1e-9))
        paths[:, :, j] = b[:, None] + short * pull[..., None]
    return pinned(paths, a, b)


def decoder_paths(seeds: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, templates: np.ndarray, bank: np.ndarray | None, step_q90: float, usual_ratio: float) -> np.ndarray:
    """Mixtures of known residuals and a lateral wave, shrunk; of DRAWS for each gap the SAMPLES of least energy, in order."""
    v = b - a
    reach = np.hypot(*v.T)
    if bank is None or not len(bank):
        mixed = np.broadcast_to(templates[:, None], (len(a), DRAWS, n, 2))
    else:
        k = min(3, len(bank))
        picks = np.minimum((uniforms(seeds, "bank", DRAWS, k) * len(bank)).astype(int), len(bank) - 1)
        shares = -np.log(uniforms(seeds, "shares", DRAWS, k))  # exponential numbers over their sum are uniform on the simplex
        mixed = np.einsum("gdk,gdknc->gdnc", shares / shares.sum(axis=-1, keepdims=True), bank[picks])
    across = np.where(reach[:, None] > 1e-9, np.stack([-v[:, 1], v[:, 0]], axis=1) / np.maximum(reach, 1e-9)[:, None], [1.0, 0.0])
    height = (2.0 * uniforms(seeds, "amplitude", DRAWS) - 1.0) * np.maximum(5.0, 0.12 * reach)[:, None]
    phase = 2.0 * np.pi * uniforms(seeds, "phase", DRAWS)
    wave = height[..., None] * np.sin(np.pi * np.linspace(0.0, 1.0, n) + phase[..., None])
    shrink = 0.25 + 0.70 * uniforms(seeds, "shrink", DRAWS)
    paths = chords(a, b, n)[:, None] + shrink[..., None, None] * (mixed + wave[..., None] * across[:, None, None])
    paths = pinned(paths, a, b)
    best = np.argsort(energies(paths, reach, step_q90, usual_ratio), axis=1, kind="stable")[:, :SAMPLES]
    return np.take_along_axis(paths, best[..., None, None], axis=1)


def rows_of(uids: list[str], paths: np.ndarray, name: str) -> pa.RecordBatch:
    """Paths (gaps, samples, points, 2) as rows of a method for each sample."""
    k, s, n, _ = paths.shape
    flat = np.ascontiguousarray(paths, float).reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    ranks = np.tile(np.arange(1, s + 1, dtype=np.int32), k)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(uids, object), s), pa.string()), pa.array([f"{name}{i:02d}" for i in ranks.tolist()]), pa.array(ranks),
         pa.ListArray.from_arrays(pa.array(np.arange(0, k * s * n + 1, n, dtype=np.int32)), points)],
        ["task_uid", "method", "source_rank", "path"],
    )


def by_size(tasks: DataFrame, kernel: Callable[[int, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], *keep: str) -> DataFrame:
    """Runs a kernel (n, gaps, seeds, starts, ends) over blocks of gaps of one number of points."""
    seed = (hash01(F.col("task_uid")) * float(1 << 48)).cast("long")
    typed = tasks.select("task_uid", F.col("n_points").cast("int").alias("n_points"), seed.alias("seed"), *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("start", "end") for c in "xy"], *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, some in batch.to_pandas().groupby("n_points"):
                for at in range(0, len(some), BLOCK):
                    x = some.iloc[at : at + BLOCK]
                    xy = x[["start_x", "start_y", "end_x", "end_y"]].to_numpy(float)
                    yield from kernel(int(n), x, x["seed"].to_numpy(np.int64), xy[:, :2], xy[:, 2:])

    return typed.mapInArrow(run, ROWS)


def ecological(tasks: DataFrame, made: DataFrame) -> DataFrame:
    """Step-selection samples and constrained-decoder ranks of each gap; rows task_uid, method, source_rank, path.

    A gap whose labels or number of points no training gap has takes the next coarser artifact, at last a zero residual
    and the global figures, so every gap has all its paths. made: see artifacts.
    """
    shared = tasks.sparkSession.sparkContext.broadcast(known(made))

    def kernel(n: int, x: pd.DataFrame, seeds: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        have = shared.value
        step_q90, ratio = have.figure(n)
        templates = np.stack([have.template(t, s, n) for t, s in zip(x["taxon"], x["setting_name"], strict=True)])
        uids = x["task_uid"].tolist()
        yield rows_of(uids, step_paths(seeds, a, b, n, templates, step_q90), "ecological_tg_step_selection_sample")
        yield rows_of(uids, decoder_paths(seeds, a, b, n, templates, have.banks.get(n), step_q90, ratio), "ecological_tg_constrained_decoder_rank")

    return by_size(tasks, kernel, "taxon", "setting_name")


def brownian(tasks: DataFrame, scale: float = 0.15) -> DataFrame:
    """The chord with normal noise in proportion to it, tied to both ends; rows task_uid, method, path."""

    def kernel(n: int, x: pd.DataFrame, seeds: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        paths = chords(a, b, n)
        if n > 2:
            t = np.linspace(0.0, 1.0, n)[:, None]
            noise = normals(seeds, "bridge", n, 2) * (scale * np.maximum(np.hypot(*(b - a).T), 1.0))[:, None, None]
            paths = paths + noise - (1.0 - t) * noise[:, :1] - t * noise[:, -1:]
        yield rows_of(x["task_uid"].tolist(), paths[:, None], "")

    return by_size(tasks, kernel).select("task_uid", F.lit("brownian_bridge").alias("method"), "path")


# --- the latent decoder ----------------------------------------------------------------------------

#: Labels that the condition hashes, in order.
LABELS = ("dataset", "taxon", "setting_name", "species_group", "genus_group", "transfer_unit", "habitat_id")


def condition(tasks: DataFrame) -> DataFrame:
    """Adds cond: the numeric condition of a gap for the latent decoder."""
    s, e, p, n = (F.col(c) for c in ("start", "end", "prev", "next"))
    d = g.distance(s, e)

    def unit(vx: Column, vy: Column) -> list[Column]:
        size = F.sqrt(vx * vx + vy * vy)
        ok = size > g.EPS
        return [F.when(ok, vx / size).otherwise(0.0), F.when(ok, vy / size).otherwise(0.0), F.log1p(F.coalesce(size, F.lit(0.0)))]

    before, after = unit(s.x - p.x, s.y - p.y), unit(n.x - e.x, n.y - e.y)
    labels = [hash01(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in tasks.columns else F.lit("unknown")) for c in LABELS]
    parts = [
        F.col("n_points").cast("double"), F.col("coarse_dt_min"), F.col("fine_dt_min"), d, F.log1p(d), d / F.greatest(F.col("n_points") - 1, F.lit(1)), d / F.greatest(F.col("coarse_dt_min"), F.lit(1e-6)),
        *unit(e.x - s.x, e.y - s.y)[:2], *before, p.isNotNull().cast("double"), *after, n.isNotNull().cast("double"), *labels,
    ]
    return tasks.withColumn("cond", F.array(*[F.coalesce(c, F.lit(0.0)) for c in parts]))


@dataclass
class Decoder:
    """Residuals of one number of points as a ridge regression on condition and latent shape."""

    mean: np.ndarray
    dev: np.ndarray
    coef: np.ndarray
    base: np.ndarray
    latent_mean: np.ndarray
    latent_dev: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, alpha: float = 2.0) -> Decoder:
        k = int(max(2, min(8, len(x) - 1, y.shape[1] // 4 if y.shape[1] >= 8 else 2)))
        axes = np.linalg.svd(y - y.mean(axis=0), full_matrices=False)[2][:k]
        z = (y - y.mean(axis=0)) @ axes.T
        both = np.hstack([x, z])
        dev = both.std(axis=0)
        dev[dev == 0] = 1.0
        w = (both - both.mean(axis=0)) / dev
        coef = np.linalg.solve(w.T @ w + alpha * np.eye(w.shape[1]), w.T @ (y - y.mean(axis=0)))
        return Decoder(both.mean(axis=0), dev, coef, y.mean(axis=0), z.mean(axis=0), z.std(axis=0) + 1e-6)

    def residuals(self, cond: np.ndarray, latent: np.ndarray) -> np.ndarray:
        """For conditions (gaps, features) and latent shapes (gaps, samples, k): (gaps, samples, points, 2)."""
        k = cond.shape[1]
        w, dev = self.coef, self.dev
        own = ((cond - self.mean[:k]) / dev[:k]) @ w[:k]
        shape = ((latent - self.mean[k:]) / dev[k:]) @ w[k:]
        return (own[:, None] + shape + self.base).reshape(*latent.shape[:2], -1, 2)


def latent(train: DataFrame, tasks: DataFrame, rows: int = 3000) -> DataFrame:
    """Paths from a linear decoder of condition and latent shape, fitted for each number of points on at most `rows` gaps by hash.

    The first sample has the zero shape, the others normal ones. A number of points with three training gaps or fewer has
    no decoder and its gaps have no paths of this family; rows of other families cover them.
    """
    w = Window.partitionBy("n_points").orderBy(hash01(F.col("task_uid")), "task_uid")
    some = condition(residuals(train)).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= rows)
    flat = F.flatten(F.transform("resid", lambda p: F.array(p.x, p.y)))
    fitted = {}
    for n, group in some.select("n_points", "cond", flat.alias("resid")).toPandas().groupby("n_points"):  # `rows` for each number of points
        if len(group) > 3:
            fitted[int(n)] = Decoder.fit(np.array(group["cond"].tolist(), float), np.array(group["resid"].tolist(), float))
    shared = tasks.sparkSession.sparkContext.broadcast(fitted)

    def kernel(n: int, x: pd.DataFrame, seeds: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        model = shared.value.get(n)
        if model is not None:
            shapes = model.latent_mean + normals(seeds, "latent", SAMPLES, len(model.latent_mean)) * model.latent_dev
            shapes[:, 0] = 0.0
            share = np.where(np.arange(SAMPLES) == 0, 0.80, 0.90)[:, None, None]
            paths = chords(a, b, n)[:, None] + share * model.residuals(np.array(x["cond"].tolist(), float), shapes)
            yield rows_of(x["task_uid"].tolist(), pinned(paths, a, b), "direct_sr_conditional_latent_decoder_sample")

    return by_size(condition(tasks), kernel, "cond")
