"""Track series: steps, fine interval, gap tasks on the lattice, prediction gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions import geometry as g
from gapweave.functions.ids import make_uid

KEY = ["dataset", "taxon", "animal_id"]


def step_columns(fixes: DataFrame) -> DataFrame:
    """Neighbouring fixes of each fix, the step to it and the minutes since the one before."""
    w = Window.partitionBy(*KEY).orderBy("time")
    out = fixes
    for name, f in (("prev", F.lag), ("next", F.lead)):
        for c in ("x", "y", "time"):
            out = out.withColumn(f"{name}_{c}", f(c).over(w))
    return out.withColumn("step_m", F.sqrt((F.col("x") - F.col("prev_x")) ** 2 + (F.col("y") - F.col("prev_y")) ** 2)).withColumn(
        "dt_min", F.timestamp_diff("SECOND", F.col("prev_time"), F.col("time")) / 60.0
    )


def fine_interval(fixes: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Median positive minutes between neighbouring fixes."""
    w = Window.partitionBy(*keys).orderBy("time")
    gaps = fixes.withColumn("gap", F.timestamp_diff("SECOND", F.lag("time").over(w), F.col("time")) / 60.0).filter("gap > 0")
    return gaps.groupBy(*keys).agg(F.median("gap").alias("fine_min"))


def first_fixes(fixes: DataFrame, order: str = "time") -> DataFrame:
    """One fix for each animal and minute, the first by `order`."""
    rest = [c for c in fixes.columns if c not in [*KEY, "t"]]
    return fixes.groupBy(*KEY, "t").agg(F.min_by(F.struct(*rest), F.struct(order, "x", "y")).alias("r")).select(*KEY, "t", "r.*")


def make_tasks(fixes: DataFrame, settings: Sequence[tuple[int, int]], stride_fraction: float = 1.0, min_points: int = 5) -> DataFrame:
    """Gaps with known fine fixes, for settings (coarse minutes, fine minutes).

    A gap starts at every stride-th fix and has a fix at each lattice time. Tracks
    are cut into blocks of time, each with the fixes just outside that its gaps
    need, so one sort by (animal, block) finds all lattice fixes without a
    self-join, and a long track is many tasks. Fixes must be unique per animal and
    minute (see first_fixes).
    """
    out = None
    for coarse, fine in settings:
        one = setting_tasks(fixes, coarse, fine, stride_fraction, min_points)
        out = one if out is None else out.unionByName(one)
    return out


def setting_tasks(fixes: DataFrame, coarse: int, fine: int, stride_fraction: float, min_points: int) -> DataFrame:
    n = round(coarse / fine)
    stride, span = max(1, round(n * stride_fraction)), 32 * coarse
    block = F.floor(F.col("t") / span)
    into = F.col("t") - block * span
    counts = fixes.groupBy(*KEY, block.alias("block")).agg(F.count("*").alias("here"))
    whole = Window.partitionBy(*KEY)
    counts = counts.withColumn("before", F.coalesce(F.sum("here").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "all", F.sum("here").over(whole)
    )
    seats = F.array(block, F.when(into <= coarse + fine, block - 1), F.when(into >= span - fine, block + 1))
    placed = fixes.withColumn("home", block).withColumn("block", F.explode(F.filter(seats, lambda b: b.isNotNull())))
    w = Window.partitionBy(*KEY, "block").orderBy("t")
    own = F.sum((F.col("home") == F.col("block")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the fix at just so many minutes from here: a frame of one place, so nothing is listed or searched
    at = lambda k: F.first(F.struct("x", "y", "elev")).over(w.rangeBetween(k * fine, k * fine))
    starts = placed.select("*", F.array(*[at(k) for k in range(n + 1)]).alias("hits"), at(-1).alias("before_"), at(n + 1).alias("after_"), F.coalesce(own, F.lit(0)).alias("seat")).filter("home = block")
    found = starts.join(counts, [*KEY, "block"]).filter((F.col("all") >= max(min_points, n + 1)) & ((F.col("before") + F.col("seat")) % stride == 0))
    good = found.filter(F.forall("hits", lambda h: h.isNotNull() & ~F.isnan(h.x) & ~F.isnan(h.y)))
    name = F.lit(f"{coarse}min_to_{fine}min")
    xy = lambda h: F.when(h.isNotNull(), g.point(h.x, h.y))
    return good.select(
        make_uid(F.col("dataset"), F.col("taxon"), F.col("animal_id"), name, F.date_format("time", "yyyy-MM-dd HH:mm:ss")).alias("task_uid"),
        *KEY, name.alias("setting_name"), *(["sex"] if "sex" in fixes.columns else []),
        F.col("time").alias("start_time"), F.timestamp_add("MINUTE", F.lit(coarse), F.col("time")).alias("end_time"),
        F.lit(float(coarse)).alias("coarse_dt_min"), F.lit(float(fine)).alias("fine_dt_min"), F.lit(n + 1).alias("n_points"),
        F.transform("hits", lambda h: g.point(h.x, h.y)).alias("truth"), F.transform("hits", lambda h: h.elev).alias("truth_env"),
        xy(F.col("before_")).alias("prev"), xy(F.col("after_")).alias("next"),
    ).withColumns({"start": F.element_at("truth", 1), "end": F.element_at("truth", -1)})


def task_points(tasks: DataFrame) -> DataFrame:
    """The known fine fixes of each gap, one row each."""
    points = tasks.select("task_uid", "start_time", "fine_dt_min", F.posexplode(F.arrays_zip("truth", "truth_env")).alias("point_order", "p"))
    time = F.timestamp_add("MINUTE", (F.col("point_order") * F.col("fine_dt_min")).cast("int"), F.col("start_time"))
    return points.select("task_uid", "point_order", time.alias("time"), "p.truth.x", "p.truth.y", F.col("p.truth_env").alias("elev"))


def tasks_from_points(tasks: DataFrame, points: DataFrame) -> DataFrame:
    """Gaps with their truth rebuilt from long rows."""
    sorted_ = F.array_sort(F.collect_list(F.struct("point_order", "x", "y", "elev")))
    nested = points.groupBy("task_uid").agg(sorted_.alias("p"))
    nested = nested.select("task_uid", F.transform("p", lambda e: g.point(e.x, e.y)).alias("truth"), F.transform("p", lambda e: e.elev).alias("truth_env"))
    return tasks.drop("truth", "truth_env").join(nested, "task_uid", "left")


def prediction_gaps(coarse: DataFrame, fine_min: float) -> DataFrame:
    """The gaps between consecutive fixes of sparse tracks, with the fixes around them."""
    w = Window.partitionBy(*KEY).orderBy("time")
    xy = g.point(F.col("x"), F.col("y"))
    gaps = coarse.select(
        *KEY, F.col("time").alias("start_time"), F.lead("time").over(w).alias("end_time"), xy.alias("start"), F.lead(xy).over(w).alias("end"),
        F.lag(xy).over(w).alias("prev"), F.lead(xy, 2).over(w).alias("next"), (F.row_number().over(w) - 1).alias("i"),
    )
    dt = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")) / 60.0
    gaps = gaps.withColumn("coarse_dt_min", dt).filter("coarse_dt_min > 0").withColumn("fine_dt_min", F.lit(float(fine_min)))
    name = F.concat(F.bround("coarse_dt_min").cast("int"), F.lit("min_to_"), F.lit(round(fine_min)), F.lit("min"))
    gaps = gaps.withColumn("n_points", F.greatest(F.bround(F.col("coarse_dt_min") / fine_min).cast("int") + 1, F.lit(2))).withColumn("setting_name", name)
    time = F.date_format("start_time", "yyyy-MM-dd HH:mm:ss")
    return gaps.withColumn("task_uid", make_uid(*[F.col(c) for c in KEY], F.col("setting_name"), time, F.col("i")))


SETTING = "array<struct<coarse_dt_min:double,fine_dt_min:double,setting_name:string>>"


def settings_of(json: Column, fallback_fine: Column | None = None, coarse: Sequence[int] = ()) -> Column:
    """Settings from their JSON text: those of positive minutes that divide, each once, in order.

    A missing name is made from the minutes. Where none is left, the coarse intervals
    that the fallback's fine minutes divide; nothing where there is no such interval.
    """
    name = lambda c, f: F.format_string("%dmin_to_%dmin", F.bround(c).cast("int"), F.bround(f).cast("int"))
    fits = lambda c, f: (c > 0) & (f > 0) & (F.abs(c / f - F.bround(c / f)) <= 1e-6) & (c < float("inf"))
    given = F.filter(F.coalesce(F.from_json(json, SETTING), F.array().cast(SETTING)), lambda s: F.coalesce(fits(s.coarse_dt_min, s.fine_dt_min), F.lit(False)))
    own = F.coalesce(F.array_distinct(F.transform(given, lambda s: F.struct(
        F.round(s.coarse_dt_min, 6).alias("coarse_dt_min"), F.round(s.fine_dt_min, 6).alias("fine_dt_min"),
        F.coalesce(F.nullif(s.setting_name, F.lit("")), name(s.coarse_dt_min, s.fine_dt_min)).alias("setting_name"),
    ))), F.array().cast(SETTING))
    if fallback_fine is None:
        return own
    fine = F.nullif(fallback_fine.cast("double"), F.lit(float("nan")))
    usual = F.filter(F.array(*[F.lit(float(c)) for c in coarse]), lambda c: F.coalesce(fits(c, fine) & (c >= fine), F.lit(False)))
    made = F.transform(usual, lambda c: F.struct(c.alias("coarse_dt_min"), fine.alias("fine_dt_min"), name(c, fine).alias("setting_name")))
    return F.when(F.size(own) > 0, own).otherwise(made.cast(SETTING))


def settings_json(settings: Column) -> Column:
    """Settings as JSON text."""
    return F.to_json(settings)
