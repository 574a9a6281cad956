"""Choices by movement regime: a regime label, a guarded choice for each regime, and ranked candidate sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The guards of a regime's choice, as differences from the default method.
LEAST_TASKS, BETTER, MOST_RATIO, MEAN_SLACK, TAIL_SLACK, LEAST_WIN, WIN_SLACK, CLEAR = 2, 0.005, 0.995, 10.0, 0.20, 0.30, 0.10, 0.03
PLAIN = ("linear", "heading_hermite")


def regime_label(dataset: Column, taxon: Column, setting: Column, species: Column | None = None) -> Column:
    """The movement regime of a gap: species and how long its gaps are; other species by all three labels."""
    low = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    every = F.concat_ws(" ", low(dataset), low(taxon), low(setting), low(species if species is not None else F.lit("")))
    has = lambda word: every.contains(word)
    gap = lambda minutes: low(setting).contains(minutes)
    puma = F.when(gap("240"), "puma_long_240_to_5").when(gap("120"), "puma_mid_120_to_5").when(gap("60"), "puma_short_60_to_5").when(gap("30"), "puma_short_30_to_5").otherwise("puma_other")
    big = F.when(has("leopard"), "leopard").when(has("tiger"), "tiger").when(low(taxon) != "", low(taxon)).otherwise("panthera")
    span = F.when(gap("60") & gap("15"), "60_to_15").when(gap("240") & gap("60"), "240_to_60").otherwise("other")
    named = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("missing")) for c in (dataset, taxon, setting)])
    return (
        F.when(has("bobcat"), "olympic_bobcat_240_to_60").when(has("cougar"), "olympic_cougar_240_to_60").when(has("puma"), puma)
        .when(has("tiger") | has("leopard") | has("thailand"), F.concat_ws("_", F.lit("thailand"), big, span)).otherwise(named)
    )


def method_figures(rows: DataFrame, regime: str = "regime") -> DataFrame:
    """Validation figures of each method in each regime: what choices and ranks compare."""
    return rows.groupBy(regime, "method").agg(
        F.count_distinct("task_uid").alias("n_tasks"), F.median("ade_ratio_to_linear").alias("med_ratio"), F.avg("ADE").alias("mean_ade"),
        F.percentile("ade_ratio_to_linear", 0.9).alias("q90_ratio"), F.avg("better_than_linear").alias("win"),
    )


def favoured() -> list[Column]:
    """The order of methods in a regime; methods without figures come last, names break ties."""
    last = lambda c: F.asc_nulls_last(c)
    return [last("med_ratio"), last("mean_ade"), last("q90_ratio"), F.desc(F.coalesce("win", F.lit(0.0))), F.asc("method")]


def choose(validation: DataFrame, default: str, regime: str = "regime") -> DataFrame:
    """For each regime the method to use: rows regime, method, reason.

    The best method that is clearly better than the default in the median and not much worse
    in mean, tail and wins; else the best of all where it is a plain baseline or better by far;
    else the default. A regime without rows of the default has only the fixed guards.
    """
    s = method_figures(validation, regime).withColumn("place", F.row_number().over(Window.partitionBy(regime).orderBy(*favoured())))
    own = Window.partitionBy(regime)
    of_default = lambda c: F.max(F.when(F.col("method") == default, F.col(c))).over(own)
    s = s.withColumns({"d_med": F.coalesce(of_default("med_ratio"), F.lit(1.0)), "d_mean": of_default("mean_ade"), "d_q90": of_default("q90_ratio"), "d_win": F.coalesce(of_default("win"), F.lit(0.0))})
    tail = F.col("d_mean").isNull() | (F.col("mean_ade") <= F.col("d_mean") + MEAN_SLACK)
    tail &= F.col("d_q90").isNull() | (F.col("q90_ratio") <= F.col("d_q90") + TAIL_SLACK)
    wins = F.coalesce("win", F.lit(0.0)) >= F.greatest(F.lit(LEAST_WIN), F.col("d_win") - WIN_SLACK)
    ok = (F.col("n_tasks") >= LEAST_TASKS) & (F.col("med_ratio") <= F.least(F.col("d_med") - BETTER, F.lit(MOST_RATIO))) & tail & wins
    clear = (F.col("place") == 1) & (F.col("method").isin(*PLAIN) | (F.col("med_ratio") <= F.col("d_med") - CLEAR))
    first = lambda c: F.min_by("method", F.when(c, F.col("place")))
    best = s.groupBy(regime).agg(first(F.coalesce(ok, F.lit(False))).alias("_m"), F.count_if(ok).alias("_n"), first(F.coalesce(clear, F.lit(False))).alias("_c"), F.count_if(clear).alias("_k"))
    guarded, winner = F.col("_n") > 0, F.col("_k") > 0
    reason = F.when(guarded, "regime_validation_selected").when(winner, "fallback_to_clear_regime_winner").otherwise("default_guarded_no_eligible")
    return best.select(regime, F.when(guarded, F.col("_m")).when(winner, F.col("_c")).otherwise(F.lit(default)).alias("method"), reason.alias("reason"))


def apply_choices(pool: DataFrame, choices: DataFrame, default: str, name: str, regime: str = "regime") -> DataFrame:
    """One row for each gap: that of its regime's method, else the default's, else the chord's, else the first by name."""
    wanted = pool.join(F.broadcast(choices.select(regime, F.col("method").alias("_want"))), regime, "left")  # a row a regime
    order = F.when(F.col("method") == F.coalesce("_want", F.lit(default)), 0).when(F.col("method") == default, 1).when(F.col("method") == "linear", 2).otherwise(3)
    w = Window.partitionBy("task_uid").orderBy(order, "method")
    first = wanted.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_want")
    return first.withColumn("source_method", F.col("method")).withColumn("method", F.lit(name))


def ranked_sets(pool: DataFrame, validation: DataFrame, sizes: Sequence[int] = (1, 3, 5, 10, 20), name: str = "calibrated", regime: str = "regime") -> DataFrame:
    """For each gap and size the row of least error among its regime's first methods by validation, and among all methods.

    A diagnostic that uses truth, and marked so. A gap of a regime without validation rows has the set of all methods only.
    """
    order = method_figures(validation, regime).withColumn("method_rank", F.row_number().over(Window.partitionBy(regime).orderBy(*favoured()))).select(regime, "method", "method_rank")
    sized = pool.join(F.broadcast(order), [regime, "method"], "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes], F.lit(None).cast("int"))))
    inside = sized.filter(F.col("k").isNull() | (F.col("method_rank") <= F.col("k")))
    best = inside.groupBy("task_uid", "k").agg(F.min_by(F.struct("method", "ADE"), F.struct("ADE", "method")).alias("b"), F.count("*").alias("n_in_set"))
    label = F.when(F.col("k").isNull(), f"{name}_full_proposed_pool_oracle").otherwise(F.concat(F.lit(f"{name}_top"), F.col("k"), F.lit("_validation_ranked_set_oracle")))
    return best.select("task_uid", label.alias("method"), F.col("b.method").alias("source_method"), F.col("b.ADE").alias("ADE"), "n_in_set", F.lit(True).alias("oracle_within_generated_set"))
