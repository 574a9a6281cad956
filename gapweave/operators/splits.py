"""Splits, caps and samplers, all by stable hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions.ids import hash01

SEED = 20260625
#: Equal parts of the hash's range that rows are counted by.
SLICES = 1024


def global_split(uid: Column, train: float = 0.70, validation: float = 0.15) -> Column:
    """A split by the hash of the id alone."""
    h = hash01(uid)
    return F.when(h < train, "train").when(h < train + validation, "validation").otherwise("test")


def grouped_split(df: DataFrame, uid: str, groups: Sequence[str], train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Adds split: exact shares within each group, in hash order; sizes round half to even."""
    w = Window.partitionBy(*groups)
    n = F.count("*").over(w)
    out = df.withColumn("_n", n).withColumn("_r", F.row_number().over(w.orderBy(hash01(F.col(uid)), uid)))
    n_train = F.bround(F.col("_n") * F.lit(train))
    n_val = F.bround(F.col("_n") * F.lit(validation))
    n_val = F.when((F.col("_n") >= 3) & (n_train + n_val >= F.col("_n")), F.greatest(F.lit(0), F.col("_n") - n_train - 1)).otherwise(n_val)
    n_val = F.when(n_train + n_val > F.col("_n"), F.greatest(F.lit(0), F.col("_n") - n_train)).otherwise(n_val)
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "validation").otherwise("test")
    return out.withColumn("split", split).drop("_n", "_r")


def individual_split(df: DataFrame, keys: Sequence[str], strata: Sequence[str], seed: int = SEED, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Rows (keys, strata, key, split): each individual whole in one split, per stratum."""
    animals = df.select(*keys, *[c for c in strata if c not in keys]).distinct().withColumn("individual_key", F.concat_ws("|", *keys))
    w = Window.partitionBy(*strata)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(hash01(F.concat(F.lit(f"{seed}|"), "individual_key")), "individual_key"))
    out = animals.withColumn("_n", n).withColumn("_r", r)
    n_val = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(validation)))
    n_test = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(1.0 - train - validation)))
    few = n_val + n_test >= F.col("_n")
    n_val, n_test = F.when(few, 1).otherwise(n_val), F.when(few, 1).otherwise(n_test)
    first = F.col("_n") - n_val - n_test
    many = F.when(F.col("_r") <= first, "train").when(F.col("_r") <= first + n_val, "validation").otherwise("test")
    split = F.when(F.col("_n") == 1, "train").when(F.col("_n") == 2, F.when(F.col("_r") == 1, "train").otherwise("test")).otherwise(many)
    return out.withColumn("split", split).drop("_n", "_r")


def leaks(df: DataFrame, key: str = "individual_key") -> DataFrame:
    """Individuals that are in more than one split."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def capped(df: DataFrame, uid: str, groups: Sequence[str], cap: int) -> DataFrame:
    """At most `cap` rows of each group, the first by hash."""
    w = Window.partitionBy(*groups).orderBy(hash01(F.col(uid)), uid)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def top_animals(df: DataFrame, groups: Sequence[str], animal: str, n: int) -> DataFrame:
    """Rows of the n individuals of each group that have most rows; ties go to the smaller id."""
    counts = df.groupBy(*groups, animal).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*groups).orderBy(F.desc("_c"), animal)
    keep = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(*groups, animal)
    return df.join(keep, [*groups, animal], "left_semi")


def first_by_hash(df: DataFrame, uid: str, most: int) -> DataFrame:
    """The `most` rows whose ids have the smallest hashes, ties by id.

    Not a sort with a limit: Spark moves what is selected of it below the limit, and where those columns do not fold into
    one projection, the limit takes rows of the sorted partitions as they come from the executors. Rows are counted by
    slices of the hash's range, and those of the slices up to the cut are ranked within their slice.
    """
    hashed = df.withColumn("_h", hash01(F.col(uid))).withColumn("_s", F.coalesce(F.floor(F.col("_h") * SLICES), F.lit(-1)))
    before = F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))  # a row for each slice
    slices = hashed.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(before, F.lit(0)).alias("_b")).filter(F.col("_b") < most)
    ranked = hashed.join(F.broadcast(slices), "_s").withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_h", uid)))
    return ranked.filter(F.col("_b") + F.col("_r") <= most).select(*df.columns)


def balanced_sample(df: DataFrame, uid: str, groups: Sequence[str], most: int, seed: int = 42, label: str = "evaluation") -> DataFrame:
    """`most` rows: an equal quota of each group by hash, then the rest of all by hash.

    A rank within the group is partial before the shuffle; what may fill up is cut
    to `most` rows before it is ranked as a whole.
    """
    hashed = df.withColumn("_h", hash01(F.concat(F.lit(f"{seed}|{label}|"), F.col(uid))))
    quota = max(1, most // max(1, df.select(*groups).distinct().count()))
    w = Window.partitionBy(*groups).orderBy("_h", uid)
    ranked = hashed.withColumn("_r", F.row_number().over(w))
    order = [(F.col("_r") > quota).cast("int"), F.when(F.col("_r") > quota, F.col("_h")), F.when(F.col("_r") > quota, F.col(uid)), *[F.col(c) for c in groups], "_h", uid]
    return ranked.orderBy(*order).limit(most).drop("_h", "_r")


def repaired(df: DataFrame, saved: DataFrame | None, keys: Sequence[str], strata: Sequence[str], seed: int = SEED) -> DataFrame:
    """Rows with every individual in one split, and its individual_key.

    Saved splits (individual_key, split; the first by name of a key's) go before the rows' own. If then any
    individual is in two splits or has none, or no saved split fits, all individuals are split anew.
    """
    rows = df if "split" in df.columns else df.withColumn("split", F.lit(None).cast("string"))
    rows = rows.withColumn("individual_key", F.concat_ws("|", *keys))
    fresh = individual_split(rows, keys, strata, seed).select("individual_key", F.col("split").alias("_new"))
    if saved is None:
        return rows.drop("split").join(fresh, "individual_key").withColumnRenamed("_new", "split")
    once = saved.groupBy("individual_key").agg(F.min("split").alias("_saved"))
    met = rows.join(once, "individual_key", "left").withColumn("split", F.coalesce("_saved", "split"))
    state = met.groupBy("individual_key").agg(F.count_distinct("split").alias("_k"), F.count_if(F.col("split").isNull()).alias("_none"), F.count("_saved").alias("_fit"))
    bad = state.agg(F.coalesce(F.max((F.col("_k") > 1) | (F.col("_none") > 0)) | (F.sum("_fit") == 0), F.lit(False)).alias("_bad"))
    out = met.join(fresh, "individual_key").crossJoin(F.broadcast(bad))  # one row
    return out.withColumn("split", F.when(F.col("_bad"), F.col("_new")).otherwise(F.col("split"))).drop("_saved", "_new", "_bad")


def formal_tables(tasks: DataFrame, points: DataFrame | None, saved: DataFrame | None, taxa: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Gaps of the taxa in scope with repaired splits, the points of those gaps, and the split table."""
    scope = tasks.filter(F.lower("taxon").isin(*[t.lower() for t in taxa]))
    out = repaired(scope, saved, keys, ["taxon"])
    kept = points.join(out.select("task_uid").distinct(), "task_uid", "left_semi") if points is not None else None
    own = ["individual_key", *dict.fromkeys([*keys, "taxon"])]
    return out, kept, out.select(*own, "split").distinct()


def split_report(tasks: DataFrame, splits: DataFrame) -> DataFrame:
    """Counts of gaps and individuals in all, by split, and by taxon and split; rows figure, taxon, split, n. A count over no rows is 0 for the totals and absent for the others."""
    counts = lambda df, figure, by: df.groupBy(*by).agg(F.count("*").alias("n")).select(
        F.lit(figure).alias("figure"), *[F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in ("taxon", "split")], "n"
    )
    out = counts(tasks, "n_tasks", []).unionByName(counts(splits.select("individual_key").distinct(), "n_individuals", []))
    for figure, df, by in (("tasks_by_split", tasks, ["split"]), ("tasks_by_taxon_split", tasks, ["taxon", "split"]), ("individuals_by_taxon_split", splits, ["taxon", "split"])):
        out = out.unionByName(counts(df, figure, by))
    return out
