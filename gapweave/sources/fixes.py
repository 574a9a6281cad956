"""Fixes made from the events table: each user's random walk, one fix per bin of the lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Data set and taxon by user_id % 5.
LABELS = (
    ("SantaCruz_puma", "puma"), ("Olympic_cougar", "cougar"), ("Thailand_tiger_leopard", "tiger"),
    ("Thailand_tiger_leopard", "leopard"), ("Olympic_bobcat", "bobcat"),
)


def minutes(time: Column) -> Column:
    """Minutes since 1970 of a time without zone."""
    return F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def event_fixes(spark: SparkSession, sf_dir: str, bin_min: int = 720) -> DataFrame:
    """Rows dataset, taxon, animal_id, sex, time, t (minutes), x, y, elev."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id", "ts", "event_id", (F.round(F.col("value") * 100).cast("long") - 4970).alias("ix"), (k * 100 - 4950).alias("iy"), k.alias("elev")
    )
    walk = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = (F.floor(minutes(F.col("ts")) / bin_min) * bin_min).cast("long")
    placed = events.select("user_id", "ts", "event_id", "elev", t.alias("t"), F.sum("ix").over(walk).cast("double").alias("x"), F.sum("iy").over(walk).cast("double").alias("y"))
    last = placed.groupBy("user_id", "t").agg(F.max(F.struct("ts", "event_id", "x", "y", "elev")).alias("e"))
    which = F.col("user_id") % 5
    label = lambda j: F.element_at(F.array(*[F.lit(v[j]) for v in LABELS]), which.cast("int") + 1)
    return last.select(
        label(0).alias("dataset"), label(1).alias("taxon"), F.col("user_id").cast("string").alias("animal_id"),
        F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.timestamp_add("MINUTE", F.col("t").cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("time"),
        "t", "e.x", "e.y", F.col("e.elev").cast("double").alias("elev"),
    )
