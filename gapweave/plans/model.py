"""The model: motifs, priors and residual artifacts of training gaps; a folder of tables, and how gaps are filled with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.operators import evaluate, families, generators, library, scoring, series, transfer


@dataclass
class Model:
    motifs: DataFrame
    priors: DataFrame
    artifacts: DataFrame

    def save(self, folder: str) -> None:
        for name in ("motifs", "priors", "artifacts"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def fit(train: DataFrame, max_motifs: int = library.MAX_MOTIFS) -> Model:
    """A model of training gaps with truth."""
    return Model(library.build(train, max_motifs), scoring.movement_priors(train), generators.artifacts(train))


def load(spark: SparkSession, folder: str) -> Model:
    return Model(*[spark.read.parquet(f"{folder}/{name}.parquet") for name in ("motifs", "priors", "artifacts")])


def adapt(model: Model, calibration: DataFrame, union: bool = False) -> Model:
    """The model of calibration gaps alone, or with their motifs added to the model's own."""
    own = fit(calibration)
    return Model(model.motifs.unionByName(own.motifs), model.priors, model.artifacts) if union else own


def scored(model: Model, gaps: DataFrame) -> DataFrame:
    hits = library.retrieve(gaps, model.motifs)
    return scoring.score(scoring.candidates(scoring.with_priors(gaps, model.priors), hits, model.motifs), model.priors)


def reconstruct(model: Model, gaps: DataFrame, anchor: str = "direct", score: str = "cost_rank", beta: float = 0.5, lam: float = 0.25) -> DataFrame:
    """One path for each gap: by default three parts chord and one part weighted representative."""
    found = scored(model, gaps)
    mixed = families.blends(found, families.representatives(found))
    return mixed.filter((F.col("anchor") == anchor) & (F.col("score") == score) & (F.col("beta") == beta) & (F.col("lam") == lam)).select("task_uid", "path")


def path_table(gaps: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths as long rows with times."""
    rows = gaps.select("task_uid", "animal_id", "start_time", "fine_dt_min").join(paths, "task_uid").select("*", F.posexplode("path").alias("point_order", "p"))
    time = F.timestamp_add("MINUTE", (F.col("point_order") * F.col("fine_dt_min")).cast("int"), F.col("start_time"))
    return rows.select("task_uid", "animal_id", "point_order", time.alias("time"), "p.x", "p.y")


def reconstruct_track(model: Model, coarse: DataFrame, fine_min: float) -> DataFrame:
    """Sparse tracks (dataset, taxon, animal_id, time, x, y) filled at fine_min minutes."""
    gaps = series.prediction_gaps(coarse, fine_min).withColumns(
        {"sex": F.lit("unknown"), "truth": F.lit(None).cast("array<struct<x:double,y:double>>"), "truth_env": F.lit(None).cast("array<double>")}
    )
    return path_table(gaps, reconstruct(model, gaps))


def benchmark(model: Model, gaps: DataFrame) -> DataFrame:
    """Paired metrics of the baselines and the default reconstruction on gaps with truth."""
    keep = ["task_uid", "dataset", "taxon", "setting_name", "truth"]
    own = reconstruct(model, gaps).join(gaps.select(*keep), "task_uid").withColumn("method", F.lit("pretrained_motif"))
    base = evaluate.baselines(gaps).select(*keep, "method", "path")
    return evaluate.add_linear(evaluate.evaluate(base.unionByName(own.select(*base.columns))))


def few_shot(targets: DataFrame, calibration: DataFrame, days: tuple[int, ...] = (1, 3, 7, 14, 30)) -> DataFrame:
    """How much calibration each look-back window offers."""
    return transfer.coverage(targets, transfer.past_calibration(targets, calibration, days), days)
