"""The model end to end, and the streaming gap filler."""

import pytest
from pyspark.sql import functions as F

from gapweave.plans import model as m, queries as plans
from gapweave.sources.fixes import event_fixes

SF = "/root/testdata/sf0.001"


def test_model(spark, tmp_path):
    train, test = plans.split_tasks(spark, SF)
    m.fit(train).save(str(tmp_path))
    model = m.load(spark, str(tmp_path))
    paired = m.benchmark(model, test)
    ratio = paired.filter("method = 'linear' AND ADE > 0").select(F.min("ade_ratio_to_linear"), F.max("ade_ratio_to_linear")).first()
    assert tuple(ratio) == (1.0, 1.0)
    assert paired.filter("method = 'pretrained_motif'").count() == test.count()
    coarse = event_fixes(spark, SF).filter("CAST(animal_id AS INT) < 3")
    rows = m.reconstruct_track(model, coarse, 120).collect()
    gaps = {r.task_uid for r in rows}
    assert len(gaps) == coarse.count() - coarse.select("animal_id").distinct().count()


def test_streaming(spark, tmp_path):
    rows = [("a", f"2024-01-01 0{h}:00:00", float(h), 0.0) for h in (0, 1, 3)] + [("b", "2024-01-01 00:00:00", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "animal_id string, time string, x double, y double").withColumn("time", F.col("time").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    from gapweave.streaming.gapfill import fill

    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = fill(stream, 60).writeStream.format("memory").queryName("filled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.animal_id, r.time.hour, r.x, r.filled) for r in spark.sql("SELECT * FROM filled").collect()}
    assert got == {("a", 0, 0.0, False), ("a", 1, 1.0, False), ("a", 2, 2.0, True), ("a", 3, 3.0, False), ("b", 0, 5.0, False)}


def test_metadata(spark):
    from gapweave.sources import metadata

    tracks = spark.createDataFrame([("d", "tiger", "31899"), ("d", "tiger", "7")], "dataset string, taxon string, animal_id string")
    meta = spark.createDataFrame([("x", "31899.0", "F", "sub adult"), ("y", "31899", "M", None), ("z", "8", None, None)], "note string, collar string, s string, a string")
    assert metadata.key_column(meta, tracks) == "collar"
    rows = {r.animal_id: r for r in metadata.attach(tracks, meta, "collar", "s", "a", order="note").collect()}
    assert (rows["31899"].sex, rows["31899"].age_class, rows["31899"].species_id, rows["31899"].metadata_source) == ("female", "subadult", "panthera_tigris", "table")
    assert (rows["7"].sex, rows["7"].transfer_unit) == ("unknown", "panthera_tigris__d")


def test_metric_bundle(spark, tmp_path):
    from gapweave.operators.evaluate import metric_bundle

    metric_bundle(plans.paired_of(spark, SF), str(tmp_path), "val")
    assert spark.read.parquet(str(tmp_path / "val_method.parquet")).count() == 3


def test_raster_discovery(spark, tmp_path):
    from gapweave.sources import rasters

    for name in ("slope.tif", "deep/Cover.TIF", "deep/slope.asc", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    found = rasters.discover(spark, str(tmp_path), {"grade": str(tmp_path / "slope.tif")})
    assert found["grade"] == str(tmp_path / "slope.tif") and set(found) == {"grade", "Cover", "slope"} and found["slope"].endswith("deep/slope.asc")
    assert set(rasters.discover(spark, str(tmp_path), recursive=False)) == {"slope"}
    assert rasters.discover(spark, str(tmp_path / "none")) == {} == rasters.discover(spark, None)


def test_reproject(spark):
    from pyspark.sql import functions as F

    from gapweave.sources import rasters

    with pytest.raises(ValueError, match="3857"):
        rasters.reproject(F.lit(0.0), F.lit(0.0), 3857, 4326)
    x, y = rasters.reproject(F.lit(-75.0), F.lit(-33.5), 4326, 32718)
    east, north = spark.range(1).select(x, y).first()
    assert abs(east - 500000) < 1e-6 and 6_200_000 < north < 6_300_000
    lon, lat = spark.range(1).select(*rasters.reproject(F.lit(east), F.lit(north), 32718, 4326)).first()
    assert abs(lon + 75) < 1e-9 and abs(lat + 33.5) < 1e-8


def test_reports_on_edges(spark):
    """Empty tables, nulls, NaN, one value, ties."""
    from pyspark.sql import functions as F

    from gapweave.operators import regimes, reporting

    rows = "task_uid string, method string, regime string, ADE double, ade_ratio_to_linear double, better_than_linear double, split string"
    none = spark.createDataFrame([], rows)
    nan = float("nan")
    for made in (reporting.compact(none), reporting.histogram(none, "ADE"), reporting.clipped(none, "ADE"), reporting.value_counts(none, ["regime"], "method", "ADE"),
                 reporting.weighted_means(none, ["regime"], "ADE", ["ADE"]), regimes.choose(none, "linear"), regimes.ranked_sets(none, none, (1,)), reporting.common_gaps(none, ["a"])):
        assert made.count() == 0
    odd = spark.createDataFrame([("a", "m", None, 2.0, None, None, None), ("a", "m", None, nan, nan, None, None), ("b", None, "r", None, 1.0, 1.0, "validation"), ("b", None, "r", float("inf"), 1.0, 1.0, "validation")], rows)
    assert [tuple(r) for r in reporting.histogram(odd, "ADE").collect()] == [(0, 2.0, 2.0, 1)]
    assert {r.regime: (r.dominant_method, r.method_counts) for r in reporting.value_counts(odd, ["regime"], "method", "ADE").collect()} == {None: ("m", "m:2"), "r": ("unknown", "unknown:2")}
    assert reporting.weighted_means(odd.filter("task_uid = 'a'").withColumn("w", F.lit(0.0)), ["task_uid"], "w", ["ADE"]).first().weighted_ADE == 1.0
    # a better method that wins too seldom is passed over for the default; a plain winner is not
    seen = [("t1", "x", "r", 1.0, 0.98, 0.0, "validation"), ("t2", "x", "r", 1.0, 0.98, 0.0, "validation"), ("t1", "d", "r", 1.0, 1.0, 0.9, "validation"), ("t2", "d", "r", 1.0, 1.0, 0.9, "validation")]
    df = spark.createDataFrame(seen, rows)
    assert tuple(regimes.choose(df, "d").first()) == ("r", "d", "default_guarded_no_eligible")
    plain = df.withColumn("method", F.when(F.col("method") == "x", "linear").otherwise("d"))
    assert tuple(regimes.choose(plain, "d").first()) == ("r", "linear", "fallback_to_clear_regime_winner")
    # a chosen method that a gap lacks gives way to the default, then the chord
    pool = spark.createDataFrame([("t3", "linear", "q", 1.0, 1.0, 0.0, "test"), ("t4", "z", None, 1.0, 1.0, 0.0, "test")], rows)
    got = {r.task_uid: (r.method, r.source_method) for r in regimes.apply_choices(pool, regimes.choose(df, "d"), "d", "sel").collect()}
    assert got == {"t3": ("sel", "linear"), "t4": ("sel", "z")}


def test_split_repair_without_individuals(spark):
    from gapweave.operators import splits

    df = spark.createDataFrame([("d", "a", "t", None), ("d", "a", "t", "test"), ("d", "b", "t", "train")], "dataset string, animal_id string, taxon string, split string")
    saved = spark.createDataFrame([("d|z", "train")], "individual_key string, split string")
    for given in (None, saved):
        out = splits.repaired(df, given, ["dataset", "animal_id"], ["taxon"])
        assert out.count() == 3 and splits.leaks(out).count() == 0 and out.filter("split is null").count() == 0
    assert splits.repaired(df.limit(0), saved, ["dataset", "animal_id"], ["taxon"]).count() == 0


def test_opt_in_families(spark):
    """Gaps without retrieved candidates, without headings and without length."""
    from gapweave.operators import variants

    kind = "task_uid string, style string, candidate_order int, total_cost double, rank int, path_ratio double, listwise_probability double, path array<struct<x:double,y:double>>, " + ", ".join(f"cost_{c} double" for c in variants.SCALES)
    chord = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]
    bent = [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]
    scored = spark.createDataFrame([("a", "direct_identity", 0, 1.0, 1, 1.0, 1.0, chord, None, 0.0, 0.0, 0.0), ("b", "retrieved_motif", 0, 1.0, 1, None, 1.0, bent, 0.0, 0.0, 0.0, 0.0)], kind)
    trust = {r.task_uid: r.confidence for r in variants.confidence(scored).collect()}
    assert abs(trust["a"] - (0.18 * 0.5 + 0.14 + 0.14 + 0.12 + 0.05 + 0.10)) < 1e-12
    assert abs(trust["b"] - (0.22 / 8 + 0.18 + 0.14 + 0.14 + 0.12 + 0.05 + 0.05)) < 1e-12
    ends = "task_uid string, start struct<x:double,y:double>, end struct<x:double,y:double>, n_points int, prev struct<x:double,y:double>, next struct<x:double,y:double>"
    tasks = spark.createDataFrame([("a", (0.0, 0.0), (2.0, 0.0), 3, None, None), ("b", (0.0, 0.0), (2.0, 0.0), 3, None, None), ("c", (1.0, 1.0), (1.0, 1.0), 3, (0.0, 0.0), None)], ends)
    flow = {r.task_uid: [tuple(p) for p in r.path] for r in variants.two_sided(tasks).collect()}
    assert flow["c"] == [(1.0, 1.0)] * 3 and flow["a"][0] == (0.0, 0.0) and flow["a"][-1] == (2.0, 0.0)
    rows = variants.every(scored, tasks).collect()
    assert not [r for r in rows if r.task_uid == "a" and "top1" in r.method]
    half = {r.method: [tuple(p) for p in r.path] for r in rows if r.task_uid == "b"}["pretrained_motif_residual_linear_top1_lam0p5"]
    assert half == [(0.0, 0.0), (1.0, 0.5), (2.0, 0.0)]
    assert variants.every(scored.limit(0), tasks.limit(0)).count() == 0
