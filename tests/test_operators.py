"""Operators on hand-built edge cases, and every fast query against its SQL twin."""

import collections
import glob
import hashlib
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gapweave.operators import families, generators, library, scoring, selection, series, splits, transfer
from gapweave.plans import queries as plans

SF = "/root/testdata/sf0.001"
SLOW = {"motif_library", "retrieve_rerank", "candidates", "score_candidates", "representatives", "blend_grid", "diverse_sr", "anchor_methods", "guarded_paths", "select_paths", "confidence", "adaptive_blends", "residual_paths"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def cells(df):
    number = lambda v: isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_))
    cols = sorted(df.columns)
    return cols, collections.Counter(tuple("" if pd.api.types.is_scalar(v) and pd.isna(v) else repr(float(v)) if number(v) else str(v) for v in row) for row in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(set(plans.SQL) - SLOW))
def test_query(spark, duck, name):
    assert cells(plans.QUERIES[name](spark, SF).toPandas()) == cells(duck.execute(plans.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def tracks(spark):
    """One animal on the lattice for forty days with a hole, one with too few fixes."""
    rows = [("d", "cougar", "a", "F", i * 60, float(i), float(i * i % 17), 1.0) for i in range(960) if i != 500] + [("d", "cougar", "b", "M", i * 60, 0.0, 0.0, None) for i in range(4)]
    df = spark.createDataFrame(rows, "dataset string, taxon string, animal_id string, sex string, t long, x double, y double, elev double")
    return df.withColumn("time", F.timestamp_add("MINUTE", F.col("t").cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))).cache()


@pytest.mark.parametrize(("coarse", "fine"), [(120, 60), (240, 60), (480, 120)])
def test_tasks_over_blocks(tracks, coarse, fine):
    """Blocks and halos find just the gaps that a scan of the whole track finds."""
    have = sorted(r.t for r in tracks.filter("animal_id = 'a'").collect())
    there, n = set(have), coarse // fine
    want = {t for i, t in enumerate(have) if i % n == 0 and all(t + k * fine in there for k in range(n + 1))}
    rows = series.make_tasks(tracks, [(coarse, fine)]).collect()
    got = {int((r.start_time - rows[0].start_time.replace(year=1970, month=1, day=1, hour=0)).total_seconds() // 60): r for r in rows}
    assert set(got) == want
    for t, r in got.items():
        assert (r.prev is not None) == (t - fine in there) and (r.next is not None) == (t + coarse + fine in there)
        assert [p.x for p in r.truth] == [float((t + k * fine) // 60) for k in range(n + 1)]


def test_first_fixes(tracks):
    twice = tracks.unionByName(tracks.withColumn("x", F.col("x") + 1))
    assert series.first_fixes(twice).count() == tracks.count()
    assert {(r.t, r.x) for r in series.first_fixes(twice).collect()} == {(r.t, r.x) for r in tracks.collect()}


@pytest.mark.parametrize(("n", "sizes"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (6, 2, 2)), (30, (21, 4, 5))])
def test_individual_split(spark, n, sizes):
    df = spark.range(n).select(F.col("id").cast("string").alias("animal"), F.lit("t").alias("taxon"))
    out = splits.individual_split(df, ["animal"], ["taxon"])
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "validation", "test")) == sizes
    assert splits.leaks(out).count() == 0


def test_grouped_split_sizes(spark):
    got = splits.grouped_split(spark.range(10).withColumn("g", F.lit(None).cast("string")), "id", ["g"]).groupBy("split").count()
    assert {r.split: r["count"] for r in got.collect()} == {"train": 7, "validation": 2, "test": 1}


def test_nearest_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, (300, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    want = {(q, int(h)) for q in range(20) for h in np.lexsort((np.arange(300), ((v - v[q]) ** 2).sum(axis=1)))[:7]}
    for block in (1000, 60):
        assert {(r.id, r.hit) for r in library.nearest(df.filter("id < 20"), df, 7, block).collect()} == want


def test_library_cut(spark):
    """A library cut to fewer motifs has those of the smallest hashes; no limit over a sort is in its plan, whose order executors do not keep."""
    train, _ = plans.split_tasks(spark, SF)
    uids = [r.task_uid for r in train.select("task_uid").collect()]
    want = sorted(uids, key=lambda u: (hashlib.md5(u.encode()).hexdigest()[:12], u))
    for most in (0, 1, len(uids) // 2, len(uids), len(uids) + 5):
        made = library.build(train, most)
        assert sorted(r.source_task_uid for r in made.collect()) == sorted(want[:most])
        assert "Limit" not in made._jdf.queryExecution().executedPlan().toString()


WHOLE = ["adaptive_blends", "anchor_methods", "diverse_sr", "family_benchmark", "guarded_paths", "representatives", "retrieve_rerank"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_library(spark, monkeypatch, name):
    """Every training gap is a motif: neither code nor SQL cuts the library."""

    def cut(*_):
        raise AssertionError("the library is cut")

    monkeypatch.setattr(library, "first_by_hash", cut)
    if name in plans.SQL:
        assert "LIMIT 25000" not in plans.SQL[name]
        assert plans.QUERIES[name](spark, SF).columns
    else:
        assert len(plans.family_paths(*plans.split_tasks(spark, SF))) == 6


def test_first_by_hash(spark):
    """Equal ids are rows like others, on whichever side of the cut."""
    df = spark.createDataFrame([(str(i // 3), i) for i in range(300)] + [(None, 300)], "uid string, v int").repartition(7)
    want = sorted((hashlib.md5(str(i // 3).encode()).hexdigest()[:12], str(i // 3)) for i in range(300))
    for most in (2, 101, 299):
        got = [r.uid for r in splits.first_by_hash(df, "uid", most).collect()]
        assert sorted(got, key=str) == sorted([None, *(u for _, u in want[: most - 1])], key=str)


def test_scoring(spark):
    """Ranks are a permutation, probabilities add up, candidates keep the ends and the bound."""
    scored, test = plans.scored_of(spark, SF)
    rows = scored.select("task_uid", "candidate_order", "rank", "listwise_probability", "total_cost", "path", "start", "end").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.task_uid].append(r)
        assert np.allclose([r.path[0].x, r.path[-1].y], [r.start.x, r.end.y], atol=1e-6)
    assert set(by) == {r.task_uid for r in test.select("task_uid").collect()}
    for group in by.values():
        assert len(group) <= 45 and sorted(r["rank"] for r in group) == list(range(1, len(group) + 1)) == sorted(r.candidate_order + 1 for r in group)
        assert abs(sum(r.listwise_probability for r in group) - 1) < 1e-9
        order = sorted(group, key=lambda r: r["rank"])
        assert all(a.total_cost <= b.total_cost for a, b in zip(order, order[1:], strict=False))
    picked = families.diverse(scored).groupBy("task_uid").agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("k")).collect()
    assert all(r.n == r.k <= 10 for r in picked)
    names = families.blends(scored, families.representatives(scored)).groupBy("task_uid").count().collect()
    assert {r["count"] for r in names} == {48}


def test_generators(spark):
    train, test = plans.split_tasks(spark, SF)
    one = generators.ecological(test, generators.artifacts(train)).collect()
    again = generators.ecological(test.repartition(3), generators.artifacts(train)).collect()
    key = lambda r: (r.task_uid, r.method)
    assert {key(r): r.path for r in one} == {key(r): r.path for r in again}
    ends = {r.task_uid: (r.start, r.end) for r in test.collect()}
    for r in one + generators.latent(train, test).collect():
        assert np.allclose([r.path[0].x, r.path[0].y], [ends[r.task_uid][0].x, ends[r.task_uid][0].y])


def test_balanced_set(spark):
    rows = [("t", f"{p}{i:02d}", f, float(i)) for f, p in selection.PREFIXES.items() for i in range(1, 6)]
    df = spark.createDataFrame(rows, "task_uid string, method string, family string, proxy double")
    got = selection.balanced_set(df, "proxy").collect()
    assert len(got) == 10 and collections.Counter(r.family for r in got if r.by_quota) == selection.QUOTA
    few = selection.balanced_set(df.filter("family = 'latent_direct'"), "proxy").collect()
    assert len(few) == 5 and sum(r.by_quota for r in few) == 2


def test_support_matches_pairs(spark):
    a, b = plans.units(spark, SF)
    counted = transfer.pairs(a, b).groupBy("target_animal_id").agg(*[F.count_if(F.col("transfer_relation") == r).alias(c) for r, c in zip(transfer.RELATIONS, ["n_ss", "n_sd", "n_ds", "n_dd"], strict=True)])
    want = {tuple(r) for r in counted.collect()}
    assert {(r.animal_id, r.n_ss, r.n_sd, r.n_ds, r.n_dd) for r in transfer.support(a, b, "animal_id").collect() if r.n_total} == want


def test_readers(spark, tmp_path):
    from gapweave.sources import tables

    (tmp_path / "a.csv").write_text("who,when,east,north,alt\n31899.0,2024-01-01T00:00:00Z,1,2,NaN\n,2024-01-01 00:00:00,1,2,3\n7,bad,1,2,3\n7,2024-01-01 01:00:00,x,2,3\n8,2024-01-01 02:00:00,5,6,7\n")
    spec = tables.TrackSpec("d", "cougar", (str(tmp_path / "a.csv"),), "who", "when", "east", "north", env_cols=("alt",))
    rows = sorted(tables.read_tracks(spark, spec).collect(), key=lambda r: r.animal_id)
    assert [(r.animal_id, str(r.time), r.x, r.env["alt"]) for r in rows] == [("31899", "2024-01-01 00:00:00", 1.0, None), ("8", "2024-01-01 02:00:00", 5.0, 7.0)]
    with pytest.raises(KeyError):
        tables.standardize(spark.range(1), spec)
    tables.write_table(spark.range(3), str(tmp_path / "t.parquet"))
    assert tables.read_table(spark, str(tmp_path / "t.csv")).count() == 3
    assert tables.layers_to_sample(spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b"), ["a", "b", "c"]) == ["b", "c"]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_utc_time(spark, zone):
    """Times are read alike under any session zone."""
    from gapweave.sources.tables import utc_time

    rows = [("2024-01-01T00:00:00Z", "2024-01-01 00:00:00"), ("2024-01-01 00:00:00", "2024-01-01 00:00:00"), ("2024-03-10T05:30:00+05:30", "2024-03-10 00:00:00"), ("2024-11-03 01:30:00", "2024-11-03 01:30:00"), ("2024-01-01", "2024-01-01 00:00:00"), ("bad", None), (None, None), ("2024-01-01 00:00:00.25 UTC", "2024-01-01 00:00:00.250000")]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, "t string, want string")
        assert [(None if r.got is None else str(r.got)) for r in df.select(utc_time(F.col("t")).alias("got")).collect()] == [w for _, w in rows]
        one = spark.sql("SELECT TIMESTAMP_SECONDS(1704067200) AS t").select(utc_time(F.col("t"), "timestamp").alias("got")).first().got
        assert str(one) == "2024-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_support_nulls(spark):
    """Null, empty and `nan` labels are one unknown label, for pairs and for counts."""
    rows = [("d", "a", None, "h"), ("d", "b", "", "h"), ("d", "c", "nan", None), ("d", "e", "lynx", "h"), ("d", "a", "", "h")]
    a = spark.createDataFrame(rows, "dataset string, animal_id string, species_id string, habitat_id string")
    counted = transfer.pairs(a, a).groupBy("target_animal_id").agg(*[F.count_if(F.col("transfer_relation") == r).alias(c) for r, c in zip(transfer.RELATIONS, ["n_ss", "n_sd", "n_ds", "n_dd"], strict=True)])
    got = {(r.animal_id, r.n_ss, r.n_sd, r.n_ds, r.n_dd) for r in transfer.support(a, a, "animal_id").collect()}
    assert got == {tuple(r) for r in counted.collect()} and ("b", 1, 1, 1, 0) in got
    assert {r.transfer_relation: r.n for r in transfer.relation_counts(a, a).collect()} == {r.transfer_relation: r["count"] for r in transfer.pairs(a, a).groupBy("transfer_relation").count().collect()}


def test_nearest_in_time_repeats(spark):
    """Repeated left rows each have a result, and columns that are no keys may be maps."""
    left = spark.sql("SELECT 'a' AS k, TIMESTAMP_NTZ '2024-01-01 00:10:00' AS time, map('x', 1) AS m FROM range(2)")
    right = spark.sql("SELECT 'a' AS k, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS time, 1.5D AS v UNION ALL SELECT 'a', TIMESTAMP_NTZ '2024-01-01 00:20:00', 2.5D")
    assert [(r.near_v, r.m) for r in transfer.nearest_in_time(left, right, ["k"], "time", ["v"], 30).collect()] == [(1.5, {"x": 1})] * 2


def test_json_and_twins(spark, tmp_path):
    from gapweave.sources import tables

    spec = tables.TrackSpec("d", "cougar", ("a.csv",), "who", "when", "e", "n", env_cols=("alt",), settings=((240, 60),))
    tables.write_json({"spec": tables.spec_json(spec)}, f"file://{tmp_path}/s.json")
    assert tables.spec_of(tables.read_json(f"file://{tmp_path}/s.json")["spec"]) == spec
    tables.write_table(spark.range(3), f"file://{tmp_path}/t.parquet")
    assert tables.read_table(spark, f"file://{tmp_path}/t.csv").count() == 3


def test_coarser_artifacts(spark):
    """Gaps without a training gap of their labels or size keep all paths of the seeded families."""
    from gapweave.operators import generators

    train, test = plans.split_tasks(spark, SF)
    few = train.filter("n_points = 3 AND taxon = 'puma'")
    rows = generators.ecological(test, generators.artifacts(few)).groupBy("task_uid").count().collect()
    assert len(rows) == test.count() and {r["count"] for r in rows} == {20}
    none = generators.ecological(test, generators.artifacts(few.limit(0))).groupBy("task_uid").count().collect()
    assert len(none) == len(rows)


def test_expanded_sets_on_edges(spark):
    """One family alone has no sets; null and NaN errors never win; fewer ranks make a smaller name."""
    kind = "task_uid string, method string, family string, source_rank int, ADE double"
    d, la = ("motif_diverse_sr", "latent_direct")
    rows = [("t", "d1", d, 1, float("nan")), ("t", "d2", d, 2, 3.0), ("t", "l1", la, 1, None), ("t", "l4", la, 4, 1.0), ("u", "d1", d, 1, None)]
    df = spark.createDataFrame(rows, kind)
    got = {(r.method, r.source_method, r.ADE) for r in selection.expanded_oracle(df, ((3, 3), (5, 5))).collect()}
    assert got == {("expanded_sr_top3_minADE_candidate_set", "d2", 3.0), ("expanded_sr_top4_minADE_candidate_set", "l4", 1.0)}
    assert selection.expanded_oracle(df.filter(F.col("family") == d)).count() == selection.expanded_oracle(df.limit(0)).count() == 0


def test_pairs_in_many_tasks(spark, monkeypatch):
    """The product is dealt out over tasks, whichever side is larger and where neither is small, and stays whole."""
    unit = ["'d' AS dataset", "CAST(id AS string) AS animal_id", "CAST(id % 3 AS string) AS species_id", "CAST(id % 2 AS string) AS habitat_id"]
    few, many = spark.range(20).selectExpr(*unit), spark.range(60).selectExpr(*unit)
    kind = lambda s, t: transfer.RELATIONS[2 * (s % 3 != t % 3) + (s % 2 != t % 2)]
    for limit in (transfer.FEW, 0):
        monkeypatch.setattr(transfer, "FEW", limit)
        for a, b, n, m in ((few, many, 20, 60), (many, few, 60, 20)):
            rows = transfer.pairs(a, b, cell=100).select("source_animal_id", "target_animal_id", "transfer_relation", F.spark_partition_id().alias("task")).collect()
            want = [(str(s), str(t), kind(s, t)) for s in range(n) for t in range(m) if s != t]
            assert sorted(tuple(r)[:3] for r in rows) == sorted(want) and len({r.task for r in rows}) > 5


def test_pairs_are_compact(spark, tmp_path):
    """Pairs are made in an order that files store in a small part of a byte a row."""
    unit = ["'d' AS dataset", "CAST(id AS string) AS animal_id", "CAST(id % 25 AS string) AS species_id", "CAST(id % 5 AS string) AS habitat_id"]
    a = spark.range(2500).selectExpr(*unit)
    transfer.pairs(a, a).select("source_animal_id", "target_animal_id", "transfer_relation").write.parquet(out := str(tmp_path / "pairs"))
    rows = spark.read.parquet(out).groupBy("transfer_relation").count().collect()
    assert {r.transfer_relation: r["count"] for r in rows} == {"same_species_same_habitat": 2500 * 99, "different_species_same_habitat": 2500 * 400, "different_species_different_habitat": 2500 * 2000}
    assert sum(os.path.getsize(p) for p in glob.glob(f"{out}/*.parquet")) < 0.2 * 2500 * 2499


def test_family_benchmark(spark):
    """All families are evaluated over all test gaps, and the plan that is left has no family's plan in it."""
    got = plans.family_benchmark(spark, SF)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    rows = {r.method: r for r in got.collect()}
    train, test = plans.split_tasks(spark, SF)
    n = test.count()
    assert sum(m.startswith("pretrained_motif_") for m in rows) == 8 + 48 + 1 and len([m for m in rows if "ecological" in m]) == 20
    assert all(r.n_tasks == n for m, r in rows.items() if "diverse" not in m and "latent" not in m)
    assert rows["linear"].ade_ratio_to_linear_median == 1.0 and rows["endpoint_fallback"].ADE_median == rows["linear"].ADE_median
    errors = [r.ADE for r in plans.evaluate.evaluate(plans.evaluate.baselines(test).filter("method = 'rtg_bridge'")).collect()]
    assert abs(rows["rtg_bridge"].ADE_median - np.median(errors)) < 1e-5


def test_adaptive_blends_plan(spark):
    """The candidates are staged: what is left to plan has neither retrieval nor scoring in it."""
    got = plans.QUERIES["adaptive_blends"](spark, SF)
    assert len(got._jdf.queryExecution().executedPlan().toString()) < 300_000
    _, test = plans.split_tasks(spark, SF)
    assert got.select("task_uid", "method").distinct().count() == 4 * test.count()
