"""Kernels against NumPy restatements of their formulas, and their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.functions import context, geometry as g, ids

RNG = np.random.default_rng(0)
PAIRS = [(RNG.normal(size=(n, 2)) * 100, RNG.normal(size=(n, 2)) * 100) for n in (2, 3, 5, 9) for _ in range(4)] + [(np.zeros((3, 2)), np.ones((3, 2)))]


def walk(p):
    return np.hypot(*np.diff(p, axis=0).T)


def frechet(a, b):
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    c = np.full(d.shape, np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            back = 0 if i == j == 0 else min(c[i - 1, j] if i else np.inf, c[i, j - 1] if j else np.inf, c[i - 1, j - 1] if i and j else np.inf)
            c[i, j] = max(back, d[i, j])
    return c[-1, -1]


def dtw(a, b):
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    c = np.full((len(a) + 1, len(b) + 1), np.inf)
    k = np.zeros(c.shape)
    c[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            ways = [(c[i - 1, j], k[i - 1, j]), (c[i, j - 1], k[i, j - 1]), (c[i - 1, j - 1], k[i - 1, j - 1])]
            best = ways[int(np.argmin([w[0] for w in ways]))]
            c[i, j], k[i, j] = best[0] + d[i - 1, j - 1], best[1] + 1
    return c[-1, -1] / k[-1, -1]


def spatial(a, b):
    out = []
    for p in a:
        u, v = b[:-1], b[1:]
        w = v - u
        t = np.clip(((p - u) * w).sum(axis=1) / np.maximum((w * w).sum(axis=1), 1e-9), 0, 1)
        out.append((((p - u - t[:, None] * w) ** 2).sum(axis=1)).min())
    return np.sqrt(np.mean(out))


@pytest.fixture(scope="module")
def paths(spark):
    pts = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    kind = "array<struct<x:double,y:double>>"
    return spark.createDataFrame([(i, pts(a), pts(b)) for i, (a, b) in enumerate(PAIRS)], f"i int, a {kind}, b {kind}").cache()


def test_metrics(paths):
    a, b = F.col("a"), F.col("b")
    cols = {"length": g.path_length(a), "ade": g.ade(a, b), "rmse": g.rmse(a, b), "spatial": g.spatial_rmse(a, b), "frechet": g.frechet(a, b), "dtw": g.dtw(a, b), "q90": g.quantile(g.steps(a), 0.9), "turns": g.turns(a)}
    for r in paths.select("i", *[c.alias(k) for k, c in cols.items()]).collect():
        p, q = PAIRS[r.i]
        far = np.hypot(*(p - q).T)
        assert np.allclose([r.length, r.ade, r.rmse, r.spatial, r.frechet, r.dtw, r.q90], [walk(p).sum(), far.mean(), np.sqrt((far**2).mean()), spatial(p, q), frechet(p, q), dtw(p, q), np.quantile(walk(p), 0.9)])
        assert max(far[0], far[-1]) - 1e-9 <= r.frechet <= far.max() + 1e-9
        assert 0 <= r.turns <= np.pi


def test_frame_round_trip(paths):
    shape = paths.withColumn("f", g.frame(F.col("a")))
    back = shape.select("i", g.out_of_frame(F.col("f"), F.element_at("a", 1), F.element_at("a", -1), F.lit(1.0)).alias("p"), "f")
    for r in back.collect():
        assert np.allclose([[p.x, p.y] for p in r.p], PAIRS[r.i][0], atol=1e-9)


def test_closed_paths(paths):
    a, b = F.element_at("a", 1), F.element_at("a", -1)
    before, none = F.element_at("b", 1), F.lit(None).cast("struct<x:double,y:double>")
    made = {"linear": g.linear_path(a, b, F.lit(7)), "hermite": g.hermite_path(a, b, F.lit(7), before, none), "rtg": g.rtg_path(a, b, F.lit(7)), "resampled": g.resample(F.col("a"), F.lit(7))}
    for r in paths.select("i", *[c.alias(k) for k, c in made.items()]).collect():
        p, q = PAIRS[r.i]
        t = np.linspace(0, 1, 7)[:, None]
        assert np.allclose([[v.x, v.y] for v in r.linear], p[0] * (1 - t) + p[-1] * t)
        m0 = 0.35 * (p[0] - q[0]) if np.hypot(*(p[0] - q[0])) > 1e-9 else 0.35 * (p[-1] - p[0])
        want = (2 * t**3 - 3 * t**2 + 1) * p[0] + (t**3 - 2 * t**2 + t) * m0 + (3 * t**2 - 2 * t**3) * p[-1] + (t**3 - t**2) * 0.35 * (p[-1] - p[0])
        assert np.allclose([[v.x, v.y] for v in r.hermite], want)
        for name in made:
            ends = np.array([[v.x, v.y] for v in (r[name][0], r[name][-1])])
            assert np.allclose(ends, p[[0, -1]], atol=1e-9)


def test_single_point_and_two_point(spark):
    df = spark.sql("SELECT array(struct(1.0D AS x, 2.0D AS y)) AS a, array(struct(1.0D AS x, 2.0D AS y), struct(1.0D AS x, 2.0D AS y)) AS b")
    r = df.select(g.path_length(F.col("a")).alias("l"), g.directness(F.col("b")).alias("d"), g.turns(F.col("b")).alias("t"), g.lateral_stats(F.col("b"))["mean_lateral"].alias("m")).first()
    assert (r.l, r.d, r.t, r.m) == (0.0, None, 0.0, 2.0)


def test_ids(spark):
    import hashlib

    rows = [("31899.0",), (" ab c ",), (None,), ("F/1 x",)]
    df = spark.createDataFrame(rows, "v string")
    got = df.select(ids.normalize_id(F.col("v")).alias("n"), ids.animal_key(F.col("v")).alias("k"), ids.hash01(F.col("v")).alias("h"), ids.make_uid(F.col("v"), F.lit("b")).alias("u")).collect()
    assert [r.n for r in got] == ["31899", "ab c", "", "F/1 x"] and got[1].k == "ABC"
    assert got[3].h == int(hashlib.md5(b"F/1 x").hexdigest()[:12], 16) / 16**12
    assert got[3].u == "F-1-x_b_" + hashlib.md5(b"F/1 x|b").hexdigest()[:12]


def test_context(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-07-01 06:00:00' AS a, timestamp_ntz'2024-07-01 08:00:00' AS b")
    r = df.select(*[c.alias(k) for k, c in context.temporal(F.col("a"), F.col("b")).items()]).first()
    assert (r.diel_bin, r.season) == ("dawn", "summer") and abs(r.mid_hour_sin - np.sin(2 * np.pi * 7 / 24)) < 1e-12


def test_utm(spark):
    from gapweave.sources.tables import project_utm

    df = spark.sql("SELECT 15.0D AS lon, 0.0D AS lat UNION ALL SELECT 9.0D, 45.0D")
    x, y = project_utm(F.col("lon"), F.col("lat"), 32633)
    rows = df.select(x.alias("x"), y.alias("y")).collect()
    assert abs(rows[0].x - 500000) < 1e-6 and abs(rows[0].y) < 1e-6
    assert abs(rows[1].x - 27253.0) < 500 and 4.98e6 < rows[1].y < 5.01e6


def test_sql_functions(spark):
    """SQL functions give what the column functions give, on null and short paths too."""
    from gapweave.functions import sql

    assert "gw_path_ade" in sql.register(spark)
    rows = [([(0.0, 0.0), (3.0, 4.0), (3.0, 9.0)], [(0.0, 1.0), (3.0, 4.0), (0.0, 5.0)], " a1 .0"), ([(1.0, 1.0)], [(2.0, 1.0)], "31899.0"), ([], [], ""), (None, None, None)]
    df = spark.createDataFrame(rows, "path array<struct<x:double,y:double>>, truth array<struct<x:double,y:double>>, value string")
    p, t, v = F.col("path"), F.col("truth"), F.col("value")
    pairs = {
        "gw_path_length_m(path)": g.path_length(p), "gw_path_directness(path)": g.directness(p), "gw_path_ade(path, truth)": g.ade(p, t), "gw_path_rmse(path, truth)": g.rmse(p, t),
        "gw_path_blend(path, truth, 0.25D)": g.blend(p, t, 0.25), "gw_normalize_id(value)": ids.normalize_id(v), "gw_animal_key(value)": ids.animal_key(v), "gw_stable_hash01(value)": ids.hash01(v),
    }
    for text, column in pairs.items():
        for got in df.selectExpr(f"{text} AS a", "path", "truth", "value").withColumn("b", column).collect():
            assert got.a == got.b or abs(got.a - got.b) < 1e-12, (text, got)
