"""Queries of regimes, reports, split repair, metadata and rasters, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapweave.functions import geometry as g
from gapweave.operators import evaluate, families, regimes, reporting, series, splits, variants
from gapweave.plans import oracle as o, oracle_motifs as om
from gapweave.plans.queries import INDIVIDUAL, PAIRED, SPLIT, event_fixes, family_benchmark, load, long_path, long_sql, paired_of, paired_split, paths_of, query, r6, scored_of, staged, tasks_of
from gapweave.sources import metadata, rasters

# --- regimes -------------------------------------------------------------------------------

PLACES = ("Olympic_bobcat", "Olympic_cougar", "SantaCruz_puma", "Thailand_tiger_leopard", "Other")
TAXA = ("bobcat", "cougar", "puma", "tiger", "leopard", "wolf")
GAPS = ("240min_to_5min", "120min_to_5min", "60min_to_15min", "30min_to_5min", "240min_to_60min", "15min_to_5min", None)


@query(f"""WITH k AS (SELECT o_orderkey, {list(PLACES)}[o_orderkey % 5 + 1] AS d, {list(TAXA)}[o_orderkey % 6 + 1] AS t, [{', '.join(f"'{x}'" if x else 'NULL' for x in GAPS)}][o_orderkey % 7 + 1] AS s FROM orders),
h AS (SELECT *, lower(d || ' ' || t) AS w, coalesce(s, '') AS g FROM k)
SELECT o_orderkey, CASE WHEN w LIKE '%bobcat%' THEN 'olympic_bobcat_240_to_60' WHEN w LIKE '%cougar%' THEN 'olympic_cougar_240_to_60'
WHEN w LIKE '%puma%' THEN CASE WHEN g LIKE '%240%' THEN 'puma_long_240_to_5' WHEN g LIKE '%120%' THEN 'puma_mid_120_to_5' WHEN g LIKE '%60%' THEN 'puma_short_60_to_5' WHEN g LIKE '%30%' THEN 'puma_short_30_to_5' ELSE 'puma_other' END
WHEN w LIKE '%tiger%' OR w LIKE '%leopard%' OR w LIKE '%thailand%' THEN 'thailand_' || CASE WHEN w LIKE '%leopard%' THEN 'leopard' ELSE 'tiger' END || CASE WHEN g LIKE '%60%' AND g LIKE '%15%' THEN '_60_to_15' WHEN g LIKE '%240%' AND g LIKE '%60%' THEN '_240_to_60' ELSE '_other' END
ELSE d || '|' || t || '|' || coalesce(s, 'missing') END AS regime FROM h""")
def regime_labels(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", regimes.regime_label(pick(PLACES), pick(TAXA), pick(GAPS)).alias("regime"))


def regime_pool(spark, sf) -> DataFrame:
    return paired_split(spark, sf).withColumn("regime", regimes.regime_label(F.col("dataset"), F.col("taxon"), F.col("setting_name")))


REGIMES = SPLIT + """, rp AS (SELECT *, CASE taxon WHEN 'bobcat' THEN 'olympic_bobcat_240_to_60' WHEN 'cougar' THEN 'olympic_cougar_240_to_60' WHEN 'puma' THEN 'puma_other' ELSE 'thailand_leopard_other' END AS regime FROM ps),
rf AS (SELECT regime, method, count(DISTINCT task_uid) AS n, median(ade_ratio_to_linear) AS med, avg(ADE) AS mean, quantile_cont(ade_ratio_to_linear, 0.9) AS q90, avg(better_than_linear) AS win FROM rp WHERE split = 'validation' GROUP BY regime, method),
rg AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY med, mean, q90, win DESC, method) AS place FROM rf),
rd AS (SELECT r.regime, coalesce(d.med, 1) AS dmed, coalesce(d.mean, 1e300) AS dmean, coalesce(d.q90, 1e300) AS dq90, coalesce(d.win, 0) AS dwin FROM (SELECT DISTINCT regime FROM rg) r LEFT JOIN rg d ON d.regime = r.regime AND d.method = 'rtg_bridge'),
re AS (SELECT rg.*, n >= 2 AND med <= least(dmed - 0.005, 0.995) AND mean <= dmean + 10 AND q90 <= dq90 + 0.20 AND win >= greatest(0.30, dwin - 0.10) AS ok, place = 1 AND (method IN ('linear', 'heading_hermite') OR med <= dmed - 0.03) AS clear FROM rg JOIN rd USING (regime)),
rc AS (SELECT regime, coalesce(arg_min(method, place) FILTER (ok), max(method) FILTER (clear), 'rtg_bridge') AS method,
 CASE WHEN bool_or(ok) THEN 'regime_validation_selected' WHEN bool_or(clear) THEN 'fallback_to_clear_regime_winner' ELSE 'default_guarded_no_eligible' END AS reason FROM re GROUP BY regime)"""


@query(o.with_(REGIMES) + "SELECT * FROM rc")
def regime_choices(spark, sf):
    return regimes.choose(regime_pool(spark, sf).filter("split = 'validation'"), "rtg_bridge")


@query(o.with_(REGIMES) + "SELECT rp.task_uid, rp.regime, 'regime_aware' AS method, rp.method AS source_method, round(rp.ADE, 6) + 0.0 AS ADE FROM rp JOIN rc ON rc.regime = rp.regime AND rc.method = rp.method")
def regime_selector(spark, sf):
    pool = regime_pool(spark, sf)
    chosen = regimes.choose(pool.filter("split = 'validation'"), "rtg_bridge")
    return regimes.apply_choices(pool, chosen, "rtg_bridge", "regime_aware").select("task_uid", "regime", "method", "source_method", r6("ADE"))


@query(o.with_(REGIMES) + """, sk AS (SELECT task_uid, method, round(ADE, 6) AS ADE, place, k FROM rp JOIN rg USING (regime, method), (SELECT unnest([1, 2, NULL]) AS k) WHERE k IS NULL OR place <= k)
SELECT task_uid, CASE WHEN k IS NULL THEN 'calibrated_full_proposed_pool_oracle' ELSE 'calibrated_top' || k || '_validation_ranked_set_oracle' END AS method, arg_min(method, row(ADE, method)) AS source_method, min(ADE) + 0.0 AS ADE, count(*) AS n_in_set,
true AS oracle_within_generated_set FROM sk GROUP BY task_uid, k""")
def calibrated_sets(spark, sf):
    pool = regime_pool(spark, sf).withColumn("ADE", F.round("ADE", 6))
    return regimes.ranked_sets(pool, regime_pool(spark, sf).filter("split = 'validation'"), (1, 2))


@query(o.with_(SPLIT) + """, pr AS (SELECT method, median(ade_ratio_to_linear) AS r, avg(better_than_linear) AS w FROM ps WHERE split = 'validation' AND method <> 'heading_hermite' GROUP BY method)
SELECT task_uid, method, round(coalesce(r, 1), 6) + 0.0 AS prior_median_ratio, round(coalesce(w, 0), 6) + 0.0 AS prior_mean_win FROM ps LEFT JOIN pr USING (method)""")
def method_priors(spark, sf):
    """Methods' priors on all rows; one method has no validation rows and so gets the defaults."""
    p = paired_split(spark, sf)
    return reporting.method_priors(p.filter("method <> 'heading_hermite'"), p).select("task_uid", "method", r6("prior_median_ratio"), r6("prior_mean_win"))


# --- reports -------------------------------------------------------------------------------


@query(o.with_(PAIRED) + ", nm AS (SELECT task_uid, CASE method WHEN 'heading_hermite' THEN 'selector_v26b' WHEN 'rtg_bridge' THEN 'motif_x' ELSE method END AS method FROM metrics2) SELECT task_uid, method FROM nm WHERE method IN ('linear', 'selector_v26b')")
def compact_report(spark, sf):
    named = F.when(F.col("method") == "heading_hermite", "selector_v26b").when(F.col("method") == "rtg_bridge", "motif_x").otherwise(F.col("method"))
    return reporting.compact(paths_of(spark, sf).select("task_uid", named.alias("method")))


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, [0.01, 0.99]) AS q FROM orders), c AS (SELECT orders.* FROM orders, e WHERE o_totalprice BETWEEN q[1] AND q[2]), r AS (SELECT min(o_totalprice) AS a, (max(o_totalprice) - min(o_totalprice)) / 24 AS w FROM c)
SELECT o_orderstatus, least(floor((o_totalprice - a) / w), 23)::INT AS bin, round(a + least(floor((o_totalprice - a) / w), 23) * w, 6) + 0.0 AS lower, round(a + (least(floor((o_totalprice - a) / w), 23) + 1) * w, 6) + 0.0 AS upper, count(*) AS n FROM c, r GROUP BY ALL""")
def clipped_histogram(spark, sf):
    rows = reporting.clipped(load(spark, sf, "orders"), "o_totalprice", uid="o_orderkey")
    return reporting.histogram(rows, "o_totalprice", ["o_orderstatus"]).select("o_orderstatus", "bin", r6("lower"), r6("upper"), "n")


@query("WITH e AS (SELECT quantile_cont(o_totalprice, [0.05, 0.95]) AS q FROM orders) SELECT o_orderkey, o_totalprice FROM orders, e WHERE o_totalprice BETWEEN q[1] AND q[2] ORDER BY " + o.hash01("o_orderkey::VARCHAR") + ", o_orderkey LIMIT 100")
def clipped_sample(spark, sf):
    """A clipped sample for display: a hundred rows, by hash, are the operator's own limit."""
    return reporting.clipped(load(spark, sf, "orders"), "o_totalprice", 0.05, 0.95, 100, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(o.with_(PAIRED) + ", lb AS (SELECT task_uid, animal_id, CASE WHEN animal_id::INT % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM tasks WHERE animal_id::INT % 4 <> 0) SELECT m.task_uid, m.method, lb.animal_id, lb.split FROM metrics2 m LEFT JOIN lb USING (task_uid)")
def attach_labels(spark, sf):
    """Metrics lose the label columns that the gaps' table has, and get those; gaps without labels get null."""
    m = paths_of(spark, sf).select("task_uid", "method", "animal_id")
    t = tasks_of(spark, sf).filter("CAST(animal_id AS INT) % 4 <> 0").select("task_uid", "animal_id", F.when(F.col("animal_id").cast("int") % 3 == 0, "train").otherwise("test").alias("split"))
    return reporting.attach(m, t.unionByName(t), ["animal_id", "split", "habitat_id"]).select("task_uid", "method", "animal_id", "split")


@query(o.with_(o.tasks()) + ", w AS (SELECT task_uid, dataset, taxon, animal_id, start_time + (end_time - start_time) / 2 AS mid FROM tasks) SELECT task_uid, time, x, y FROM w JOIN fixes f USING (dataset, taxon, animal_id) WHERE f.time BETWEEN mid - INTERVAL 12 HOUR AND mid + INTERVAL 12 HOUR")
def context_fixes(spark, sf):
    return reporting.context_fixes(event_fixes(spark, sf), tasks_of(spark, sf)).select("task_uid", "time", "x", "y")


@query(o.with_(o.tasks()) + f", c AS (SELECT task_uid, truth, s, e, {o.dist('s', 'e')} AS d FROM tasks) SELECT task_uid, round(CASE WHEN d > 0 THEN list_max(list_transform(truth, lambda p: abs((e.x - s.x) * (p.y - s.y) - (e.y - s.y) * (p.x - s.x)) / d)) / greatest(d, 1) ELSE 0 END, 6) + 0.0 AS curvature FROM c")
def truth_curvature(spark, sf):
    return tasks_of(spark, sf).select("task_uid", r6(reporting.curvature(F.col("truth")), "curvature"))


@query("""WITH v AS (SELECT o_custkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS o_orderstatus, o_orderkey FROM orders), c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS k FROM v GROUP BY ALL)
SELECT o_custkey, arg_min(o_orderstatus, k) AS top_o_orderstatus, arg_min(o_orderstatus, row(-n, k)) AS dominant_o_orderstatus, string_agg(o_orderstatus || ':' || n, ';' ORDER BY n DESC, k) AS o_orderstatus_counts FROM c GROUP BY o_custkey""")
def dominant_values(spark, sf):
    rows = load(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return reporting.value_counts(rows, ["o_custkey"], "o_orderstatus", "o_orderkey")


@query("""WITH v AS (SELECT l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 ELSE l_quantity END AS w, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS d FROM lineitem)
SELECT l_suppkey, round(CASE WHEN sum(w) > 0 THEN sum(w * coalesce(d, 0)) / sum(w) ELSE sum(d) / count(*) END, 6) + 0.0 AS weighted_d FROM v GROUP BY l_suppkey""")
def weighted_diagnostics(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_suppkey") % 5 == 0, 0.0).otherwise(F.col("l_quantity")).alias("w"), F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("d"))
    return reporting.weighted_means(rows, ["l_suppkey"], "w", ["d"]).select("l_suppkey", r6("weighted_d"))


@query(o.with_(PAIRED) + "SELECT task_uid FROM paired WHERE method = 'rtg_bridge' AND ADE <= linear_ADE INTERSECT SELECT task_uid FROM paired WHERE method = 'heading_hermite' AND ADE <= linear_ADE")
def common_gaps(spark, sf):
    return reporting.common_gaps(paired_of(spark, sf).filter("ADE <= linear_ADE"), ["rtg_bridge", "heading_hermite"])


GUARDED = om.SCORED + """, gd AS (SELECT *, path_ratio <= 3 AND violation <= 0.2 AS ok, row_number() OVER (PARTITION BY task_uid ORDER BY violation, path_ratio, total_cost, candidate_order) AS least FROM scored),
ge AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY task_uid) AS any_ok FROM gd) WHERE CASE WHEN any_ok THEN ok ELSE least <= 5 END),
gr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task_uid ORDER BY total_cost, candidate_order) AS guard_rank, count(*) OVER (PARTITION BY task_uid) AS n_usable FROM ge)"""


@query(om.whole(o.with_(GUARDED)) + "SELECT task_uid, candidate_id, guard_rank::INT AS guard_rank, n_usable FROM gr WHERE guard_rank <= 5")
def guarded_paths(spark, sf):
    return reporting.guarded_paths(scored_of(spark, sf, None)[0]).filter("guard_rank <= 5").select("task_uid", "candidate_id", "guard_rank", "n_usable")


@query(o.with_(GUARDED) + """, gw AS (SELECT task_uid, path, exp(-0.5 * (total_cost - min(total_cost) OVER (PARTITION BY task_uid))) AS w FROM gr WHERE guard_rank <= 20),
gv AS (SELECT *, w / sum(w) OVER (PARTITION BY task_uid) AS share FROM gw), gp AS (SELECT task_uid, share, generate_subscripts(path, 1) AS i, unnest(path) AS p FROM gv),
gm AS (SELECT task_uid, i, sum(share * p.x) AS x, sum(share * p.y) AS y FROM gp GROUP BY ALL), sel AS (SELECT task_uid, list({'x': x, 'y': y} ORDER BY i) AS path FROM gm GROUP BY task_uid) """ + long_sql("sel"))
def select_paths(spark, sf):
    return long_path(reporting.select_paths(scored_of(spark, sf)[0]))


@query(om.whole(o.with_(om.MIXED)) + """, fx AS (SELECT task_uid, coalesce(t, dr) AS a, coalesce(dr, t) AS b FROM an), fy AS (SELECT task_uid, 'pretrained_motif_top1' AS method, a AS path FROM fx UNION ALL SELECT task_uid, 'endpoint_fallback', b FROM fx) """ + long_sql("fy", "path", "method"))
def anchor_methods(spark, sf):
    return long_path(families.anchor_methods(scored_of(spark, sf, None)[0]), "path", "method")


_m = lambda c, known, p, q: f"CASE WHEN {known} IS NOT NULL AND {o.dist(p, q)} > 0 AND {o.dist('s', 'e')} > 1e-9 THEN ({q}.{c} - {p}.{c}) / {o.dist(p, q)} * {o.dist('s', 'e')} ELSE e.{c} - s.{c} END"
_f = lambda c: f"(2*t**3 - 3*t**2 + 1) * s.{c} + (t**3 - 2*t**2 + t) * 0.55 * ({_m(c, 'prev', 'prev', 's')}) + (3*t**2 - 2*t**3) * e.{c} + (t**3 - t**2) * 0.55 * ({_m(c, 'nxt', 'e', 'nxt')})"
FLOW = o.fractions("{'x': " + _f("x") + ", 'y': " + _f("y") + "}")


@query(o.with_(o.tasks()) + f", l AS (SELECT task_uid, {FLOW} AS path FROM tasks) " + long_sql("l"))
def two_sided_flow(spark, sf):
    return long_path(variants.two_sided(tasks_of(spark, sf)))


@query(o.with_(o.tasks()) + f", l AS (SELECT task_uid, n_points AS n, {o.RTG} AS path FROM tasks), h AS (SELECT task_uid, n, path, gamma, i, ((i - 1) / (n - 1)) ** gamma * (n - 1) AS u FROM l, (SELECT unnest([0.75, 1.3])::DOUBLE AS gamma), (SELECT unnest(range(1, 20)) AS i) WHERE i <= n) "
       + "SELECT task_uid, gamma, (i - 1)::INT AS point_order, round(path[floor(u)::INT + 1].x + (u - floor(u)) * (path[least(floor(u)::INT + 2, n)].x - path[floor(u)::INT + 1].x), 6) + 0.0 AS x, round(path[floor(u)::INT + 1].y + (u - floor(u)) * (path[least(floor(u)::INT + 2, n)].y - path[floor(u)::INT + 1].y), 6) + 0.0 AS y FROM h")
def phase_warp(spark, sf):
    t, (s, e, n) = tasks_of(spark, sf), (F.col(c) for c in ("start", "end", "n_points"))
    both = F.array(*[F.struct(F.lit(x).alias("gamma"), g.phase_warp(g.rtg_path(s, e, n), x).alias("path")) for x in (0.75, 1.3)])
    return long_path(t.select("task_uid", F.explode(both).alias("m")).select("task_uid", "m.gamma", "m.path"), "path", "gamma")


TRUSTED = om.MIXED + """, cf0 AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY task_uid ORDER BY total_cost, candidate_order) <= 20),
cf1 AS (SELECT task_uid, count(*) FILTER (style = 'retrieved_motif') AS n, max(-total_cost) AS best, quantile_cont(-total_cost, 0.75) AS q, count(*) AS every_, arg_min({'d': cost_direction, 'c': cost_context, 'e': cost_efficiency, 's': cost_source_shape, 'r': path_ratio}, row(total_cost, candidate_order)) AS f FROM cf0 GROUP BY task_uid),
cf AS (SELECT task_uid, 0.22 * least(1, n / 8) + 0.18 * exp(-f.d) + 0.14 * exp(-f.c / 1.2) + 0.14 * exp(-f.e) + 0.12 * exp(-f.s) + 0.10 * CASE WHEN every_ > 1 THEN greatest(0, least(1, (best - q) / (abs(best) + 1e-6))) ELSE 0.5 END + 0.10 * CASE WHEN f.r > 0 THEN exp(-abs(ln(greatest(f.r, 1e-6))) / 0.75) ELSE 0.5 END AS confidence FROM cf1)"""


@query(o.with_(TRUSTED) + "SELECT task_uid, round(confidence, 6) + 0.0 AS confidence FROM cf")
def confidence(spark, sf):
    return variants.confidence(scored_of(spark, sf)[0]).select("task_uid", r6("confidence"))


@query(om.whole(o.with_(TRUSTED)) + f""", ab AS (SELECT task_uid, 'pretrained_motif_adaptive_blend_direct_weighted_' || score || '_K20_b' || beta::DOUBLE AS method, 0.12 + 0.6 * confidence AS w, coalesce(dr, t) AS a, path FROM rep JOIN an USING (task_uid) JOIN cf USING (task_uid) WHERE beta IN (0.35, 0.5)),
ac AS (SELECT task_uid, method, list_transform(range(1, len(path) + 1), lambda i: {{'x': (1 - w) * a[i].x + w * path[i].x, 'y': (1 - w) * a[i].y + w * path[i].y}}) AS path FROM ab) """ + long_sql("ac", "path", "method"))
def adaptive_blends(spark, sf):
    return long_path(variants.adaptive_blends(staged(scored_of(spark, sf, None)[0])), "path", "method")  # read four times: unstaged, a driver of 750 MB heap ends while its plan is made


@query(o.with_(TRUSTED) + f""", rw AS (SELECT task_uid, 'weighted_cost_rank_K20_b' || beta::DOUBLE AS source, path FROM rep WHERE score = 'cost_rank' AND beta IN (0.35, 0.5) UNION ALL SELECT task_uid, 'top1', t FROM an WHERE t IS NOT NULL
 UNION ALL SELECT task_uid, 'top1_phase_g' || gamma, list_transform(list_transform(range(0, len(t)), lambda k: (k / (len(t) - 1)) ** gamma * (len(t) - 1)), lambda u: {{'x': t[floor(u)::INT + 1].x + (u - floor(u)) * (t[least(floor(u)::INT + 2, len(t))].x - t[floor(u)::INT + 1].x),
 'y': t[floor(u)::INT + 1].y + (u - floor(u)) * (t[least(floor(u)::INT + 2, len(t))].y - t[floor(u)::INT + 1].y)}}) FROM an, (SELECT unnest([0.9, 1.1])::DOUBLE AS gamma) WHERE t IS NOT NULL),
rb AS (SELECT task_uid, source, path, confidence, {o.LINEAR} AS chord, {FLOW} AS flow FROM rw JOIN te USING (task_uid) JOIN cf USING (task_uid)),
rm AS (SELECT task_uid, 'pretrained_motif_residual_' || short || '_' || source || '_lam' || lam AS method, CASE lam WHEN 'conf' THEN greatest(0.05, least(0.85, confidence)) ELSE 0.5 END AS w, CASE short WHEN 'flow' THEN flow ELSE chord END AS base, path, chord FROM rb, (SELECT unnest(['conf', '0p5']) AS lam), (SELECT unnest(['linear', 'flow']) AS short)),
rn AS (SELECT task_uid, method, list_transform(range(1, len(base) + 1), lambda i: CASE WHEN i = 1 THEN chord[1] WHEN i = len(base) THEN chord[len(base)] ELSE {{'x': base[i].x + w * (path[i].x - chord[i].x), 'y': base[i].y + w * (path[i].y - chord[i].y)}} END) AS path FROM rm) """ + long_sql("rn", "path", "method"))
def residual_paths(spark, sf):
    scored, test = scored_of(spark, sf)
    return long_path(variants.residuals(scored, test), "path", "method")


query()(family_benchmark)

# --- splits, settings, metadata ------------------------------------------------------------

def saved_splits(spark, sf, every: int) -> DataFrame:
    """A split by the id for some individuals."""
    some = event_fixes(spark, sf).filter(f"CAST(animal_id AS INT) % {every} = 0").select(F.concat_ws("|", *series.KEY).alias("individual_key"), "animal_id").distinct()
    return some.select("individual_key", F.when(F.col("animal_id").cast("int") % 2 == 0, "train").otherwise("test").alias("split"))


@query(o.with_(INDIVIDUAL) + """, s AS (SELECT *, CASE WHEN animal_id::INT % 2 = 0 THEN 'train' ELSE 'test' END AS kept FROM isplit JOIN (SELECT dataset, taxon, animal_id, count(*) AS n FROM fixes GROUP BY ALL) USING (dataset, taxon, animal_id))
SELECT 'none saved' AS kind, individual_key, split, n FROM s UNION ALL SELECT 'some saved', individual_key, split, n FROM s UNION ALL SELECT 'all saved', individual_key, kept, n FROM s""")
def split_repair(spark, sf):
    """Fixes split by day leak; without saved splits, or with some only, all individuals are split anew, with all saved those stay."""
    days = event_fixes(spark, sf).withColumn("split", splits.global_split(F.concat_ws("|", "animal_id", F.date_format("time", "yyyy-MM-dd"))))
    out = None
    for kind, saved in (("none saved", None), ("some saved", saved_splits(spark, sf, 2)), ("all saved", saved_splits(spark, sf, 1))):
        one = splits.repaired(days, saved, series.KEY, ["taxon"]).groupBy("individual_key", "split").agg(F.count("*").alias("n"))
        one = one.select(F.lit(kind).alias("kind"), "individual_key", "split", "n")
        out = one if out is None else out.unionByName(one)
    return out


BIG = ("puma", "cougar", "tiger", "leopard")


@query(o.with_(INDIVIDUAL) + f""", sc AS (SELECT * FROM isplit WHERE taxon IN {BIG}), fs AS (SELECT f.*, sc.split, sc.individual_key FROM fixes f JOIN sc USING (dataset, taxon, animal_id))
SELECT 'n_tasks' AS figure, NULL::VARCHAR AS taxon, NULL::VARCHAR AS split, count(*) AS n FROM fs UNION ALL SELECT 'n_individuals', NULL, NULL, count(*) FROM sc UNION ALL SELECT 'tasks_by_split', NULL, split, count(*) FROM fs GROUP BY split
UNION ALL SELECT 'tasks_by_taxon_split', taxon, split, count(*) FROM fs GROUP BY taxon, split UNION ALL SELECT 'individuals_by_taxon_split', taxon, split, count(*) FROM sc GROUP BY taxon, split""")
def split_report(spark, sf):
    rows = event_fixes(spark, sf).withColumn("task_uid", F.concat_ws("|", "animal_id", F.col("time").cast("string")))
    scope, _, table = splits.formal_tables(rows, None, None, BIG, series.KEY)
    return splits.split_report(scope, table)


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT k, unnest(CASE k % 4 WHEN 0 THEN [{'c': 240.0, 'f': 60.0, 's': 'a'}, {'c': 60.0, 'f': 5.0, 's': '60min_to_5min'}] WHEN 1 THEN [] ELSE
 list_transform(list_filter([60, 120, 250], lambda c: c >= 20 * (k % 4) AND c % (20 * (k % 4)) = 0), lambda c: {'c': c::DOUBLE, 'f': (20 * (k % 4))::DOUBLE, 's': c || 'min_to_' || 20 * (k % 4) || 'min'}) END) AS e, FROM k)
SELECT k AS o_orderkey, e.c AS coarse_dt_min, e.f AS fine_dt_min, e.s AS setting_name FROM s""")
def task_settings(spark, sf):
    """Settings from JSON with repeats and values that don't fit, from no JSON with fine minutes, and from neither."""
    k = F.col("o_orderkey")
    given = '[{"coarse_dt_min": 240, "fine_dt_min": 60, "setting_name": "a"}, {"coarse_dt_min": 50, "fine_dt_min": 20}, {"coarse_dt_min": 60, "fine_dt_min": 5}, {"coarse_dt_min": 240, "fine_dt_min": 60, "setting_name": "a"}, {"coarse_dt_min": 60, "fine_dt_min": 0}]'
    text = F.when(k % 4 == 0, given).when(k % 4 == 2, "[]").when(k % 4 == 3, "not json")
    fine = F.when(k % 4 == 1, float("nan")).otherwise((k % 4 * 20).cast("double"))
    rows = load(spark, sf, "orders").select("o_orderkey", F.explode(series.settings_of(text, fine, (60, 120, 250))).alias("s"))
    return rows.select("o_orderkey", "s.*")


HARD = ("31899", "229012", "x1", "12F", "7m", "40")
SETS = ("SantaCruz_puma", "Thailand_tiger_leopard", "Olympic_cougar", "Olympic_bobcat", "Other")


@query(f"""WITH k AS (SELECT c_custkey AS k, {list(HARD)}[c_custkey % 6 + 1] AS id, {list(SETS)}[c_custkey % 5 + 1] AS d FROM customer),
t AS (SELECT *, CASE id WHEN '12F' THEN 'female' WHEN '7m' THEN 'male' END AS suf, CASE id WHEN '40' THEN 'male' WHEN 'x1' THEN 'female' END AS msex, CASE id WHEN '40' THEN 'adult' END AS mage,
 CASE id WHEN '31899' THEN 'female' WHEN '229012' THEN 'male' END AS csex, CASE id WHEN '31899' THEN 'leopard' WHEN '229012' THEN 'tiger' END AS ctax, d = 'Thailand_tiger_leopard' AS th FROM k),
u AS (SELECT *, CASE WHEN d IN ('SantaCruz_puma', 'Olympic_cougar', 'Olympic_bobcat') THEN suf END AS told,
 CASE WHEN th AND ctax IS NOT NULL THEN ctax WHEN th THEN CASE WHEN id = '40' THEN 'leopard' ELSE 'tiger' END WHEN id = '40' THEN 'leopard' WHEN d = 'SantaCruz_puma' THEN 'puma' WHEN d = 'Olympic_cougar' THEN 'cougar' WHEN d = 'Olympic_bobcat' THEN 'bobcat' ELSE 'wolf' END AS taxon FROM t)
SELECT k AS c_custkey, taxon, coalesce(msex, told, CASE WHEN th THEN csex END, 'unknown') AS sex, coalesce(mage, 'unknown') AS age_class,
'default' || CASE WHEN told IS NULL THEN '' WHEN d = 'SantaCruz_puma' THEN ';puma_id_suffix' ELSE ';id_suffix' END || repeat(';table', CASE id WHEN '40' THEN 3 WHEN 'x1' THEN 1 ELSE 0 END) || CASE WHEN th AND ctax IS NOT NULL THEN ';known_thailand_collars' ELSE '' END AS metadata_source,
CASE taxon WHEN 'puma' THEN 'puma_concolor' WHEN 'cougar' THEN 'puma_concolor' WHEN 'bobcat' THEN 'lynx_rufus' WHEN 'tiger' THEN 'panthera_tigris' WHEN 'leopard' THEN 'panthera_pardus' ELSE taxon END || '__' ||
CASE d WHEN 'SantaCruz_puma' THEN 'SantaCruz' WHEN 'Thailand_tiger_leopard' THEN 'Thailand_WEFCOM' WHEN 'Other' THEN 'Other' ELSE 'OlympicPeninsula' END AS transfer_unit FROM u""")
def metadata_cascade(spark, sf):
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    tracks = load(spark, sf, "customer").select("c_custkey", pick(HARD).alias("animal_id"), pick(SETS).alias("dataset"), F.lit("wolf").alias("taxon"))
    meta = spark.createDataFrame([("40.0", "M", "Adult", "Leopard"), ("X1", "fem", None, "?"), ("", "m", "adult", "tiger"), (None, "m", "adult", "tiger")], "collar string, s string, a string, sp string")
    return metadata.cascade(tracks, meta, "collar", "s", "a", "sp").select("c_custkey", "taxon", "sex", "age_class", "metadata_source", "transfer_unit")


# --- rasters -------------------------------------------------------------------------------


@query("SELECT c_custkey, round(96 + (c_custkey % 60) / 10.0, 6) + 0.0 AS lon, round((c_custkey % 700) / 10.0 - 10, 6) + 0.0 AS lat, c_custkey::DOUBLE AS kept FROM customer")
def reproject(spark, sf):
    """Degrees of a zone to UTM and back; a system that stays changes nothing."""
    k = F.col("c_custkey")
    lon, lat = F.lit(96.0) + k % 60 / 10.0, k % 700 / 10.0 - 10
    c = load(spark, sf, "customer")
    x, y = rasters.reproject(lon, lat, 4326, 32647)
    lon2, lat2 = rasters.reproject(x, y, 32647, 4326)
    kept, _ = rasters.reproject(k.cast("double"), k.cast("double"), 32647, 32647)
    return c.select("c_custkey", r6(lon2, "lon"), r6(lat2, "lat"), kept.alias("kept"))


@query(o.with_(o.tasks()) + f""", l AS (SELECT task_uid, {o.LINEAR} AS path FROM tasks), p AS (SELECT task_uid, i, path[i].x AS x, path[i].y AS y FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM l)),
c AS (SELECT task_uid, i, floor((x + 20000) / 1000)::BIGINT AS col, floor((20000 - y) / 1000)::BIGINT AS row FROM p)
SELECT task_uid, list(CASE WHEN col BETWEEN 0 AND 39 AND row BETWEEN 0 AND 39 THEN (row * 40 + col)::DOUBLE END ORDER BY i)::VARCHAR AS slope, list(CASE WHEN col BETWEEN 0 AND 39 AND row BETWEEN 0 AND 39 THEN (col % 7)::DOUBLE END ORDER BY i)::VARCHAR AS cover FROM c GROUP BY task_uid""")
def rasters_along_paths(spark, sf):
    paths = evaluate.baselines(tasks_of(spark, sf)).filter("method = 'linear'")
    cells = spark.range(1600).select(F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"), F.col("id").cast("double").alias("value"))
    layers = {"slope": (cells, -20000.0, 20000.0, 1000.0), "cover": (cells.withColumn("value", (F.col("col") % 7).cast("double")), -20000.0, 20000.0, 1000.0)}
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("NULL"))), ", "), F.lit("]")).alias(c)
    return rasters.along_paths(paths, layers).select("task_uid", text("slope"), text("cover"))
