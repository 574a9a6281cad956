"""DuckDB restatements of the motif library, retrieval, candidates, costs and path families, as table expressions."""

from __future__ import annotations

from gapweave.plans import oracle as o


def leg(u: str, v: str, kind: str) -> str:
    """Alignment, lateral part or log length ratio of the leg from u to v against the chord of length d."""
    dx, dy = f"({v}.x - {u}.x)", f"({v}.y - {u}.y)"
    size = f"sqrt({dx} ** 2 + {dy} ** 2)"
    body = {"cos": f"({dx} * (e.x - s.x) + {dy} * (e.y - s.y)) / ({size} * d)", "sin": f"abs({dy} * (e.x - s.x) - {dx} * (e.y - s.y)) / ({size} * d)", "log": f"ln(({size} + 1) / (d + 1))"}[kind]
    return f"CASE WHEN {size} > 1e-9 AND d > 1e-9 THEN {body} ELSE 0.0 END"


def wheel(value: str, period: str) -> str:
    return f"sin(2 * pi() * ({value}) / {period}), cos(2 * pi() * ({value}) / {period})"


HOURS = "hour({0}) + minute({0}) / 60.0 + second({0}) / 3600.0"
FEATURES = ", ".join(
    f"({x})::DOUBLE"
    for x in (
        "n_points / 20.0", "ln(1 + coarse_dt_min)", "ln(1 + fine_dt_min)", "ln(1 + d)", "ln(1 + d / (n_points - 1))", "1.0", leg("prev", "s", "log"), leg("e", "nxt", "log"),
        "(prev IS NOT NULL)::INT", "(nxt IS NOT NULL)::INT", leg("prev", "s", "cos"), leg("e", "nxt", "cos"), leg("prev", "s", "sin"), leg("e", "nxt", "sin"),
        *(x for v, p in (("sh", "24.0"), ("mh", "24.0"), ("mo", "12.0"), ("dy", "365.25")) for x in wheel(v, p).split(", ")),
        "(sex = 'F')::INT", "(sex = 'M')::INT", "0.0", "0.0",
    )
)

TIMED = f"""{o.tasks()},
tt AS MATERIALIZED (SELECT *, CASE WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, {o.hash01('task_uid')} AS h, {o.dist('s', 'e')} AS d FROM tasks)),
mi AS (SELECT *, start_time + to_seconds(date_diff('second', start_time, end_time) // 2) AS mid FROM tt),
cl AS (SELECT *, {HOURS.format('start_time')} AS sh, {HOURS.format('mid')} AS mh, month(start_time) - 1 AS mo, dayofyear(start_time) - 1 AS dy FROM mi),
ft AS MATERIALIZED (SELECT *, [{FEATURES}] AS f, sin(2 * pi() * mh / 24.0) AS hs, cos(2 * pi() * mh / 24.0) AS hc, sin(2 * pi() * mo / 12.0) AS ms_, cos(2 * pi() * mo / 12.0) AS mc,
 CASE WHEN mh >= 5 AND mh < 8 THEN 'dawn' WHEN mh >= 17 AND mh < 20 THEN 'dusk' WHEN mh >= 8 AND mh < 17 THEN 'day' ELSE 'night' END AS diel,
 (truth_env[1] + truth_env[len(truth_env)]) / 2 AS env_mean, truth_env[len(truth_env)] - truth_env[1] AS env_delta FROM cl)"""

CUT = " ORDER BY h, task_uid LIMIT 25000"
LIBRARY = f"""{TIMED},
m0 AS (SELECT *, {o.frame('truth')} AS fr FROM (SELECT * FROM ft WHERE split = 'train'{CUT})),
m1 AS (SELECT *, list_transform(CASE WHEN len(fr) > 2 THEN fr[2:len(fr) - 1] ELSE fr END, lambda p: p.y) AS lat FROM m0),
mt AS MATERIALIZED (SELECT 'motif_' || replace(replace(task_uid, ' ', '-'), '/', '-') || '_' || substr(md5('motif|' || task_uid), 1, 12) AS motif_id, task_uid AS source_task_uid, dataset, taxon, sex, n_points, f, hs, hc, ms_, mc, diel,
 env_mean, env_delta, fr, {o.length('truth')} / greatest(d, 1e-9) AS ratio, {o.directness('truth')} AS direct, list_avg(lat) AS lat_mean, list_avg(list_transform(lat, lambda v: abs(v))) AS lat_abs,
 CASE WHEN abs(list_avg(lat)) >= 1e-4 THEN sign(list_avg(lat))::DOUBLE ELSE 0.0 END AS lat_sign FROM m1)"""


def whole(sql: str) -> str:
    """The same SQL with every training gap in its library."""
    return sql.replace(CUT, "", 1)


def round_wheel(c: str) -> str:
    a, b = {"hour": ("hs", "hc"), "month": ("ms_", "mc")}[c]
    return f"sqrt((t.{a} - m.{a}) ** 2 + (t.{b} - m.{b}) ** 2) / 2"


def env_term(c: str) -> str:
    return f"least(abs(t.{c} - m.{c}) / (SELECT s FROM scale WHERE c = '{c}'), 5.0)"


RETRIEVED = f"""{LIBRARY},
sc AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS sd FROM (SELECT generate_subscripts(f, 1) AS i, unnest(f) AS v FROM mt) GROUP BY i),
sl AS (SELECT list(m ORDER BY i) AS ms, list(sd ORDER BY i) AS ss FROM sc),
mz AS (SELECT motif_id, list_transform(range(1, len(f) + 1), lambda i: (f[i] - ms[i]) / ss[i]) AS z FROM mt, sl),
qz AS (SELECT task_uid, list_transform(range(1, len(f) + 1), lambda i: (f[i] - ms[i]) / ss[i]) AS z FROM ft, sl WHERE split = 'test'),
nn AS (SELECT task_uid, motif_id, dd, row_number() OVER (PARTITION BY task_uid ORDER BY dd, motif_id) AS stage FROM (SELECT q.task_uid, m.motif_id, list_distance(q.z, m.z) AS dd FROM qz q, mz m)),
lay AS (SELECT 'env_mean' AS c, env_mean AS v FROM mt UNION ALL SELECT 'env_delta', env_delta FROM mt), md AS (SELECT c, median(v) AS m FROM lay GROUP BY c),
scale AS (SELECT c, greatest(1.4826 * median(abs(v - m)), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349, 1e-6) AS s FROM lay JOIN md USING (c) GROUP BY c),
cc AS (SELECT t.task_uid, m.motif_id, dd, stage, {round_wheel('hour')} + 0.75 * {round_wheel('month')} + CASE WHEN t.diel = m.diel THEN 0.0 ELSE 0.25 END AS tc, ({env_term('env_mean')} + {env_term('env_delta')}) / 2 AS ec,
 CASE WHEN t.sex <> m.sex THEN 1.0 ELSE 0.0 END AS dc, CASE WHEN t.taxon = m.taxon THEN 0.0 ELSE 0.12 END + CASE WHEN t.dataset = m.dataset THEN 0.0 ELSE 0.05 END AS pen
 FROM nn JOIN ft t USING (task_uid) JOIN mt m USING (motif_id) WHERE stage <= 160),
cs AS (SELECT *, 0.85 * dd + pen + 0.12 * tc + 0.22 * ec + 0.08 * dc AS score FROM cc),
hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task_uid ORDER BY score, stage) AS rk FROM cs QUALIFY rk <= 20)"""

UX, UY = "(CASE WHEN d > 1e-9 THEN (e.x - s.x) / d ELSE 1.0 END)", "(CASE WHEN d > 1e-9 THEN (e.y - s.y) / d ELSE 0.0 END)"
AT = "(k / (n_points - 1) * (len(fr) - 1))"
_pick = lambda c: f"fr[floor({AT})::INT + 1].{c} + ({AT} - floor({AT})) * (fr[least(floor({AT})::INT + 2, len(fr))].{c} - fr[floor({AT})::INT + 1].{c})"
RESAMPLED = f"CASE WHEN len(fr) = n_points THEN fr ELSE list_transform(range(0, n_points), lambda k: {{'x': {_pick('x')}, 'y': {_pick('y')}}}) END"
LAID = (f"list_transform(sh_, lambda p: {{'x': s.x + p.x * greatest(d, 1.0) * {UX} - p.y * sway * greatest(d, 1.0) * {UY}, "
        f"'y': s.y + p.x * greatest(d, 1.0) * {UY} + p.y * sway * greatest(d, 1.0) * {UX}}})")  # fmt: skip

CANDIDATES = f"""{RETRIEVED},
te AS (SELECT task_uid, dataset, taxon, setting_name, n_points, s, e, prev, nxt, d, truth, (prev IS NOT NULL OR nxt IS NOT NULL) AS turn FROM tt WHERE split = 'test'),
vr AS (SELECT * FROM (VALUES (0, false, 0.75::DOUBLE), (1, false, 1.0), (2, false, 1.2), (3, true, 0.75), (4, true, 1.0), (5, true, 1.2)) v(v, mirror, scale)),
rs AS (SELECT te.*, h.motif_id, rk, score, tc, ec, dc, ratio, lat_sign, lat_abs, v, mirror, scale, CASE WHEN mirror THEN -scale ELSE scale END AS sway, fr FROM hits h JOIN te USING (task_uid) JOIN (SELECT motif_id, fr, ratio, lat_sign, lat_abs FROM mt) m ON m.motif_id = h.motif_id, vr WHERE rk <= 8),
rz AS (SELECT * EXCLUDE (fr), {RESAMPLED} AS sh_ FROM rs),
c0 AS (SELECT task_uid, 'direct_identity' AS style, 0 AS place, {o.LINEAR} AS path, 'direct_identity' AS motif_id, 0.12::DOUBLE AS score, 0.0::DOUBLE AS scale, false AS mirror, 1.0::DOUBLE AS src, 0.0::DOUBLE AS src_sign, 0.0::DOUBLE AS src_abs, 0.0::DOUBLE AS tc, 0.0::DOUBLE AS ec, 0.0::DOUBLE AS dc FROM te
 UNION ALL SELECT task_uid, 'heading_continuity', 1, {o.HERMITE}, 'heading_continuity', 0.18, 1.0, false, NULL, 0.0, 0.0, 0.0, 0.0, 0.0 FROM te WHERE turn
 UNION ALL SELECT task_uid, 'retrieved_motif', turn::INT + 1 + (rk - 1) * 6 + v, {LAID}, motif_id, score, scale, mirror, ratio, lat_sign * CASE WHEN mirror THEN -1.0 ELSE 1.0 END, lat_abs, tc, ec, dc FROM rz WHERE turn::INT + 1 + (rk - 1) * 6 + v < 45),
c1 AS (SELECT *, row_number() OVER (PARTITION BY task_uid, style, list_transform(path, lambda p: {{'x': round_even(p.x, 3) + 0.0, 'y': round_even(p.y, 3) + 0.0}}) ORDER BY place) AS k FROM c0),
cand AS MATERIALIZED (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY task_uid ORDER BY place) - 1 AS candidate_order,
 replace(replace(task_uid, ' ', '-'), '/', '-') || '_motif_timegeo_sr_' || place || '_' || motif_id || '_' || substr(md5(task_uid || '|motif_timegeo_sr|' || place || '|' || motif_id || '|' || CASE WHEN mirror THEN 'True' ELSE 'False' END || '|' || scale::DOUBLE || '|' || style), 1, 12) AS candidate_id
 FROM c1 WHERE k = 1)"""

KEYS = ("dataset || '|' || taxon || '|' || setting_name", "dataset || '|' || taxon", "taxon", "'global'")
PRIOR = ", ".join(
    f"""ps{i} AS (SELECT {key} AS key, quantile_cont(x, 0.9) AS q90 FROM (SELECT dataset, taxon, setting_name, unnest({o.steps('truth')}) AS x FROM tt WHERE split = 'train') GROUP BY 1),
pr{i} AS (SELECT {key} AS key, quantile_cont({o.length('truth')} / greatest(d, 1e-9), 0.5) FILTER ({o.length('truth')} > 0) AS r50, quantile_cont({o.directness('truth')}, 0.5) AS d50 FROM tt WHERE split = 'train' GROUP BY 1)"""
    for i, key in enumerate(KEYS)
)
_first = lambda c: "coalesce(" + ", ".join(f"{'ps' if c == 'q90' else 'pr'}{i}.{c}" for i in range(4)) + ")"
TURNS = ("coalesce(list_avg(list_filter(list_transform(range(1, len(legs)), lambda i: CASE WHEN sqrt(legs[i].x ** 2 + legs[i].y ** 2) * sqrt(legs[i + 1].x ** 2 + legs[i + 1].y ** 2) > 1e-9 THEN "
         "acos(greatest(-1.0, least(1.0, (legs[i].x * legs[i + 1].x + legs[i].y * legs[i + 1].y) / (sqrt(legs[i].x ** 2 + legs[i].y ** 2) * sqrt(legs[i + 1].x ** 2 + legs[i + 1].y ** 2))))) END), lambda a: a IS NOT NULL)), 0.0)")  # fmt: skip
SHAPE = f"list_transform(path, lambda p: {{'x': ((p.x - s.x) * {UX} + (p.y - s.y) * {UY}) / greatest(d, 1.0), 'y': ((p.y - s.y) * {UX} - (p.x - s.x) * {UY}) / greatest(d, 1.0)}})"
_side = lambda v, u: f"CASE WHEN {v} IS NOT NULL AND {u} IS NOT NULL THEN sign(({u}.y - {v}.y) * (e.x - s.x) - ({u}.x - {v}.x) * (e.y - s.y)) ELSE 0 END"
WEIGHTS = {
    "motif": "greatest(score, CASE style WHEN 'direct_identity' THEN 0.16 WHEN 'heading_continuity' THEN 0.20 ELSE 0.0 END)",
    "step": "abs(ln((list_avg(st) + 1e-6) / (usual + 1e-6))) + greatest(0.0, q90 / greatest(cap, 1e-6) - 1.0)",
    "turn": TURNS,
    "detour": "abs(lr - ln(greatest(1.0, least(2.5, CASE WHEN borrowed THEN 0.5 + 0.25 * greatest(1.0, least(2.5, pratio)) + 0.25 * greatest(1.0, least(2.5, src)) ELSE 0.7 + 0.3 * greatest(1.0, least(2.0, pratio)) END))))",
    "directness": "coalesce(abs(dir - pdir), 0.0)",
    "lateral": "list_avg(list_transform(shp, lambda p: abs(p.y))) + 0.5 * list_max(list_transform(shp, lambda p: abs(p.y)))",
    "timegeo": "list_avg(list_transform(st, lambda v: (greatest(v - cap, 0.0) / cap) ** 2))",
    "progress": "coalesce(list_avg(list_transform(range(1, len(shp)), lambda i: (shp[i + 1].x - shp[i].x < -1e-6)::INT)), 0.0)",
    "origin": "CASE style WHEN 'direct_identity' THEN 0.35 WHEN 'heading_continuity' THEN 0.25 ELSE 0.0 END",
    "context": "0.40 * tc + 0.45 * ec + 0.25 * dc",
    "direction": "(list_avg(list_transform(shp, lambda p: abs(p.y))) >= 0.03 AND wanted <> 0 AND lsign <> 0 AND lsign <> wanted)::INT::DOUBLE",
    "efficiency": "abs(lr)",
    "source_shape": "CASE WHEN borrowed THEN abs(lr - ln(greatest(least(src, 2.5), 1e-9))) ELSE 0.0 END",
}
TOTAL = {"motif": 1.0, "step": 0.95, "turn": 0.35, "detour": 0.45, "directness": 0.2, "lateral": 0.25, "timegeo": 1.1, "progress": 0.35, "origin": 0.45, "context": 0.6, "direction": 0.25, "efficiency": 0.35, "source_shape": 0.25}

SCORED = f"""{CANDIDATES}, {PRIOR},
pri AS (SELECT te.task_uid, {_first('q90')} AS pq90, {_first('r50')} AS pr50, {_first('d50')} AS pd50 FROM te {' '.join(f"LEFT JOIN {t}{i} ON {t}{i}.key = " + ("'global'" if i == 3 else KEYS[i].replace('dataset', 'te.dataset').replace('taxon', 'te.taxon').replace('setting_name', 'te.setting_name')) for t in ('ps', 'pr') for i in range(4))}),
k0 AS (SELECT c.*, te.s, te.e, te.prev, te.nxt, te.d, greatest(pq90 * 1.10, 1.0) AS cap, greatest(1.0, least(6.0, pr50)) AS pratio, greatest(0.02, least(1.0, pd50)) AS pdir FROM cand c JOIN te USING (task_uid) JOIN pri USING (task_uid)),
k1 AS (SELECT *, {o.steps('path')} AS st, {SHAPE} AS shp, list_transform(range(1, len(path)), lambda i: {{'x': path[i + 1].x - path[i].x, 'y': path[i + 1].y - path[i].y}}) AS legs FROM k0),
k2 AS (SELECT *, list_sum(st) AS len_m, list_aggregate(st, 'quantile_cont', 0.9) AS q90, list_avg(list_transform(CASE WHEN len(shp) > 2 THEN shp[2:len(shp) - 1] ELSE shp END, lambda p: p.y)) AS moff,
 CASE WHEN d > 1e-9 THEN sign({_side('prev', 's')} + {_side('e', 'nxt')}) ELSE 0 END AS bend, style = 'retrieved_motif' AND src > 0 AS borrowed FROM k1),
k3 AS (SELECT *, len_m / greatest(d, 1e-9) AS path_ratio, ln(greatest(len_m / greatest(d, 1e-9), 1e-9)) AS lr, CASE WHEN len_m > 1e-9 THEN {o.dist('path[1]', 'path[len(path)]')} / len_m END AS dir,
 greatest(1.0, least(greatest(d / greatest(len(path) - 1, 1), 1.0), greatest(cap, 1.0))) AS usual, CASE WHEN abs(moff) >= 1e-4 THEN sign(moff) ELSE 0 END AS lsign, CASE WHEN bend <> 0 THEN bend WHEN src_abs >= 0.02 THEN src_sign ELSE 0 END AS wanted FROM k2),
k4 AS (SELECT *, {', '.join(f'{sql} AS cost_{k}' for k, sql in WEIGHTS.items())}, list_avg(list_transform(st, lambda v: (v > cap)::INT)) AS violation FROM k3),
k5 AS (SELECT *, round({' + '.join(f'{w} * coalesce(cost_{k}, 0.0)' for k, w in TOTAL.items())}, 9) AS total_cost FROM k4),
scored AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task_uid ORDER BY total_cost, candidate_order) AS rank, exp(min(total_cost) OVER w - total_cost) / sum(exp(tmin - total_cost)) OVER w AS listwise_probability
 FROM (SELECT *, min(total_cost) OVER (PARTITION BY task_uid) AS tmin FROM k5) WINDOW w AS (PARTITION BY task_uid))"""

REPRESENTED = f"""{SCORED},
sm AS (SELECT * FROM (SELECT *, count(*) FILTER (style = 'retrieved_motif') OVER (PARTITION BY task_uid) AS nm FROM scored) WHERE style = 'retrieved_motif' OR nm < 3),
sx AS (SELECT task_uid, candidate_order, path, unnest([{{'score': 'cost_rank', 'v': -total_cost}}, {{'score': 'probability', 'v': listwise_probability}}], recursive := true) FROM sm),
sy AS (SELECT *, row_number() OVER (PARTITION BY task_uid, score ORDER BY v DESC, candidate_order) AS place FROM sx QUALIFY place <= 20),
sz AS (SELECT *, exp(beta * (v - max(v) OVER (PARTITION BY task_uid, score))) AS w FROM sy, (SELECT unnest([0.25, 0.35, 0.5, 0.75])::DOUBLE AS beta)),
sp AS (SELECT task_uid, score, beta, w, sum(w) OVER (PARTITION BY task_uid, score, beta) AS tw, generate_subscripts(path, 1) AS i, unnest(path) AS p FROM sz),
wm AS (SELECT task_uid, score, beta, i, sum(w / tw * p.x) AS x, sum(w / tw * p.y) AS y FROM sp GROUP BY ALL),
rep AS (SELECT task_uid, score, beta, list({{'x': x, 'y': y}} ORDER BY i) AS path FROM wm GROUP BY ALL)"""

MIXED = f"""{REPRESENTED},
an AS (SELECT task_uid, arg_min(path, rank) FILTER (style = 'retrieved_motif') AS t, arg_min(path, rank) FILTER (style = 'direct_identity') AS dr FROM scored GROUP BY task_uid),
ax AS (SELECT task_uid, unnest([{{'anchor': 'top1', 'ap': coalesce(t, dr)}}, {{'anchor': 'direct', 'ap': coalesce(dr, t)}}], max_depth := 2) FROM an),
mx AS (SELECT task_uid, 'pretrained_motif_blend_' || anchor || '_weighted_' || score || '_K20_b' || beta::DOUBLE || '_lam' || lam::DOUBLE AS method,
 list_transform(range(1, len(path) + 1), lambda i: {{'x': (1 - lam) * ap[i].x + lam * path[i].x, 'y': (1 - lam) * ap[i].y + lam * path[i].y}}) AS path FROM rep JOIN ax USING (task_uid), (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS lam))"""

DIVERSE = SCORED + f""",
d0 AS (SELECT *, -total_cost - 0.08 * cost_source_shape - 0.06 * cost_direction - 0.05 * cost_efficiency - 0.04 * cost_context - 0.20 * violation - 0.05 * q90 / greatest(cap, 1e-6) - 0.03 * abs(ln(greatest(1e-6, least(1e6, path_ratio)))) + 0.10 * listwise_probability AS sr,
 count(*) FILTER (style = 'retrieved_motif') OVER (PARTITION BY task_uid) AS nm FROM scored),
d1 AS MATERIALIZED (SELECT task_uid, candidate_id, path, row_number() OVER (PARTITION BY task_uid ORDER BY round(-sr, 9), candidate_order) AS i, 1.15 * greatest(5.0, least(75.0, 0.08 * {o.dist('path[1]', 'path[len(path)]')})) AS apart FROM d0 WHERE style = 'retrieved_motif' OR nm = 0),
walk_ AS (SELECT task_uid, 0::BIGINT AS i, [path] AS taken, []::VARCHAR[] AS names FROM d1 WHERE i = 1
 UNION ALL SELECT task_uid, i, CASE WHEN fit THEN list_append(taken, path) ELSE taken END, CASE WHEN fit THEN list_append(names, candidate_id) ELSE names END
 FROM (SELECT w.task_uid, w.taken, w.names, c.i, c.path, c.candidate_id, len(w.names) < 10 AND coalesce(list_min(list_transform(w.taken[2:], lambda a: {o.ade('c.path', 'a')})) >= c.apart, true) AS fit
       FROM walk_ w JOIN d1 c ON c.task_uid = w.task_uid AND c.i = w.i + 1)),
dn AS (SELECT task_uid, names FROM walk_ QUALIFY row_number() OVER (PARTITION BY task_uid ORDER BY i DESC) = 1),
dr AS (SELECT d1.*, row_number() OVER (PARTITION BY task_uid ORDER BY list_contains(names, candidate_id) DESC, d1.i) AS source_rank FROM d1 JOIN dn USING (task_uid) QUALIFY source_rank <= 10)"""
