"""Independent DuckDB SQL: the shared table expressions and the kernels as SQL text."""

from __future__ import annotations

FIXES = """
ev AS (SELECT user_id, ts, event_id, cast(round(value * 100) AS BIGINT) - 4970 AS ix,
              cast(json_extract_string(props, '$.k') AS BIGINT) AS elev FROM events),
walk AS (SELECT user_id, ts, event_id, elev, sum(ix) OVER w AS x, sum(elev * 100 - 4950) OVER w AS y,
                time_bucket(INTERVAL 720 MINUTE, ts) AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
lastfix AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts DESC, event_id DESC) AS k FROM walk),
fixes AS (SELECT ['SantaCruz_puma','Olympic_cougar','Thailand_tiger_leopard','Thailand_tiger_leopard','Olympic_bobcat'][user_id % 5 + 1] AS dataset,
                 ['puma','cougar','tiger','leopard','bobcat'][user_id % 5 + 1] AS taxon, cast(user_id AS VARCHAR) AS animal_id,
                 CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex, cast(b AS TIMESTAMP) AS time, x::DOUBLE AS x, y::DOUBLE AS y, elev::DOUBLE AS elev
          FROM lastfix WHERE k = 1)"""

SETTINGS = ((1440, 720), (2880, 720))


def tasks(settings=SETTINGS) -> str:
    values = ", ".join(f"({c}, {f})" for c, f in settings)
    return f"""{FIXES},
numbered AS (SELECT *, row_number() OVER (PARTITION BY animal_id ORDER BY time) - 1 AS idx, count(*) OVER (PARTITION BY animal_id) AS n_fix FROM fixes),
st AS (SELECT a.*, c, f, c // f AS n FROM numbered a, (VALUES {values}) s(c, f) WHERE idx % (c // f) = 0 AND n_fix >= greatest(5, c // f + 1)),
lattice AS (SELECT st.*, unnest(range(0, n + 1)) AS k FROM st),
pts AS (SELECT l.dataset, l.taxon, l.animal_id, l.sex, l.time AS t0, l.c, l.f, l.n, l.k, p.x AS px, p.y AS py, p.elev AS pe
        FROM lattice l JOIN fixes p ON p.animal_id = l.animal_id AND p.time = l.time + to_minutes(l.k * l.f)),
seg AS (SELECT dataset, taxon, animal_id, sex, t0, c, f, n, list({{'x': px, 'y': py}} ORDER BY k) AS truth, list(pe ORDER BY k) AS truth_env
        FROM pts GROUP BY ALL HAVING count(*) = n + 1),
named AS (SELECT *, c || 'min_to_' || f || 'min' AS setting_name FROM seg),
tasks AS (SELECT replace(a.dataset, ' ', '-') || '_' || a.taxon || '_' || a.animal_id || '_' || setting_name || '_' ||
                 substr(md5(a.dataset || '|' || a.taxon || '|' || a.animal_id || '|' || setting_name || '|' || strftime(t0, '%Y-%m-%d %H:%M:%S')), 1, 12) AS task_uid,
                 a.dataset, a.taxon, a.animal_id, a.sex, setting_name, t0 AS start_time, t0 + to_minutes(c) AS end_time, c::DOUBLE AS coarse_dt_min, f::DOUBLE AS fine_dt_min,
                 (n + 1)::INT AS n_points, truth, truth_env, truth[1] AS s, truth[len(truth)] AS e,
                 CASE WHEN p.x IS NOT NULL THEN {{'x': p.x, 'y': p.y}} END AS prev, CASE WHEN q.x IS NOT NULL THEN {{'x': q.x, 'y': q.y}} END AS nxt
          FROM named a LEFT JOIN fixes p ON p.animal_id = a.animal_id AND p.time = t0 - to_minutes(f)
          LEFT JOIN fixes q ON q.animal_id = a.animal_id AND q.time = t0 + to_minutes(c + f))"""


def dist(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2)"


def hyp(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) ** 2 + ({dy}) ** 2)"


def steps(p: str) -> str:
    return f"list_transform(range(1, len({p})), lambda i: {dist(f'{p}[i]', f'{p}[i + 1]')})"


def length(p: str) -> str:
    return f"list_sum({steps(p)})"


def directness(p: str) -> str:
    return f"(CASE WHEN {length(p)} > 1e-9 THEN {dist(f'{p}[1]', f'{p}[len({p})]')} / {length(p)} END)"


def ade(p: str, q: str) -> str:
    return f"list_avg(list_transform(range(1, len({p}) + 1), lambda i: {dist(f'{p}[i]', f'{q}[i]')}))"


def rmse(p: str, q: str) -> str:
    return f"sqrt(list_avg(list_transform(range(1, len({p}) + 1), lambda i: ({p}[i].x - {q}[i].x) ** 2 + ({p}[i].y - {q}[i].y) ** 2)))"


def spatial_rmse(p: str, q: str) -> str:
    d = f"{q}[j + 1]"
    t = (f"greatest(0.0, least(1.0, (({p}[i].x - {q}[j].x) * ({d}.x - {q}[j].x) + ({p}[i].y - {q}[j].y) * ({d}.y - {q}[j].y)) / "
         f"greatest(({d}.x - {q}[j].x) ** 2 + ({d}.y - {q}[j].y) ** 2, 1e-9)))")  # fmt: skip
    near = f"list_min(list_transform(range(1, len({q})), lambda j: ({p}[i].x - {q}[j].x - {t} * ({d}.x - {q}[j].x)) ** 2 + ({p}[i].y - {q}[j].y - {t} * ({d}.y - {q}[j].y)) ** 2))"
    return f"sqrt(list_avg(list_transform(range(1, len({p}) + 1), lambda i: {near})))"


def fractions(body: str, n: str = "n_points") -> str:
    """A list over t = 0..1 of a struct body in terms of t."""
    return f"list_transform(list_transform(range(0, {n}), lambda k: k / ({n} - 1)), lambda t: {body})"


LINEAR = fractions("{'x': s.x * (1 - t) + e.x * t, 'y': s.y * (1 - t) + e.y * t}")


def _hermite(c: str) -> str:
    base = f"(e.{c} - s.{c})"
    m0 = f"(CASE WHEN prev IS NOT NULL AND {dist('s', 'prev')} > 1e-9 THEN s.{c} - prev.{c} ELSE {base} END)"
    m1 = f"(CASE WHEN nxt IS NOT NULL AND {dist('nxt', 'e')} > 1e-9 THEN nxt.{c} - e.{c} ELSE {base} END)"
    return f"(2*t**3 - 3*t**2 + 1) * s.{c} + (t**3 - 2*t**2 + t) * 0.35 * {m0} + (-2*t**3 + 3*t**2) * e.{c} + (t**3 - t**2) * 0.35 * {m1}"


HERMITE = fractions("{'x': " + _hermite("x") + ", 'y': " + _hermite("y") + "}")
_wave = f"(CASE WHEN {dist('s', 'e')} > 1e-9 AND n_points > 2 THEN sin(pi() * t) * 0.15 ELSE 0 END)"
RTG = fractions("{'x': s.x * (1 - t) + e.x * t - " + _wave + " * (e.y - s.y), 'y': s.y * (1 - t) + e.y * t + " + _wave + " * (e.x - s.x)}")


def frame(p: str) -> str:
    a, b = f"{p}[1]", f"{p}[len({p})]"
    d = dist(a, b)
    ux, uy = f"(CASE WHEN {d} > 1e-9 THEN ({b}.x - {a}.x) / {d} ELSE 1 END)", f"(CASE WHEN {d} > 1e-9 THEN ({b}.y - {a}.y) / {d} ELSE 0 END)"
    return (f"list_transform({p}, lambda p: {{'x': ((p.x - {a}.x) * {ux} + (p.y - {a}.y) * {uy}) / greatest({d}, 1.0), "
            f"'y': ((p.y - {a}.y) * {ux} - (p.x - {a}.x) * {uy}) / greatest({d}, 1.0)}})")  # fmt: skip


PATHS = f"""paths AS (SELECT *, 'linear' AS method, {LINEAR} AS path FROM tasks UNION ALL SELECT *, 'heading_hermite', {HERMITE} FROM tasks
 UNION ALL SELECT *, 'rtg_bridge', {RTG} FROM tasks)"""
METRICS = f"""metrics AS (SELECT * EXCLUDE (path, truth, truth_env, s, e, prev, nxt), {length('path')} AS path_length_m, {length('truth')} AS truth_path_length_m,
 {ade('path', 'truth')} AS ADE, {rmse('path', 'truth')} AS RMSE, {spatial_rmse('path', 'truth')} AS spatial_RMSE, abs({directness('path')} - {directness('truth')}) AS directness_error FROM paths),
metrics2 AS (SELECT *, abs(ln((path_length_m + 1) / (truth_path_length_m + 1))) AS path_length_log_error,
 CASE WHEN truth_path_length_m > 1e-9 THEN path_length_m / truth_path_length_m END AS path_length_ratio,
 CASE WHEN truth_path_length_m > 1e-9 THEN abs(ln(greatest(path_length_m, 1e-9) / truth_path_length_m)) END AS path_length_ratio_error,
 (ADE <= 50)::INT::DOUBLE AS within_50m, (ADE <= 100)::INT::DOUBLE AS within_100m FROM metrics),
lin AS (SELECT task_uid, ADE AS linear_ADE, RMSE AS linear_RMSE FROM metrics2 WHERE method = 'linear'),
paired AS (SELECT m.*, linear_ADE, linear_RMSE, ADE / nullif(linear_ADE, 0) AS ade_ratio_to_linear, RMSE / nullif(linear_RMSE, 0) AS rmse_ratio_to_linear,
 ADE - linear_ADE AS delta_ADE_vs_linear, coalesce((ADE - linear_ADE < 0)::INT::DOUBLE, 0) AS better_than_linear FROM metrics2 m LEFT JOIN lin USING (task_uid))"""


def hash01(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in cols)
