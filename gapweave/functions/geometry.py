"""Path kernels as Column expressions over ARRAY<STRUCT<x, y>>, all JVM-side.

A path argument should be a plain column: expressions name it several times.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def steps(path: Column) -> Column:
    """Lengths of a path's steps."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), distance)


def path_length(path: Column) -> Column:
    return total(steps(path))


def chord(path: Column) -> Column:
    return distance(F.element_at(path, 1), F.element_at(path, -1))


def directness(path: Column) -> Column:
    """Chord over length; null for a path without length."""
    return F.when(path_length(path) > EPS, chord(path) / path_length(path))


def path_ratio(path: Column) -> Column:
    return path_length(path) / F.greatest(chord(path), F.lit(EPS))


def quantile(a: Column, q: float) -> Column:
    """Quantile of an array by linear interpolation."""
    s = F.array_sort(a)
    at = (F.size(a) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return F.element_at(s, low + 1) + (at - low) * (F.element_at(s, F.least(low + 2, F.size(a))) - F.element_at(s, low + 1))


def pointwise(a: Column, b: Column) -> Column:
    """Distances of points of equal index, over the shorter path."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), distance)


def ade(a: Column, b: Column) -> Column:
    return mean(pointwise(a, b))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mean(F.transform(pointwise(a, b), lambda d: d * d)))


def to_segment(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = b.x - a.x, b.y - a.y
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p.x - a.x) * dx + (p.y - a.y) * dy) / F.greatest(dx * dx + dy * dy, F.lit(EPS))))
    return F.sqrt((p.x - a.x - t * dx) * (p.x - a.x - t * dx) + (p.y - a.y - t * dy) * (p.y - a.y - t * dy))


def spatial_rmse(a: Column, b: Column) -> Column:
    """Root mean square of the distances of a's points from b's segments."""
    n = F.size(b) - 1
    near = F.transform(a, lambda p: F.array_min(F.zip_with(F.slice(b, F.lit(1), n), F.slice(b, F.lit(2), n), lambda u, v: to_segment(p, u, v))))
    return F.sqrt(mean(F.transform(near, lambda d: d * d)))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Fréchet distance, row by row of the coupling table."""

    def row(last: Column, p: Column) -> Column:
        cell = lambda acc, i: F.greatest(
            distance(p, F.element_at(b, i)),
            F.when(F.size(last) == 0, F.when(i == 1, F.lit(0.0)).otherwise(F.element_at(acc, -1)))
            .when(i == 1, F.element_at(last, 1))
            .otherwise(F.least(F.get(last, i - 1), F.get(last, i - 2), F.element_at(acc, -1))),
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array().cast("array<double>"), lambda acc, i: F.concat(acc, F.array(cell(acc, i))))

    return F.element_at(F.aggregate(a, F.array().cast("array<double>"), row), -1)


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping: the cheapest coupling's cost over its steps; of equal ways back, up, then left, then diagonal."""
    kind = "array<struct<c:double,k:double>>"

    def row(last: Column, p: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            far = F.struct(F.lit(float("inf")).alias("c"), F.lit(0.0).alias("k"))
            start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("k"))
            up = F.when(F.size(last) == 0, far).otherwise(F.get(last, i - 1))
            left = F.when(i == 1, far).otherwise(F.element_at(acc, -1))
            diagonal = F.when((F.size(last) == 0) & (i == 1), start).when((F.size(last) == 0) | (i == 1), far).otherwise(F.get(last, i - 2))
            best = F.when((up.c <= left.c) & (up.c <= diagonal.c), up).when(left.c <= diagonal.c, left).otherwise(diagonal)
            return F.struct((best.c + distance(p, F.element_at(b, i))).alias("c"), (best.k + 1.0).alias("k"))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array().cast(kind), lambda acc, i: F.concat(acc, F.array(cell(acc, i))))

    end = F.element_at(F.aggregate(a, F.array().cast(kind), row), -1)
    return F.transform(F.array(end), lambda e: e.c / F.greatest(e.k, F.lit(1.0)))[0]


def at_fractions(n: Column, f) -> Column:
    """f(t) at n equally spaced t from 0 to 1."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: f(F.coalesce(F.try_divide(k, n - 1), F.lit(0.0))))


def linear_path(a: Column, b: Column, n: Column) -> Column:
    return at_fractions(n, lambda t: point(a.x * (1 - t) + b.x * t, a.y * (1 - t) + b.y * t))


def hermite_path(a: Column, b: Column, n: Column, before: Column, after: Column, tension: float = 0.35) -> Column:
    """Cubic Hermite path with tangents from the fixes before and after, from the chord where there is none."""
    base = point(b.x - a.x, b.y - a.y)
    m0 = F.when(before.isNotNull() & (distance(a, before) > EPS), point(a.x - before.x, a.y - before.y)).otherwise(base)
    m1 = F.when(after.isNotNull() & (distance(after, b) > EPS), point(after.x - b.x, after.y - b.y)).otherwise(base)

    def at(t: Column) -> Column:
        t2, t3 = t * t, t * t * t
        mix = lambda c: (
            (2 * t3 - 3 * t2 + 1) * a[c] + (t3 - 2 * t2 + t) * tension * m0[c] + (3 * t2 - 2 * t3) * b[c] + (t3 - t2) * tension * m1[c]
        )
        return point(mix("x"), mix("y"))

    return at_fractions(n, at)


def flow_path(a: Column, b: Column, n: Column, before: Column, after: Column) -> Column:
    """Cubic Hermite path whose tangents have the headings before and after, and the chord's length; the chord where a heading is unknown."""
    d, base = distance(a, b), point(b.x - a.x, b.y - a.y)

    def tangent(known: Column, p: Column, q: Column) -> Column:
        leg = distance(p, q)
        return F.when(known.isNotNull() & (leg > 0), point((q.x - p.x) / leg * d, (q.y - p.y) / leg * d)).otherwise(base)

    # unit tangents at the ends' distances stand for fixes before and after: the tension is the tangents' share
    m0, m1 = tangent(before, before, a), tangent(after, b, after)
    bent = hermite_path(a, b, n, point(a.x - m0.x, a.y - m0.y), point(b.x + m1.x, b.y + m1.y), tension=0.55)
    return F.when(d > 0, bent).otherwise(linear_path(a, b, n))


def with_residual(base: Column, path: Column, chord_: Column, weight: Column) -> Column:
    """A path with a share of what another adds to the chord; its ends stay the chord's."""
    n = F.size(base)
    moved = F.zip_with(base, F.zip_with(resample(path, n), chord_, lambda p, c: point(p.x - c.x, p.y - c.y)), lambda p, r: point(p.x + weight * r.x, p.y + weight * r.y))
    return F.transform(moved, lambda p, i: F.when(i == 0, F.element_at(chord_, 1)).when(i == n - 1, F.element_at(chord_, -1)).otherwise(p))


def rtg_path(a: Column, b: Column, n: Column, lateral: float = 0.15) -> Column:
    """The chord with a half sine wave to its left."""
    d = distance(a, b)

    def at(t: Column) -> Column:
        wave = F.when((d > EPS) & (n > 2), F.sin(F.lit(3.141592653589793) * t) * lateral).otherwise(F.lit(0.0))
        return point(a.x * (1 - t) + b.x * t - wave * (b.y - a.y), a.y * (1 - t) + b.y * t + wave * (b.x - a.x))

    return at_fractions(n, at)


def frame(path: Column) -> Column:
    """A path in its endpoints' frame: progress and lateral offset over the chord, a chord of at least 1."""
    return in_frame(path, F.element_at(path, 1), F.element_at(path, -1))


def axis(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The unit vector from a to b, along x if they are one, and the scale of the frame."""
    d = distance(a, b)
    return F.when(d > EPS, (b.x - a.x) / d).otherwise(1.0), F.when(d > EPS, (b.y - a.y) / d).otherwise(0.0), F.greatest(d, F.lit(1.0))


def in_frame(path: Column, a: Column, b: Column) -> Column:
    ux, uy, scale = axis(a, b)
    return F.transform(path, lambda p: point(((p.x - a.x) * ux + (p.y - a.y) * uy) / scale, ((p.y - a.y) * ux - (p.x - a.x) * uy) / scale))


def out_of_frame(shape: Column, a: Column, b: Column, lateral: Column) -> Column:
    """A normalized shape laid between two points, its lateral offsets times `lateral`."""
    ux, uy, scale = axis(a, b)
    return F.transform(shape, lambda p: point(a.x + p.x * scale * ux - p.y * lateral * scale * uy, a.y + p.x * scale * uy + p.y * lateral * scale * ux))


def resample(path: Column, n: Column) -> Column:
    """A path at n points, by linear interpolation over the index."""

    def at(t: Column) -> Column:
        s = t * (F.size(path) - 1)
        low = F.least(F.floor(s).cast("int"), F.size(path) - 1)
        p, q, f = F.element_at(path, low + 1), F.element_at(path, F.least(low + 2, F.size(path))), s - low
        return point(p.x + f * (q.x - p.x), p.y + f * (q.y - p.y))

    return F.when(F.size(path) == n, path).otherwise(at_fractions(n, at))


def lateral_stats(shape: Column) -> dict[str, Column]:
    """Lateral and progress figures of a path in the frame of its gap (see in_frame)."""
    inner = F.when(F.size(shape) > 2, F.slice(shape, F.lit(2), F.size(shape) - 2)).otherwise(shape)
    offset = mean(F.transform(inner, lambda p: p.y))
    n = F.size(shape) - 1
    back = F.zip_with(F.slice(shape, F.lit(1), n), F.slice(shape, F.lit(2), n), lambda p, q: (q.x - p.x < -1e-6).cast("double"))
    return {
        "max_abs_lateral": F.array_max(F.transform(shape, lambda p: F.abs(p.y))),
        "mean_abs_lateral": mean(F.transform(shape, lambda p: F.abs(p.y))),
        "mean_lateral": offset,
        "lateral_sign": F.when(F.abs(offset) >= 1e-4, F.signum(offset)).otherwise(0.0),
        "backtrack": F.coalesce(mean(back), F.lit(0.0)),
    }


def turns(path: Column) -> Column:
    """Mean absolute turning angle; 0 without two steps of some length."""
    n = F.greatest(F.size(path) - 2, F.lit(0))
    legs = F.zip_with(F.slice(path, F.lit(1), n + 1), F.slice(path, F.lit(2), n + 1), lambda a, b: point(b.x - a.x, b.y - a.y))
    size = lambda v: F.sqrt(v.x * v.x + v.y * v.y)
    angle = lambda u, v: F.when(
        size(u) * size(v) > EPS, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (u.x * v.x + u.y * v.y) / (size(u) * size(v)))))
    )
    pairs = F.filter(F.zip_with(F.slice(legs, F.lit(1), n), F.slice(legs, F.lit(2), n), angle), lambda a: a.isNotNull())
    return F.coalesce(mean(pairs), F.lit(0.0))


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    """(1 - weight) a + weight b, point by point."""
    return F.zip_with(a, b, lambda p, q: point((1 - weight) * p.x + weight * q.x, (1 - weight) * p.y + weight * q.y))


def phase_warp(path: Column, gamma: float) -> Column:
    """A path run through at warped time t^gamma."""

    def at(t: Column) -> Column:
        s = F.pow(t, F.lit(gamma)) * (F.size(path) - 1)
        low = F.least(F.floor(s).cast("int"), F.size(path) - 1)
        p, q, f = F.element_at(path, low + 1), F.element_at(path, F.least(low + 2, F.size(path))), s - low
        return point(p.x + f * (q.x - p.x), p.y + f * (q.y - p.y))

    return at_fractions(F.size(path), at)
