"""The functions of paths and ids that SQL text needs, as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

PATH = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_leg = "sqrt(pow(element_at({a}, i + 1).x - element_at({b}, i{next}).x, 2) + pow(element_at({a}, i + 1).y - element_at({b}, i{next}).y, 2))"
_steps = f"transform(sequence(1, greatest(size(path) - 1, 1)), i -> coalesce({_leg.format(a='path', b='path', next='')}, 0D))"
_apart = f"transform(sequence(0, size(path) - 1), i -> {_leg.format(a='path', b='truth', next=' + 1')})"
_sum = "aggregate({0}, 0D, (s, v) -> s + v)"
_chord = "sqrt(pow(element_at(path, -1).x - element_at(path, 1).x, 2) + pow(element_at(path, -1).y - element_at(path, 1).y, 2))"
_length = f"CASE WHEN size(path) > 1 THEN {_sum.format(_steps)} ELSE 0D END"
_id = "regexp_replace(trim(coalesce(value, '')), '[.]0$', '')"

#: name -> parameters, result, body. Paths of one comparison have equal lengths; a null path gives null.
FUNCTIONS = {
    "path_length_m": (f"path {PATH}", "DOUBLE", f"CASE WHEN path IS NULL THEN NULL ELSE {_length} END"),
    "path_directness": (f"path {PATH}", "DOUBLE", f"CASE WHEN {_length} > 1e-9D THEN {_chord} / {_length} END"),
    "path_ade": (f"path {PATH}, truth {PATH}", "DOUBLE", f"CASE WHEN size(path) > 0 THEN {_sum.format(_apart)} / size(path) END"),
    "path_rmse": (f"path {PATH}, truth {PATH}", "DOUBLE", f"CASE WHEN size(path) > 0 THEN sqrt({_sum.format(f'transform({_apart}, v -> v * v)')} / size(path)) END"),
    "path_blend": (f"path {PATH}, other {PATH}, weight DOUBLE", PATH, "zip_with(path, other, (p, q) -> named_struct('x', (1 - weight) * p.x + weight * q.x, 'y', (1 - weight) * p.y + weight * q.y))"),
    "normalize_id": ("value STRING", "STRING", _id),
    "animal_key": ("value STRING", "STRING", f"replace(upper({_id}), ' ', '')"),
    "stable_hash01": ("value STRING", "DOUBLE", "CAST(conv(substring(md5(value), 1, 12), 16, 10) AS DOUBLE) / 281474976710656D"),
}


def register(spark: SparkSession, prefix: str = "gw_") -> list[str]:
    """Makes the functions temporary SQL functions of the session, and returns their names. Catalyst inlines them: no Python is called."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
