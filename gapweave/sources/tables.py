"""Readers and writers: CSV tracks, Parquet, CSV and JSON tables, metadata, rasters as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.functions.ids import normalize_id


@dataclass(frozen=True)
class TrackSpec:
    """Where a data set's tracks are and what its columns are called."""

    dataset: str
    taxon: str
    paths: tuple[str, ...]
    id_col: str
    time_col: str
    x_col: str
    y_col: str
    epsg: int | None = None
    lonlat: bool = False
    env_cols: tuple[str, ...] = ()
    settings: tuple[tuple[int, int], ...] = ()
    options: dict = field(default_factory=dict)


def read_tracks(spark: SparkSession, spec: TrackSpec) -> DataFrame:
    """All CSV files of a data set in the standard form, with the file each row is from."""
    raw = spark.read.options(header=True, **spec.options).csv(list(spec.paths)).withColumn("_source_file", F.col("_metadata.file_name"))
    return standardize(raw, spec)


def standardize(raw: DataFrame, spec: TrackSpec) -> DataFrame:
    """Rows dataset, taxon, animal_id, time, x, y, env; those without id, time or place are dropped.

    A missing column is an error. Times with and without a zone become UTC without zone.
    """
    missing = [c for c in (spec.id_col, spec.time_col, spec.x_col, spec.y_col) if c not in raw.columns]
    if missing:
        raise KeyError(f"{spec.dataset}: no column {', '.join(missing)}")
    number = lambda c: F.nullif(F.col(f"`{c}`").try_cast("double"), F.lit(float("nan")))
    x, y = number(spec.x_col), number(spec.y_col)
    if spec.lonlat:
        x, y = project_utm(x, y, spec.epsg or 32600)
    time = utc_time(F.col(f"`{spec.time_col}`"), raw.schema[spec.time_col].dataType.typeName())
    env = F.map_from_arrays(F.array(*[F.lit(c) for c in spec.env_cols]), F.array(*[number(c) for c in spec.env_cols])) if spec.env_cols else F.create_map().cast("map<string,double>")
    out = raw.select(
        F.lit(spec.dataset).alias("dataset"), F.lit(spec.taxon).alias("taxon"), normalize_id(F.col(f"`{spec.id_col}`")).alias("animal_id"),
        time.alias("time"), x.alias("x"), y.alias("y"), env.alias("env"), *([F.col("_source_file")] if "_source_file" in raw.columns else []),
    )
    return out.filter(F.col("animal_id") != "").na.drop(subset=["time", "x", "y"])


def utc_time(c: Column, kind: str = "string") -> Column:
    """A time as UTC without zone, whatever the session's zone; null if it can't be read.

    Strings with a zone and instants are converted, strings without one are kept. kind: the column's type.
    """
    if kind == "timestamp_ntz":
        return c
    text = F.trim(c.cast("string"))
    instant = c if kind == "timestamp" else text.try_cast("timestamp")
    seconds = (F.unix_micros(instant).cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    if kind == "timestamp":
        return utc
    zoned = text.rlike(r"(?i)[0-9] ?(?:z|utc|gmt|[+-][0-9]{1,2}(?::?[0-9]{2})?|[a-z]+/[a-z_/]+)$") & text.contains(":")
    return F.when(zoned, utc).otherwise(text.try_cast("timestamp_ntz"))


def read_all(spark: SparkSession, specs: Sequence[TrackSpec], taxa: Sequence[str] | None = None) -> DataFrame:
    """Several data sets as one; specs of other taxa are left out before anything is read."""
    chosen = [s for s in specs if taxa is None or s.taxon.lower() in {t.lower() for t in taxa}]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_tracks(spark, s) for s in chosen])


def project_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees in UTM zone 326zz or 327zz, by the series to the sixth order."""
    zone, south = epsg % 100, epsg // 100 == 327
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, A = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (A + (1 - t + c) * A**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * A**5 / 120) + 500000.0
    north = k0 * (m + n * F.tan(phi) * (A**2 / 2 + (5 - t + 9 * c + 4 * c**2) * A**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * A**6 / 720))
    return east, north + (10000000.0 if south else 0.0)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """An individual table: CSV by Spark, a workbook through the driver (it is small)."""
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    return spark.read.option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV table; where the named file is missing, its twin of the other kind."""
    twin = re.sub(r"(?:\.[A-Za-z0-9]+)?$", ".csv" if path.endswith(".parquet") else ".parquet", path, count=1)
    fs, at = store(spark, path)
    found = path if fs.exists(at) else twin
    return spark.read.parquet(found) if found.endswith(".parquet") else spark.read.options(header=True, inferSchema=True).csv(found)


def write_table(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    writer.parquet(path) if path.endswith(".parquet") else writer.option("header", True).csv(path)


def store(spark: SparkSession, path: str) -> tuple:
    """The file system that a path lies in, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def write_json(value: object, path: str) -> None:
    fs, at = store(SparkSession.active(), path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str), "utf-8"))
    out.close()


def read_json(path: str) -> object:
    return json.loads(SparkSession.active().read.text(path, wholetext=True).first()[0])


def spec_json(spec: TrackSpec) -> str:
    return json.dumps(asdict(spec), sort_keys=True)


def spec_of(text: str) -> TrackSpec:
    """A spec from its JSON."""
    d = json.loads(text)
    tuples = {c: tuple(tuple(x) if isinstance(x, list) else x for x in d[c]) for c in ("paths", "env_cols", "settings")}
    return TrackSpec(**d | tuples)


def sample_raster(points: DataFrame, cells: DataFrame, x0: float, y0: float, res: float, layer: str) -> DataFrame:
    """Points with the value of the raster cell that each lies in; null outside and for nodata. cells: row, col, value."""
    at = points.withColumn("_col", F.floor((F.col("x") - x0) / res)).withColumn("_row", F.floor((F.lit(y0) - F.col("y")) / res))
    grid = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.nullif(F.col("value"), F.lit(float("nan"))).alias(layer))
    return at.join(grid, ["_row", "_col"], "left").drop("_row", "_col")


def layers_to_sample(df: DataFrame, layers: Sequence[str], least: float = 0.5) -> list[str]:
    """Layers that are absent or known for less than half of the rows."""
    have = [c for c in layers if c in df.columns]
    if not have:
        return list(layers)
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in have]).collect()[0]
    return [c for c in layers if c not in have or (row[c] or 0.0) < least]
