"""Rasters as tables: which layers there are, coordinates between systems, values along paths."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.sources.tables import project_utm, sample_raster, store

#: What rasters' file names end with.
ENDINGS = (".tif", ".tiff", ".img", ".vrt", ".asc", ".parquet")


def discover(spark: SparkSession, folder: str | None, named: Mapping[str, str] | None = None, recursive: bool = True) -> dict[str, str]:
    """Layers by name: the named ones, then those found under the folder by their file's name, no file twice.

    Found layers come in order of their path; of two of one name the first keeps it, and
    a name that is given stays as given. A folder that is not there has no layers.
    Rasters as Parquet tables are folders, and count as one file.
    """
    whole = lambda path: str(store(spark, path)[0].makeQualified(store(spark, path)[1]))
    layers = dict(named or {})
    seen = {whole(p) for p in layers.values()}
    for path in sorted(files(spark, folder, recursive)) if folder else []:
        name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if path not in seen and name not in layers:
            layers[name] = path
        seen.add(path)
    return layers


def files(spark: SparkSession, folder: str, recursive: bool) -> list[str]:
    fs, at = store(spark, folder)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    out: list[str] = []
    for status in fs.listStatus(at):
        path = status.getPath().toString()
        if path.lower().endswith(ENDINGS):
            out.append(path)
        elif status.isDirectory() and recursive:
            out += files(spark, path, recursive)
    return out


def utm_to_lonlat(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """WGS84 degrees of an easting and northing in UTM zone 326zz or 327zz, by the series for the footpoint latitude."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    m = (y - (10000000.0 if epsg // 100 == 327 else 0.0)) / k0
    mu = m / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s, c1, t = 1 - e2 * F.sin(foot) ** 2, ep2 * F.cos(foot) ** 2, F.tan(foot) ** 2
    n, r = a / F.sqrt(s), a * (1 - e2) / (s * F.sqrt(s))
    d = (x - 500000.0) / (n * k0)
    lat = foot - (n * F.tan(foot) / r) * (
        d**2 / 2 - (5 + 3 * t + 10 * c1 - 4 * c1**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c1 + 45 * t**2 - 252 * ep2 - 3 * c1**2) * d**6 / 720
    )
    lon = (d - (1 + 2 * t + c1) * d**3 / 6 + (5 - 2 * c1 + 28 * t - 3 * c1**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / F.cos(foot)
    return F.degrees(lon) + (epsg % 100 * 6 - 183), F.degrees(lat)


def reproject(x: Column, y: Column, source: int | None, target: int | None) -> tuple[Column, Column]:
    """Coordinates from one system to another: UTM on WGS84 (326zz, 327zz) and degrees (4326). The same or an unknown system changes nothing."""
    if source is None or target is None or source == target:
        return x, y
    for epsg in (source, target):
        if epsg != 4326 and epsg // 100 not in (326, 327):
            raise ValueError(f"EPSG:{epsg} is neither 4326 nor a UTM zone on WGS84")
    lon, lat = (x, y) if source == 4326 else utm_to_lonlat(x, y, source)
    return (lon, lat) if target == 4326 else project_utm(lon, lat, target)


def along_paths(paths: DataFrame, rasters: Mapping[str, tuple[DataFrame, float, float, float]], key: str = "task_uid", source: int | None = None, target: int | None = None) -> DataFrame:
    """Each path's values of each layer as arrays in the path's order; null outside a raster and for nodata.

    rasters: name to (cells, x0, y0, res), as `sample_raster` takes them. Rows key and one
    array for each layer; a null or empty path has no row.
    """
    points = paths.select(key, F.posexplode("path").alias("_i", "_p")).select(key, "_i", "_p.x", "_p.y")
    x, y = reproject(F.col("x"), F.col("y"), source, target)
    points = points.select(key, "_i", x.alias("x"), y.alias("y"))
    sampled = reduce(lambda p, item: sample_raster(p, *item[1], item[0]), rasters.items(), points)
    entry = F.array_sort(F.collect_list(F.struct("_i", *rasters)))
    lists = sampled.groupBy(key).agg(entry.alias("_a"))
    return lists.select(key, *[F.col("_a").getField(name).alias(name) for name in rasters])
