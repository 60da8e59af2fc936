"""Sources: point tiles, vector features, weather files, run archives."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers of missing values by column of a weather file.  Fixed values.
MISSING = {"ta": 99.9, "rh": 999.0, "pressure_pa": 999999.0, "ghi": 9999.0, "dni": 9999.0, "dhi": 9999.0, "ws": 999.0, "wd": 999.0}
FIELDS = {"ta": 6, "rh": 8, "pressure_pa": 9, "ghi": 13, "dni": 14, "dhi": 15, "wd": 20, "ws": 21}
HEIGHT_KEYS = ["height_roof", "heightroof", "HEIGHTROOF", "HEIGHT_ROOF"]
YEAR_KEYS = ["construction_year", "cnstrct_yr", "CNSTRCT_YR", "CONSTRUCTION_YEAR"]


def list_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Point tiles of a folder by name, those with .laz before .las."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.la[sz]").load(path).select("path", "length", "modificationTime")
    return found.orderBy(F.col("path").endswith(".las"), "path")


def probe_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of every tile, without its points: counts, box, whether a projection is named.

    Only the public header is parsed; a file that is no point tile gives nulls.
    """

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["head"], strict=True):
                head = bytes(content)
                if len(head) < 227 or head[:4] != b"LASF":
                    rows.append((p, None, *[None] * 6, None))
                    continue
                minor = head[25]
                count = struct.unpack_from("<Q", head, 247)[0] if minor >= 4 and len(head) >= 255 else struct.unpack_from("<I", head, 107)[0]
                xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack_from("<6d", head, 179)
                rows.append((p, count, xmin, xmax, ymin, ymax, zmin, zmax, b"LASF_Projection" in head))
            yield pd.DataFrame(rows, columns=["path", "points", "xmin", "xmax", "ymin", "ymax", "zmin", "zmax", "has_crs"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.la[sz]").load(path)
    return files.select("path", F.substring("content", 1, 4096).alias("head")).mapInPandas(headers, "path string, points long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double, has_crs boolean")


FEATURES = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(props, kind, coordinates as JSON) of a feature collection."""
    raw = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def largest_ring(features: DataFrame) -> DataFrame:
    """Outer ring of the largest part of each feature by the shoelace formula; points (x, y)."""
    parts = F.when(F.col("kind") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("coordinates", "array<array<array<double>>>")))
    outer = features.withColumn("_part", F.explode(F.transform(parts, lambda p: p[0]))).withColumn("_id", F.sha1(F.col("coordinates")))
    nxt = F.concat(F.slice("_part", 2, F.size("_part")), F.slice("_part", 1, 1))
    twice = F.aggregate(F.zip_with("_part", nxt, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, x: s + x)
    best = outer.withColumn("_area", F.abs(twice) / 2).groupBy("_id", "kind").agg(F.max_by("_part", "_area").alias("ring"), F.first("props").alias("props"), F.max("_area").alias("area"))
    return best.select("props", "area", F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def footprints(features: DataFrame, foot: float = 0.3048006096012192) -> DataFrame:
    """Rings with height in metres, if recorded above 0, and year, if after 1000; several spellings of each."""
    from ..functions.scalars import first_number

    height, year = first_number(F.col("props"), HEIGHT_KEYS), first_number(F.col("props"), YEAR_KEYS)
    return largest_ring(features).withColumn("height_m", F.when(height > 0, height * foot)).withColumn("year", F.when(year > 1000, year.cast("int")))


def matching(features: DataFrame, where: str) -> DataFrame:
    """Features by ``field=value``, or any property that contains the text; case does not matter."""
    field, _, value = where.partition("=")
    if value:
        return features.where(F.lower(F.element_at("props", field)) == value.lower())
    return features.where(F.exists(F.map_values("props"), lambda v: F.lower(v).contains(where.lower())))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rows of a typical-year file: 8 lines of header, then fields by position; missing markers become null."""
    parts = F.split("value", ",")
    lines = spark.read.text(path).where(F.size(parts) >= 22).where(parts[0].try_cast("int").isNotNull())
    value = lambda k, i: F.nullif(parts[i].try_cast("double"), F.lit(MISSING[k])).alias(k)
    return lines.select(*[parts[i].cast("int").alias(n) for i, n in enumerate(("year", "month", "day", "hour"))], *[value(k, i) for k, i in FIELDS.items()])


def checked_weather(weather: DataFrame) -> DataFrame:
    """The rows, failing unless there are 8760."""
    n = weather.agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") == 8760, F.col("year")).otherwise(F.raise_error(F.lit("a typical year has 8760 hours")))
    return weather.join(F.broadcast(n)).withColumn("year", ok).drop("_n")


def read_run(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """Cells of archived runs; keys are partition columns, so other runs are not opened."""
    out = spark.read.parquet(path)
    for k, v in keys.items():
        out = out.where(F.col(k) == v)
    return out


def mosaic(tiles: list[DataFrame]) -> DataFrame:
    """Cells of several rasters; the first that has a cell wins."""
    from functools import reduce

    marked = [t.withColumn("_order", F.lit(i)) for i, t in enumerate(tiles)]
    every = reduce(DataFrame.unionByName, marked)
    return every.groupBy("row", "col").agg(F.min_by("v", "_order").alias("v"))


def synthetic_city(spark: SparkSession, rows: int, cols: int, towers: list[tuple[int, int, int, float]], ground: float = 12.0) -> DataFrame:
    """A flat lattice with square towers (row, col, half width, height)."""
    z = F.lit(0.0)
    for r, c, half, h in towers:
        z = F.when((F.abs(F.col("row") - r) <= half) & (F.abs(F.col("col") - c) <= half), F.greatest(z, F.lit(h))).otherwise(z)
    lattice = spark.range(rows * cols).select(F.expr(f"int(id div {cols})").alias("row"), F.expr(f"int(id % {cols})").alias("col"))
    return lattice.withColumn("heights", z.cast("float")).withColumn("surface", (ground + z).cast("float")).withColumn("ground", F.lit(ground).cast("float"))


RUN = "scenario string, season string, theta_from_deg double, res_m double, box struct<nx: int, ny: int, nz: int, x0c: double, p0: array<double>, ex: array<double>, ey: array<double>>"


def run_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(name, description) of the archived runs under ``folder``, by name: folders that hold a run.json and are no tests."""
    found = spark.read.schema(RUN).option("multiLine", True).json(f"{folder}/*/run.json").withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_extract("path", r"([^/]+)/run\.json$", 1)
    return found.select(name.alias("name"), "scenario", "season", "theta_from_deg", "res_m", "box").where(~F.col("name").contains("_test")).orderBy("name")


def usable_cells(cells: DataFrame) -> DataFrame:
    """Cells of a run that may be read: under no roof, with a finite speed."""
    speed = F.col("street_speed")
    return cells.withColumn("ok", ~F.col("roof") & speed.isNotNull() & ~F.isnan(speed) & (F.abs(speed) < float("inf")))


def parent_of(runs: DataFrame, scenario: str, season: str, direction: float, res_m: float, box: tuple[int, int, int]) -> DataFrame:
    """The coarse run to nest in; the job fails where its box is not the one expected."""
    one = runs.where((F.col("scenario") == scenario) & (F.col("season") == season) & (F.col("theta_from_deg") == direction) & (F.col("res_m") == res_m))
    same = (F.col("box.nx") == box[0]) & (F.col("box.ny") == box[1]) & (F.col("box.nz") == box[2])
    return one.withColumn("name", F.when(same, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("another box: "), "name"))))


DAYS = "seasons map<string, struct<chosen: struct<date: string>, report_timestamps: array<string>>>, epw string"


def day_config(spark: SparkSession, path: str) -> DataFrame:
    """(season, day, times, weather file) of the chosen days."""
    raw = spark.read.schema(DAYS).option("multiLine", True).json(path)
    return raw.select(F.explode("seasons").alias("season", "x"), "epw").select("season", F.to_date("x.chosen.date").alias("day"), F.col("x.report_timestamps").alias("times"), "epw")


def context_numbers(parts: dict[str, DataFrame]) -> DataFrame:
    """(key, value, unit, scope, status, note) of small tables (key, value, unit, note) of several scopes; none may be published."""
    out = None
    for scope, df in parts.items():
        one = df.select("key", F.col("value").cast("double").alias("value"), "unit", F.lit(scope).alias("scope"), F.lit("internal").alias("status"), "note")
        out = one if out is None else out.unionByName(one)
    return out
