"""Sinks: bundles, tables of numbers, rasters, palette images, line files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_bundle(bundle: DataFrame, path: str) -> None:
    """One compact JSON document a row."""
    bundle.select(F.to_json(F.struct(*bundle.columns)).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as one CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(cells: DataFrame, path: str, keys: list[str]) -> None:
    """Cells by run; only the partitions written are replaced."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def png(indices: np.ndarray, palette: list[tuple[int, int, int, int]]) -> bytes:
    """A palette image: 8-bit indices, a colour and an alpha for each."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = indices.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = indices
    return b"".join([
        b"\x89PNG\r\n\x1a\n",
        chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)),
        chunk(b"PLTE", bytes(v for c in palette for v in c[:3])),
        chunk(b"tRNS", bytes(c[3] for c in palette)),
        chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)),
        chunk(b"IEND", b""),
    ])


def images(cells: DataFrame, palette: list[tuple[int, int, int, int]], size: int = 512) -> DataFrame:
    """(brow, bcol, png) of ``cells`` (row, col, bin): an image a block; bin 0 and missing cells are clear."""

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(part["brow"].iloc[0]), int(part["bcol"].iloc[0])
        z = np.zeros((size, size), np.uint8)
        z[part["row"] - r0 * size, part["col"] - c0 * size] = part["bin"]
        return pd.DataFrame({"brow": [r0], "bcol": [c0], "png": [png(z, palette)]})

    at = lambda c: F.floor(F.col(c) / size).cast("int")
    keyed = cells.select("row", "col", F.col("bin").cast("int").alias("bin"), at("row").alias("brow"), at("col").alias("bcol"))
    return keyed.groupBy("brow", "bcol").applyInPandas(draw, "brow int, bcol int, png binary")


def data_uri(image: str = "png") -> Column:
    """The image as a page can hold it."""
    return F.concat(F.lit("data:image/png;base64,"), F.base64(F.col(image)))


def line_files(lines: DataFrame) -> DataFrame:
    """(run, content): a binary file a run of ``lines`` (run, line_id, vertex, e, n, u): counts, lengths, then decimetres."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"run": batch["run"], "content": [file_of(x) for x in batch["lines"]]})

    def file_of(found) -> bytes:
        sizes = [len(x["points"]) for x in found]
        xyz = np.array([[p["e"], p["n"], p["u"]] for x in found for p in x["points"]], np.float64).reshape(-1, 3)
        body = np.clip(np.rint(xyz * 10), -32767, 32767).astype("<i2").tobytes()
        return struct.pack("<ii", len(sizes), sum(sizes)) + np.array(sizes, "<u2").tobytes() + body

    each = lines.groupBy("run", "line_id").agg(F.sort_array(F.collect_list(F.struct("vertex", "e", "n", "u"))).alias("points"))
    runs = each.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("line_id", "points"))).alias("lines"))
    return runs.mapInPandas(pack, "run string, content binary")


#: Columns of the solver's weather file; what is not measured here is -999.  Fixed values.
MET = "%iy id it imin qn qh qe qs qf U RH Tair pres rain kdown snow ldown fcld wuh xsmd lai kdiff kdir wdir"
MET_FROM = {"U": "ws", "RH": "rh", "Tair": "ta", "pres": "pressure_pa", "kdown": "ghi", "kdiff": "dhi", "kdir": "dni"}


def met_lines(weather: DataFrame) -> DataFrame:
    """(ts, value): rows of the solver's weather file for ``weather`` (ts, ws, rh, ta, pressure_pa, ghi, dhi, dni), pressure in kPa."""
    clock = {"%iy": F.year("ts"), "id": F.dayofyear("ts"), "it": F.hour("ts"), "imin": F.minute("ts")}
    short = lambda c: F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"0+$", ""), r"\.$", ""))
    cells = []
    for name in MET.split():
        if name in clock:
            cells.append(clock[name].cast("string"))
        elif name in MET_FROM:
            c = F.col(MET_FROM[name])
            cells.append(F.coalesce(short(c / 1000.0 if name == "pres" else c), F.lit("-999")))
        else:
            cells.append(F.lit("-999"))
    return weather.select("ts", F.concat_ws(" ", *cells).alias("value"))


def write_met(weather: DataFrame, path: str) -> None:
    """The weather file as one text: a header line, then a line an hour."""
    rows = met_lines(weather)
    head = rows.sparkSession.createDataFrame([(MET,)], "value string").select(F.lit(None).cast(rows.schema["ts"].dataType).alias("ts"), "value")
    head.unionByName(rows).coalesce(1).sortWithinPartitions(F.col("ts").asc_nulls_first()).select("value").write.mode("overwrite").text(path)


def crop_features(features: DataFrame, keep: list[str]) -> DataFrame:
    """Features with only the named properties."""
    return features.withColumn("props", F.map_filter("props", lambda k, v: k.isin(*keep)))
