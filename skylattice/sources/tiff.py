"""Raster files (TIFF with the georeferencing tags) as a Spark data source, read and written.

Reading plans partitions of whole strips or tiles from each file's offset table: what a
window, or filters on row and col, cannot need is neither planned nor read.  Raw and
Deflate data of any integer or float kind is taken, in either byte order, with the
horizontal predictor; anything else fails with its name before it is read.

Writing makes a file for each layer and band of rows, so that no task holds a layer:
together they are a mosaic, each file with its own place, and reading their folder gives
the layer again.  Files are named when all tasks have ended, as those of point tiles.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.grid import Affine, Grid
from .las import Written, pushes, pushing, store_of

CELLS = 1_000_000  # cells of a partition, or one strip or tile
BAND_ROWS = 2048
STRIP_ROWS = 64
SCHEMA = "name string, row int, col int, x double, y double, v double"

# Tags of the format, sizes of its field types, names of its sample kinds.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP, COUNTS, PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, KIND = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SCALE, TIE, TRANSFORM, NODATA = 33550, 33922, 34264, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 6: "b", 8: "h", 9: "i"}
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Raster:
    """What a file's directory says."""

    path: str
    name: str
    rows: int
    cols: int
    kind: str  # numpy's name of a sample, with its byte order
    compression: int
    predictor: int
    high: int  # rows of a strip or tile
    wide: int  # columns of it
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    affine: Affine
    nodata: float | None

    def segments(self, r0: int, c0: int, r1: int, c1: int) -> list[int]:
        """Numbers of the strips or tiles that the window [r0, r1) x [c0, c1) needs."""
        across = -(-self.cols // self.wide)
        down = range(max(0, r0) // self.high, -(-min(r1, self.rows) // self.high))
        return [i * across + j for i in down for j in range(max(0, c0) // self.wide, -(-min(c1, self.cols) // self.wide))] if r1 > r0 and c1 > c0 else []


def directory(path: str) -> Raster:
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is no TIFF of the plain kind")
        f.seek(struct.unpack(order + "I", head[4:])[0])
        entries = f.read(12 * struct.unpack(order + "H", f.read(2))[0])
        tags: dict[int, tuple] = {}
        for k in range(0, len(entries), 12):
            tag, kind, n = struct.unpack_from(order + "HHI", entries, k)
            code = TYPES.get(kind)
            if code is None:
                continue
            form = f"{order}{n}{code}"
            size = struct.calcsize(form)
            raw = entries[k + 8 : k + 8 + size]
            if size > 4:
                f.seek(struct.unpack_from(order + "I", entries, k + 8)[0])
                raw = f.read(size)
            tags[tag] = struct.unpack(form, raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError(f"{path} has {one(SAMPLES, 1)} bands")
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"{path} is compressed by method {one(COMPRESSION, 1)}")
    if one(PREDICTOR, 1) not in (1, 2) or one(PREDICTOR, 1) == 2 and one(KIND, 1) == 3:
        raise ValueError(f"{path} has predictor {one(PREDICTOR, 1)}")
    rows, cols = one(HEIGHT, 0), one(WIDTH, 0)
    tiled = TILE_OFFSETS in tags
    text = one(NODATA, b"").rstrip(b"\0 ").decode("ascii", "replace")
    if TRANSFORM in tags:
        t = tags[TRANSFORM]
        affine = Affine(t[3], t[7], t[1], t[0], t[5], t[4])
    elif SCALE in tags and TIE in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[SCALE], tags[TIE]
        affine = Affine(x - i * sx, y + j * sy, 0.0, sx, -sy, 0.0)
    else:
        affine = Affine(0.0, 0.0, 0.0, 1.0, 1.0, 0.0)
    kind = f"{order}{KINDS.get(one(KIND, 1), '?')}{one(BITS, 1) // 8}"
    try:
        np.dtype(kind)
    except TypeError:
        raise ValueError(f"{path} has samples of {one(BITS, 1)} bits of kind {one(KIND, 1)}") from None
    name = re.sub(r"(?:\.band\d+)?\.tiff?$", "", at.rsplit("/", 1)[-1], flags=re.I)
    high, wide = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(rows, one(STRIP, rows)), cols)
    return Raster(path, name, rows, cols, kind, one(COMPRESSION, 1), one(PREDICTOR, 1), high, wide, tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], affine, float(text) if text else None)


def rasters_of(path: str) -> list[str]:
    """The one file, or the raster files of a folder by name."""
    store, at = store_of(path)
    if store.get_file_info(at).type == pa.fs.FileType.File:
        return [path]
    names = sorted(x.base_name for x in store.get_file_info(pa.fs.FileSelector(at)) if re.search(r"^[^._].*\.tiff?$", x.base_name, re.I))
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class Segments(InputPartition):
    raster: Raster
    numbers: list[int]

    def __post_init__(self) -> None:
        super().__init__(None)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.names = options["path"], options.get("names")
        self.r0, self.c0, self.r1, self.c1 = json.loads(options.get("window", "[0, 0, 2147483647, 2147483647]"))
        self.empty = options.get("empty", "false").lower() == "true"
        self.cells = int(options.get("cells", CELLS))

    def partitions(self) -> list[Segments]:
        found = [directory(p) for p in rasters_of(self.path)]
        if not found:
            raise ValueError(f"no raster files in {self.path}")
        if self.names is not None:
            found = [r for r in found if r.name in self.names.split(",")]
        out = []
        for r in found:
            needed = r.segments(self.r0, self.c0, self.r1, self.c1)
            each = max(1, self.cells // max(1, r.high * r.wide))
            out += [Segments(r, needed[k : k + each]) for k in range(0, len(needed), each)]
        return out or [Segments(None, [])]

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        r = partition.raster
        if r is None:
            return
        store, at = store_of(r.path)
        across = -(-r.cols // r.wide)
        with store.open_input_file(at) as f:
            for n in partition.numbers:
                row, col = n // across * r.high, n % across * r.wide
                f.seek(r.offsets[n])
                raw = f.read(r.counts[n])
                if r.compression != 1:
                    raw = zlib.decompress(raw)
                values = np.frombuffer(raw, r.kind)
                values = values[: len(values) // r.wide * r.wide].reshape(-1, r.wide)[: r.high]
                if r.predictor == 2:
                    values = np.cumsum(values, axis=1, dtype=values.dtype)
                rows, cols = np.arange(row, row + len(values)), np.arange(col, col + r.wide)
                down = (rows >= self.r0) & (rows < min(self.r1, r.rows))
                along = (cols >= self.c0) & (cols < min(self.c1, r.cols))
                v = values[down][:, along].astype(np.float64).ravel()
                rows, cols = (a.ravel() for a in np.meshgrid(rows[down], cols[along], indexing="ij"))
                known = ~np.isnan(v) & (v != r.nodata if r.nodata is not None else True)
                if not self.empty:
                    rows, cols, v, known = rows[known], cols[known], v[known], known[known]
                if not len(v):
                    continue
                x, y = r.affine.place(rows + 0.5, cols + 0.5)
                columns = [pa.array([r.name] * len(v)), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(x), pa.array(y), pa.array(v, mask=~known)]
                yield pa.RecordBatch.from_arrays(columns, ["name", "row", "col", "x", "y", "v"])


class PushingRasterReader(RasterReader):
    """For sessions that push filters down to sources in Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of row and col shrink the window; Spark evaluates all filters again."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("row", "col") and isinstance(getattr(f, "value", None), int):
                first, end = ("r0", "r1") if name == "row" else ("c0", "c1")
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    setattr(self, first, max(getattr(self, first), f.value + isinstance(f, GreaterThan)))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    setattr(self, end, min(getattr(self, end), f.value + (not isinstance(f, LessThan))))
            yield f


class RasterWriter(DataSourceArrowWriter):
    """A task has a band of rows of a layer in memory at a time: its rows come together, sorted by layer and band."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.rows, self.cols, self.band = int(options["rows"]), int(options["cols"]), int(options.get("band", BAND_ROWS))
        self.affine = Affine(*json.loads(options["affine"]))
        self.kind, self.nodata = options.get("kind", "f4"), float(options.get("nodata", -9999))
        self.deflate = options.get("deflate", "true").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        now, z = None, None

        def flush() -> None:
            if now is not None:
                made = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(made) as out:
                    out.write(self.content(z, now[1] * self.band))
                files.append((made, f"{root}/{now[0]}.band{now[1]:06d}.tif"))

        for batch in iterator:
            names, rows, cols, bands = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("name", "row", "col", "band"))
            values = batch.column("v").to_numpy(zero_copy_only=False).astype(np.float64)
            edges = np.flatnonzero((names[1:] != names[:-1]) | (bands[1:] != bands[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(names)], strict=True):
                if a == b:
                    continue
                if (names[a], bands[a]) != now:
                    flush()
                    now = (names[a], int(bands[a]))
                    z = np.full((min(self.band, self.rows - now[1] * self.band), self.cols), self.nodata, self.kind)
                z[rows[a:b] - now[1] * self.band, cols[a:b]] = np.where(np.isnan(values[a:b]), self.nodata, values[a:b])
        flush()
        return Written(files)

    def content(self, z: np.ndarray, first_row: int) -> bytes:
        z = z.astype(z.dtype.newbyteorder("<"))
        strips = [z[r : r + STRIP_ROWS].tobytes() for r in range(0, len(z), STRIP_ROWS)]
        if self.deflate:
            strips = [zlib.compress(s, 6) for s in strips]
        counts = [len(s) for s in strips]
        offsets = [8 + sum(counts[:k]) for k in range(len(strips))]
        a = self.affine
        x, y = a.place(first_row, 0)
        kind = {"u": 1, "i": 2, "f": 3}[z.dtype.kind]
        nodata = repr(self.nodata).encode() + b"\0"
        fields = [
            (WIDTH, 4, [z.shape[1]]), (HEIGHT, 4, [z.shape[0]]), (BITS, 3, [8 * z.dtype.itemsize]), (COMPRESSION, 3, [8 if self.deflate else 1]), (PHOTOMETRIC, 3, [1]),
            (OFFSETS, 4, offsets), (SAMPLES, 3, [1]), (STRIP, 4, [STRIP_ROWS]), (COUNTS, 4, counts), (PLANES, 3, [1]), (KIND, 3, [kind]),
            (TRANSFORM, 12, [a.xc, a.xr, 0.0, x, a.yc, a.yr, 0.0, y, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (NODATA, 2, [nodata]),
        ]
        start = 8 + sum(counts) + sum(counts) % 2
        after = start + 2 + 12 * len(fields) + 4
        entries, more = b"", b""
        for tag, code, values in fields:
            n = len(values[0]) if code == 2 else len(values)
            body = values[0] if code == 2 else struct.pack(f"<{n}{TYPES[code]}", *values)
            if len(body) > 4:
                entries += struct.pack("<HHII", tag, code, n, after + len(more))
                more += body + b"\0" * (len(body) % 2)
            else:
                entries += struct.pack("<HHI", tag, code, n) + body.ljust(4, b"\0")
        return b"".join([b"II", struct.pack("<HI", 42, start), *strips, b"\0" * (sum(counts) % 2), struct.pack("<H", len(fields)), entries, b"\0" * 4, more])

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            for made, name in m.files if m else []:
                store.move(made, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            for made, _ in m.files if m else []:
                store.delete_file(made)


class Rasters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skylattice_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return (PushingRasterReader if pushes(self.options) else RasterReader)(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options)


def read_rasters(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, names: list[str] | None = None, empty: bool = False) -> DataFrame:
    """(name, row, col, x, y, v): cells of the raster files under ``path``, rows and columns counted in each file.

    ``window`` is (first row, first column, end row, end column).  Cells without a value are left out, or
    null where ``empty`` asks for them.
    """
    spark.dataSource.register(Rasters)
    source = spark.read.format(Rasters.name()).option("path", path).option("empty", str(empty).lower()).option("push", pushing(spark))
    if window is not None:
        source = source.option("window", json.dumps(list(window)))
    if names is not None:
        source = source.option("names", ",".join(names))
    return source.load()


def on_grid(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells of a mosaic with row and col on ``grid``, by their centres; those outside go."""
    row, col = grid.cell(F.col("x"), F.col("y"))
    return cells.withColumn("row", row).withColumn("col", col).where(grid.inside(F.col("row"), F.col("col")))


def write_rasters(cells: DataFrame, path: str, grid: Grid, kind: str = "f4", nodata: float = -9999.0, deflate: bool = True, band_rows: int = BAND_ROWS) -> None:
    """``cells`` (name, row, col, v) on ``grid`` as files of ``band_rows`` rows of a layer each; null is no data."""
    spark = cells.sparkSession
    spark.dataSource.register(Rasters)
    a = grid.affine
    out = cells.where(grid.inside(F.col("row"), F.col("col"))).select(F.col("name").cast("string").alias("name"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.floor(F.col("row") / band_rows).cast("int").alias("band"), F.col("v").cast("double").alias("v"))
    ordered = out.repartition("name", "band").sortWithinPartitions("name", "band")
    place = json.dumps([a.ox, a.oy, a.xr, a.xc, a.yr, a.yc])
    ordered.write.format(Rasters.name()).mode("append").options(rows=grid.rows, cols=grid.cols, band=band_rows, affine=place, kind=kind, nodata=nodata, deflate=str(deflate).lower()).save(path)


def layers_long(cells: DataFrame, layers: dict[str, Column | str]) -> DataFrame:
    """(name, row, col, v) of some columns of ``cells``."""
    values = [F.struct(F.lit(n).alias("name"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for n, c in layers.items()]
    return cells.select("row", "col", F.explode(F.array(*values)).alias("l")).select("l.name", "row", "col", "l.v")


def write_layer_set(cells: DataFrame, path: str, grid: Grid, layers: dict[str, Column | str], masks: dict[str, Column | str]) -> None:
    """Layers as 32-bit rasters, masks as bytes (255 where a cell is missing), and the grid's description as JSON."""
    write_rasters(layers_long(cells, layers), f"{path}/layers", grid)
    write_rasters(layers_long(cells, masks), f"{path}/masks", grid, kind="u1", nodata=255)
    grid.describe(cells.sparkSession).coalesce(1).write.mode("overwrite").json(f"{path}/domain")


def write_changes(changes: DataFrame, path: str, grid: Grid, values: list[str], hour: str = "hour") -> None:
    """A raster for each of ``values`` and hour of ``changes`` (row, col, ``hour``, values), named like ``du_07``."""
    named = [F.struct(F.concat(F.lit(f"{v}_"), F.lpad(F.col(hour).cast("string"), 2, "0")).alias("name"), F.col(v).cast("double").alias("v")) for v in values]
    write_rasters(changes.select("row", "col", F.explode(F.array(*named)).alias("l")).select("l.name", "row", "col", "l.v"), path, grid)
