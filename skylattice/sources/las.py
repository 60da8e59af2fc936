"""Point tiles (uncompressed .las) as a Spark data source, read and written.

Reading plans one partition for each run of ``chunk`` points of each tile from the
tiles' headers.  Tiles whose box misses the domain, a convex polygon, or the box that
filters on x, y and z leave are not opened again; inside a tile only the rows of the
box leave the reader.  A tile that names no projection, or one whose unit of length
cannot be worked out, or another unit than the grid's, fails the job before any point is read.

Writing makes a file a tile, named by the column ``tile``, in two steps: tasks write
under names of their own, and the driver gives the files of the tasks that count their
names, so a task that runs twice leaves no second copy.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.grid import Grid

CHUNK = 4_000_000
BATCH = 200_000  # points handed to Spark at a time
SCHEMA = "x double, y double, z double, cls int, nret int, tile string"

# Codes of linear units and their metres, and projections with a known unit.
UNITS = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}
PROJECTIONS = {2263: 9003, 32118: 9001}
HEADER = 227  # bytes of a version 1.2 header


#: Spark's setting without which a reader must not offer to take filters.
PUSHES = "spark.sql.python.filterPushdown.enabled"


def pushing(spark: SparkSession) -> str:
    return spark.conf.get(PUSHES, "false")


def pushes(options: dict[str, str]) -> bool:
    return options.get("push", "false").lower() == "true"


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pa.fs.LocalFileSystem(), path)


def unit_of_keys(keys: dict[int, int]) -> float | None:
    """Metres of the unit that geographic keys name, or that their projection has."""
    projection = keys.get(3072, 0)
    code = keys.get(3076) or PROJECTIONS.get(projection) or (9001 if 32601 <= projection <= 32660 or 32701 <= projection <= 32760 else 0)
    return UNITS.get(code)


def unit_of_text(wkt: str) -> float | None:
    """Metres of the first unit of length in a projection's text."""
    if not re.match(r"\s*(?:COMPD_CS|COMPOUNDCRS|PROJCS|PROJCRS|PROJECTEDCRS)\b", wkt):
        return None
    found = re.findall(r'\b(?:LENGTH)?UNIT\s*\[\s*"([^"]*)"\s*,\s*([0-9.eE+-]+)', wkt)
    return next((float(value) for name, value in found if "deg" not in name.lower() and "rad" not in name.lower()), None)


def layout(form: int, length: int) -> np.dtype:
    """Where a point's fields are."""
    return np.dtype({"names": ["x", "y", "z", "flags", "cls"], "formats": ["<i4", "<i4", "<i4", "u1", "u1"], "offsets": [0, 4, 8, 14, 16 if form >= 6 else 15], "itemsize": length})


PLAIN = layout(0, 20)


@dataclass(frozen=True)
class Tile:
    """What a header says."""

    path: str
    name: str
    points: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    start: int  # of the points, in bytes
    form: int
    length: int  # of a point, in bytes
    unit_m: float | None
    projected: bool

    @property
    def packed(self) -> bool:
        return self.form >= 128

    def layout(self) -> np.dtype:
        return layout(self.form, self.length)


def header(path: str) -> Tile:
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        head = f.read(375)
        if len(head) < HEADER or head[:4] != b"LASF":
            raise ValueError(f"{path} is no point tile")
        size, start, records, form, length, points = struct.unpack_from("<HIIBHI", head, 94)
        if head[25] >= 4 and len(head) >= 255:
            points = struct.unpack_from("<Q", head, 247)[0]
        scale, offset = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
        ends = struct.unpack_from("<6d", head, 179)
        f.seek(size)
        unit, projected = None, False
        for _ in range(records):
            user, record, n = struct.unpack_from("<2x16sHH", f.read(54))
            body = f.read(n)
            if user.rstrip(b"\0") != b"LASF_Projection":
                continue
            if record == 2112:
                projected, unit = True, unit_of_text(body.rstrip(b"\0").decode("utf-8", "replace")) or unit
            elif record == 34735:
                values = struct.unpack_from(f"<{n // 2}H", body)
                keys = {values[i]: values[i + 3] for i in range(4, 4 + 4 * values[3], 4) if values[i + 1] == 0}
                projected, unit = True, unit or unit_of_keys(keys)
    name = re.sub(r"\.la[sz]$", "", at.rsplit("/", 1)[-1], flags=re.I)
    return Tile(path, name, points, ends[1::2], ends[0::2], scale, offset, start, form, length, unit, projected)


def tiles_of(path: str) -> list[str]:
    """Tiles of a folder by name, those with .laz before .las; or the one file."""
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [path]
    names = [x.base_name for x in store.get_file_info(pa.fs.FileSelector(at)) if x.type == pa.fs.FileType.File and re.search(r"^[^._].*\.la[sz]$", x.base_name, re.I)]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names, key=lambda n: (n.lower().endswith(".las"), n))]


def meets(low: tuple, high: tuple, polygon: list[tuple[float, float]]) -> bool:
    """Whether a box and a convex polygon meet, edges included: no axis of either parts them."""
    corners = [(x, y) for x in (low[0], high[0]) for y in (low[1], high[1])]
    sides = zip(polygon, [*polygon[1:], polygon[0]], strict=True)
    for nx, ny in [(1.0, 0.0), (0.0, 1.0), *((b[1] - a[1], a[0] - b[0]) for a, b in sides)]:
        one, two = [nx * x + ny * y for x, y in corners], [nx * x + ny * y for x, y in polygon]
        if max(one) < min(two) or max(two) < min(one):
            return False
    return True


@dataclass
class Run(InputPartition):
    tile: Tile
    first: int
    count: int

    def __post_init__(self) -> None:
        super().__init__(None)


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.domain = [tuple(p) for p in json.loads(options.get("domain", "[]"))]
        self.unit_m = float(options["unit_m"]) if "unit_m" in options else None
        ends = json.loads(options.get("box", "{}"))
        self.low, self.high = ({c: float(ends[c][i]) if c in ends else end for c in "xyz"} for i, end in enumerate((-np.inf, np.inf)))

    def wanted(self, tile: Tile) -> bool:
        inside = all(tile.high[i] >= self.low[c] and tile.low[i] <= self.high[c] for i, c in enumerate("xyz"))
        return tile.points > 0 and inside and (not self.domain or meets(tile.low, tile.high, self.domain))

    def partitions(self) -> list[Run]:
        found = [header(p) for p in tiles_of(self.path)]
        if not found:
            raise ValueError(f"no point tiles in {self.path}")
        for t in found:
            if not t.projected:
                raise ValueError(f"{t.path} names no projection")
            if t.unit_m is None:
                raise ValueError(f"the unit of length of {t.path} cannot be worked out")
            if self.unit_m is not None and abs(t.unit_m - self.unit_m) > 1e-9:
                raise ValueError(f"{t.path} and the grid disagree on the unit of length")
        found = [t for t in found if self.wanted(t)]
        for t in found:
            if t.packed:
                raise ValueError(f"{t.path} is compressed")
        # Spark asks for one partition at least.
        return [Run(t, k, min(self.chunk, t.points - k)) for t in found for k in range(0, t.points, self.chunk)] or [Run(None, 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        t = partition.tile
        if t is None:
            return
        store, at = store_of(t.path)
        with store.open_input_file(at) as f:
            for k in range(partition.first, partition.first + partition.count, BATCH):
                n = min(BATCH, partition.first + partition.count - k)
                f.seek(t.start + k * t.length)
                raw = np.frombuffer(f.read(n * t.length), t.layout())
                if len(raw) < n:
                    raise ValueError(f"{t.path} ends before its {t.points} points")
                xyz = {c: raw[c] * t.scale[i] + t.offset[i] for i, c in enumerate("xyz")}
                keep = np.ones(n, bool)
                for c, v in xyz.items():
                    keep &= (v >= self.low[c]) & (v <= self.high[c])
                if not keep.any():
                    continue
                cls = raw["cls"] if t.form >= 6 else raw["cls"] & 31
                returns = raw["flags"] >> 4 if t.form >= 6 else (raw["flags"] >> 3) & 7
                columns = [*(pa.array(v[keep]) for v in xyz.values()), pa.array(cls[keep].astype(np.int32)), pa.array(returns[keep].astype(np.int32)), pa.array([t.name] * int(keep.sum()))]
                yield pa.RecordBatch.from_arrays(columns, ["x", "y", "z", "cls", "nret", "tile"])


class PushingTileReader(TileReader):
    """For sessions that push filters down to sources in Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of x, y and z shrink the box; Spark evaluates all filters again."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in self.low and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value)
            yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # made under, to be named


class TileWriter(DataSourceArrowWriter):
    """Points in memory are those of the tiles that a task has open, ``chunk`` a tile at most."""

    def __init__(self, options: dict[str, str]):
        self.path, self.chunk = options["path"].rstrip("/"), int(options.get("chunk", CHUNK))
        self.scale = tuple(float(options.get(f"scale_{c}", 0.001)) for c in "xyz")
        self.offset = tuple(float(options.get(f"offset_{c}", 0.0)) for c in "xyz")
        self.keys = {k: int(options[o]) for k, o in ((3072, "epsg"), (3076, "unit")) if o in options}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        held: dict[str, list[np.ndarray]] = {}
        parts: dict[str, int] = {}
        files: list[tuple[str, str]] = []

        def flush(name: str) -> None:
            nth = parts[name] = parts.get(name, -1) + 1
            made = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(made) as out:
                # Bytes are put together, not records: those would lose their gaps.
                out.write(self.content(np.frombuffer(b"".join(r.tobytes() for r in held.pop(name)), PLAIN)))
            files.append((made, f"{root}/{name}{f'-{nth}' if nth else ''}.las"))

        for batch in iterator:
            raw = np.zeros(batch.num_rows, PLAIN)
            for i, c in enumerate("xyz"):
                whole = np.floor((batch.column(c).to_numpy(zero_copy_only=False) - self.offset[i]) / self.scale[i] + 0.5)
                if len(whole) and not np.abs(whole).max() < 2**31:
                    raise ValueError(f"a {c} does not fit the scale of the tile, or is missing")
                raw[c] = whole
            raw["cls"], raw["flags"] = batch.column("cls").to_numpy(zero_copy_only=False), (batch.column("nret").to_numpy(zero_copy_only=False) << 3) | 1
            names = np.array(batch.column("tile").to_pylist(), object)
            for name in dict.fromkeys(names):
                held.setdefault(name, []).append(raw[names == name])
                if sum(map(len, held[name])) >= self.chunk:
                    flush(name)
        for name in list(held):
            flush(name)
        return Written(files)

    def content(self, raw: np.ndarray) -> bytes:
        keys = struct.pack(f"<{4 + 4 * len(self.keys)}H", 1, 1, 0, len(self.keys), *(v for k in sorted(self.keys) for v in (k, 0, 1, self.keys[k])))
        record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys if self.keys else b""
        ends = [f(raw[c] * self.scale[i] + self.offset[i]) for i, c in enumerate("xyz") for f in (np.max, np.min)]
        head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, b"", 1, 2, b"", b"", 1, 2024, HEADER, HEADER + len(record), int(bool(record)), 0, 20, len(raw), len(raw), 0, 0, 0, 0)
        return head + struct.pack("<12d", *self.scale, *self.offset, *ends) + record + raw.tobytes()

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


class PointTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skylattice_las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return (PushingTileReader if pushes(self.options) else TileReader)(self.options)

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options)


def read_points(spark: SparkSession, path: str, grid: Grid | None = None, box: dict[str, tuple[float, float]] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(x, y, z, cls, nret, tile) of the tiles under ``path`` that touch the grid's domain; inside ``box``, if given, least and greatest by coordinate."""
    spark.dataSource.register(PointTiles)
    source = spark.read.format(PointTiles.name()).option("path", path).option("chunk", chunk).option("push", pushing(spark)).option("box", json.dumps(box or {}))
    if grid is not None:
        source = source.option("domain", json.dumps(grid.corners())).option("unit_m", repr(grid.unit_m))
    return source.load()


def points_on(points: DataFrame, grid: Grid) -> DataFrame:
    """``points`` inside the grid, with row and col."""
    row, col = grid.cell(F.col("x"), F.col("y"))
    placed = points.withColumn("row", row).withColumn("col", col)
    return placed.where(grid.inside(F.col("row"), F.col("col")))


def write_points(points: DataFrame, path: str, **options: object) -> None:
    """``points`` (x, y, z, cls, nret, tile) as a file a tile; a tile's points meet in one task."""
    spark = points.sparkSession
    spark.dataSource.register(PointTiles)
    out = points.select("x", "y", "z", F.col("cls").cast("int").alias("cls"), F.col("nret").cast("int").alias("nret"), "tile").repartition("tile")
    out.write.format(PointTiles.name()).mode("append").options(**options).save(path)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """(tile, points, box, scale, unit_m, projected, packed) by headers alone, read on the executors."""
    paths = tiles_of(path)
    schema = "tile string, points long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double, unit_m double, projected boolean, packed boolean"

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t.name, t.points, t.low[0], t.high[0], t.low[1], t.high[1], t.low[2], t.high[2], t.unit_m, t.projected, t.packed) for t in map(header, batch.column("path").to_pylist())]
            kinds = [pa.string(), pa.int64(), *[pa.float64()] * 7, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], [s.split()[0] for s in schema.split(", ")])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 2 * spark.sparkContext.defaultParallelism)))
    return listed.mapInArrow(heads, schema)
