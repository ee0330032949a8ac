"""GeoTIFF files as tile tables: a catalog of headers, bands as arrays, windows, and tiles encoded as files.

Files in strips or tiles, uncompressed or deflated, with or without horizontal differences, of unsigned integers or
floats. What breaks these rules has a null header.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import geo
from gridwise.operators import raster, regions, spatial
from gridwise.session import materialize

# Field numbers and the sizes of field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
SCALE, TIE, KEYS, DESCRIPTIONS, EPSG_KEY = 33550, 33922, 34735, 42112, 3072
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 12: ("d", 8), 11: ("f", 4)}
HEADER = "bands int, h int, w int, epsg int, x0 double, y0 double, dx double, dy double"
_HEADER = pa.struct([("bands", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("epsg", pa.int32()), ("x0", pa.float64()), ("y0", pa.float64()), ("dx", pa.float64()), ("dy", pa.float64())])


def fields(data: bytes | Callable[[int, int], bytes]) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory, from a file's bytes or from what reads so many of them at a place."""
    read = data if callable(data) else lambda at, n: data[at : at + n]
    start = read(0, 8)
    order = {b"II": "<", b"MM": ">"}[start[:2]]
    magic, at = struct.unpack_from(f"{order}HI", start, 2)
    if magic != 42:
        raise ValueError("no TIFF file")
    (n,) = struct.unpack(f"{order}H", read(at, 2))
    directory, out = read(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", directory, 12 * k)
        if kind not in _SIZES:
            continue
        code, size = _SIZES[kind]
        value = directory[12 * k + 8 : 12 * k + 12]
        if size * count > 4:
            value = read(*struct.unpack(f"{order}I", value), size * count)
        out[tag] = (value[:count].rstrip(b"\0"),) if code == "s" else struct.unpack_from(f"{order}{count}{code}" if len(code) == 1 else f"{order}{2 * count}I", value)
    return order, out


def header(data: bytes | Callable[[int, int], bytes]) -> dict:
    return _about(fields(data)[1])


def _about(f: dict[int, tuple]) -> dict:
    scale, tie, keys = f.get(SCALE, (1.0, 1.0, 0.0)), f.get(TIE, (0.0,) * 6), f.get(KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (EPSG_KEY, 2048)), None)
    return {"bands": f.get(SAMPLES, (1,))[0], "h": f[HEIGHT][0], "w": f[WIDTH][0], "epsg": epsg, "x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1], "dx": scale[0], "dy": -scale[1]}


@dataclass(frozen=True)
class Layout:
    """How a file's pixels lie in blocks, which are strips or tiles: n bands of h x w pixels, blocks of th x tw with per bands each."""

    n: int
    h: int
    w: int
    th: int
    tw: int
    per: int
    kind: np.dtype
    packed: bool
    predicted: bool
    places: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.w // self.tw)

    @property
    def down(self) -> int:
        return -(-self.h // self.th)

    def block(self, part: bytes) -> np.ndarray:
        """(per, th, tw) pixels of a block's bytes; rows that a last strip lacks are 0."""
        flat = np.frombuffer(zlib.decompress(part) if self.packed else part, self.kind)
        out = np.zeros((self.th, self.tw, self.per), self.kind.newbyteorder("="))
        rows = min(len(flat) // (self.tw * self.per), self.th)
        out[:rows] = flat[: rows * self.tw * self.per].reshape(rows, self.tw, self.per)
        return (np.cumsum(out, axis=1, dtype=out.dtype) if self.predicted else out).transpose(2, 0, 1)


def layout(data: bytes | Callable[[int, int], bytes]) -> Layout:
    order, f = fields(data)
    h, w, n = f[HEIGHT][0], f[WIDTH][0], f.get(SAMPLES, (1,))[0]
    packed, predicted, planar = f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0], f.get(PLANAR, (1,))[0] == 2
    if packed not in (1, 8, 32946) or predicted not in (1, 2):
        raise ValueError(f"compression {packed}, predictor {predicted}")
    kind = np.dtype(f"{order}{'f' if f.get(SAMPLE_FORMAT, (1,))[0] == 3 else 'u'}{f[BITS][0] // 8}")
    tiled = TILES in f
    th, tw = (f[TILE_HEIGHT][0], f[TILE_WIDTH][0]) if tiled else (min(f.get(ROWS, (h,))[0], h), w)
    return Layout(n, h, w, th, tw, 1 if planar else n, kind, packed != 1, predicted == 2, f[TILES if tiled else STRIPS], f[TILE_BYTES if tiled else STRIP_BYTES])


def bands(data: bytes) -> np.ndarray:
    """All pixels (bands, h, w)."""
    x = layout(data)
    out = np.zeros((x.n, x.down * x.th, x.across * x.tw), x.kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(x.places, x.sizes, strict=True)):
        group, place = divmod(k, x.down * x.across)
        r, c = divmod(place, x.across)
        out[group * x.per : (group + 1) * x.per, r * x.th : (r + 1) * x.th, c * x.tw : (c + 1) * x.tw] = x.block(data[at : at + size])
    return out[:, : x.h, : x.w]


def encode(px: np.ndarray, x0: float, y0: float, dx: float, dy: float, epsg: int, names: list[str]) -> bytes:
    """A file with one deflated strip of horizontal differences for each band of unsigned integers (bands, h, w)."""
    n, h, w = px.shape
    px = np.ascontiguousarray(px).astype(px.dtype.newbyteorder("<"))
    strips = [zlib.compress(np.diff(b, axis=1, prepend=np.zeros((h, 1), b.dtype)).astype(b.dtype).tobytes()) for b in px]
    text = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{x}</Item>' for i, x in enumerate(names))
    about = f"<GDALMetadata>{text}</GDALMetadata>".encode() + b"\0"
    own = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (px.dtype.itemsize * 8,) * n), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (STRIPS, 4, None), (SAMPLES, 3, (n,)), (ROWS, 4, (h,)), (STRIP_BYTES, 4, tuple(map(len, strips))),
        (PLANAR, 3, (2,)), (PREDICTOR, 3, (2,)), (SAMPLE_FORMAT, 3, (1,) * n), (SCALE, 12, (dx, abs(dy), 0.0)), (TIE, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)), (KEYS, 3, (1, 1, 0, 1, EPSG_KEY, 0, 1, epsg)), (DESCRIPTIONS, 2, about),
    ]
    start, at = 8 + 2 + 12 * len(own) + 4, 0
    size = {tag: len(v) if kind == 2 else _SIZES[kind][1] * (n if v is None else len(v)) for tag, kind, v in own}
    first = start + sum((x + 1) // 2 * 2 for x in size.values() if x > 4)
    places = np.cumsum([first, *map(len, strips)])[:-1].tolist()
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(own)), b""
    for tag, kind, v in own:
        v = tuple(places) if v is None else v
        body = v if kind == 2 else struct.pack(f"<{len(v)}{_SIZES[kind][0]}", *v)
        head += struct.pack("<HHI", tag, kind, len(v))
        if len(body) > 4:
            head += struct.pack("<I", start + len(tail))
            tail += body + b"\0" * (len(body) % 2)
        else:
            head += body.ljust(4, b"\0")
    return head + b"\0" * 4 + tail + b"".join(strips)


def read(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, bands, h, w, epsg, x0, y0, dx, dy, px) of files: px has all bands, row by row, one after the other; a bad file's are null.

    A file is a row. Taken without px, it is the catalog of what the files cover.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def tried(fn, data: bytes):
        try:
            return fn(data)
        except (ValueError, KeyError, struct.error, zlib.error, IndexError):
            return None

    @F.arrow_udf(HEADER)
    def heads(content: pa.Array) -> pa.Array:
        return pa.array([tried(header, c.as_py()) for c in content], _HEADER)

    @F.arrow_udf("array<double>")
    def pixels(content: pa.Array) -> pa.Array:
        made = (tried(bands, c.as_py()) for c in content)
        return pa.array([None if m is None else m.astype(float).ravel() for m in made], pa.list_(pa.float64()))

    return files.select("path", heads("content").alias("head"), pixels("content").alias("px")).select("path", "head.*", "px")


def footprint(catalog: DataFrame) -> DataFrame:
    """The catalog with xmin, ymin, xmax, ymax of each file in its own coordinates; files without a header are left out."""
    right, low = F.col("x0") + F.col("w") * F.col("dx"), F.col("y0") + F.col("h") * F.col("dy")
    return catalog.where("w IS NOT NULL").withColumns({"xmin": F.least("x0", right), "xmax": F.greatest("x0", right), "ymin": F.least("y0", low), "ymax": F.greatest("y0", low)})


def windows(files: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """(id, band, row, col, value): pixels of boxes (id, xmin, ymin, xmax, ymax) cut from files, all on one grid.

    Rows and columns count from the box's upper left pixel. Where files overlap, the first by path that isn't 0 counts;
    what no file covers is 0. Files and boxes meet by cells of size, about that of a file; boxes that meet no file are left out.
    """
    f = footprint(files)
    pairs = spatial.box_pairs(boxes.select("id", "xmin", "ymin", "xmax", "ymax"), f.select(F.col("path").alias("id"), "xmin", "ymin", "xmax", "ymax"), size)
    b = boxes.select(F.col("id"), *(F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    near = pairs.join(b, F.col("left_id") == F.col("id")).join(f, F.col("right_id") == F.col("path"))
    cut = lambda c, o, d: F.floor(F.round((F.col(c) - F.col(o)) / F.col(d), 9)).cast("int")
    at = near.withColumns({"r0": cut("b_ymax", "y0", "dy"), "c0": cut("b_xmin", "x0", "dx"), "r1": F.ceil(F.round((F.col("b_ymin") - F.col("y0")) / F.col("dy"), 9)).cast("int") - 1, "c1": F.ceil(F.round((F.col("b_xmax") - F.col("x0")) / F.col("dx"), 9)).cast("int") - 1})
    held = at.withColumn("r", F.explode(F.sequence(F.greatest("r0", F.lit(0)), F.least("r1", F.col("h") - 1)))).withColumn("c", F.explode(F.sequence(F.greatest("c0", F.lit(0)), F.least("c1", F.col("w") - 1)))).withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    value = F.get(F.col("px"), ((F.col("band") * F.col("h") + F.col("r")) * F.col("w") + F.col("c")).cast("int"))
    cells = held.select("id", "band", (F.col("r") - F.col("r0")).alias("row"), (F.col("c") - F.col("c0")).alias("col"), value.alias("value"), "path")
    first = raster.mosaic_first(cells, ["id", "band", "row", "col"], "path")
    shape = at.groupBy("id").agg(F.max("bands").alias("n"), F.first(F.col("r1") - F.col("r0")).alias("rows"), F.first(F.col("c1") - F.col("c0")).alias("cols"))
    every = shape.select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("band"), "rows", "cols").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows")))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols"))))
    return every.join(first, ["id", "band", "row", "col"], "left").select("id", "band", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def _opened(path: str) -> pa.NativeFile:
    """A file that can be read at any place, by its URI or local path."""
    system, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return system.open_input_file(name)


def catalog(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, bands, h, w, epsg, x0, y0, dx, dy, th, tw, per, blocks) of files, of which only the header is read.

    blocks: (at, size) of each strip or tile. A file that can't be read has nulls. Files can be of any size that the format's
    32-bit places allow, and are opened by each task itself, by any URI that pyarrow's file systems know.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    out = pa.schema([("path", pa.string()), *((f.name, f.type) for f in _HEADER), ("th", pa.int32()), ("tw", pa.int32()), ("per", pa.int32()), ("blocks", pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])))])

    def one(path: str) -> dict:
        try:
            with _opened(path) as f:
                read = lambda at, n: f.read_at(n, at)
                x = layout(read)
                return {"path": path, **header(read), "th": x.th, "tw": x.tw, "per": x.per, "blocks": [{"at": a, "size": n} for a, n in zip(x.places, x.sizes, strict=True)]}
        except (ValueError, KeyError, struct.error, IndexError):
            return {"path": path}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([one(p)], schema=out)

    return files.mapInArrow(batches, f"path string, {HEADER}, th int, tw int, per int, blocks array<struct<at: long, size: long>>")


def read_blocks(wanted: DataFrame) -> DataFrame:
    """(path, k, size, px) of blocks (path, k, at, size): the bytes of each are read where they lie and unpacked; px is (per, th, tw) row by row.

    Blocks of a file that are near each other go to one task, which opens the file once.
    """
    out = pa.schema([("path", pa.string()), ("k", pa.int64()), ("size", pa.int64()), ("px", pa.list_(pa.float64()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, x = None, None, None
        for b in it:
            for r in b.to_pylist():
                if r["path"] != path:
                    if f is not None:
                        f.close()
                    path, f = r["path"], _opened(r["path"])
                    x = layout(lambda at, n, f=f: f.read_at(n, at))
                px = x.block(f.read_at(r["size"], r["at"])).astype(float).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([r["k"]], pa.int64()), pa.array([r["size"]], pa.int64()), pa.array([px], out.field("px").type)], schema=out)
        if f is not None:
            f.close()

    near = wanted.select("path", "k", "at", "size").withColumn("near", F.floor(F.col("k") / 64))
    return near.repartition("path", "near").sortWithinPartitions("path", "k").drop("near").mapInArrow(batches, "path string, k long, size long, px array<double>")


def ranged_windows(files: DataFrame, boxes: DataFrame, size: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, uncovered, blocks): as windows, but from a catalog, reading only the blocks that boxes touch.

    cells: (id, band, row, col, value); uncovered: ids of boxes that no file covers anywhere, which have no cells; blocks:
    (path, k, size) that were read. A null header is passed over.
    """
    f = footprint(files)
    met = spatial.box_pairs(boxes.select("id", *regions.EDGES), f.select(F.col("path").alias("id"), *regions.EDGES), size).select("left_id", "right_id")
    b = boxes.select(F.col("id"), *(F.col(c).alias(f"b_{c}") for c in regions.EDGES))
    near = met.join(b, F.col("left_id") == F.col("id")).join(f.drop(*regions.EDGES), F.col("right_id") == F.col("path"))
    place = lambda c, o, d: F.round((F.col(c) - F.col(o)) / F.col(d), 9)
    at = near.withColumns({"r0": F.floor(place("b_ymax", "y0", "dy")).cast("int"), "c0": F.floor(place("b_xmin", "x0", "dx")).cast("int"), "r1": F.ceil(place("b_ymin", "y0", "dy")).cast("int") - 1, "c1": F.ceil(place("b_xmax", "x0", "dx")).cast("int") - 1})
    at = materialize(at.drop("left_id", "right_id", *(f"b_{c}" for c in regions.EDGES)), "met")
    span = lambda lo, hi, most, step: F.sequence(F.floor(F.greatest(lo, F.lit(0)) / F.col(step)), F.floor(F.least(F.col(hi), F.col(most) - 1) / F.col(step)))
    across, down = F.ceil(F.col("w") / F.col("tw")), F.ceil(F.col("h") / F.col("th"))
    parts = at.withColumn("br", F.explode(span("r0", "r1", "h", "th"))).withColumn("bc", F.explode(span("c0", "c1", "w", "tw"))).withColumn("group", F.explode(F.sequence(F.lit(0), (F.col("bands") / F.col("per")).cast("int") - 1)))
    parts = parts.withColumn("k", F.col("group") * across * down + F.col("br") * across + F.col("bc"))
    block = F.get("blocks", F.col("k").cast("int"))
    wanted = parts.select("path", "k", block["at"].alias("at"), block["size"].alias("size")).distinct()
    read = materialize(read_blocks(wanted), "blocks")
    got = parts.drop("blocks").join(read.select("path", "k", "px"), ["path", "k"])
    row = F.explode(F.sequence(F.greatest(F.col("r0"), (F.col("br") * F.col("th")).cast("int")), F.least(F.col("r1"), F.col("h") - 1, ((F.col("br") + 1) * F.col("th") - 1).cast("int"))))
    col = F.explode(F.sequence(F.greatest(F.col("c0"), (F.col("bc") * F.col("tw")).cast("int")), F.least(F.col("c1"), F.col("w") - 1, ((F.col("bc") + 1) * F.col("tw") - 1).cast("int"))))
    held = got.withColumn("r", row).withColumn("c", col).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("per") - 1)))
    value = F.get("px", ((F.col("i") * F.col("th") + F.col("r") - F.col("br") * F.col("th")) * F.col("tw") + F.col("c") - F.col("bc") * F.col("tw")).cast("int"))
    cells = held.select("id", (F.col("group") * F.col("per") + F.col("i")).cast("int").alias("band"), (F.col("r") - F.col("r0")).alias("row"), (F.col("c") - F.col("c0")).alias("col"), value.alias("value"), "path")
    first = raster.mosaic_first(cells, ["id", "band", "row", "col"], "path")
    shape = at.groupBy("id").agg(F.max("bands").alias("n"), F.first(F.col("r1") - F.col("r0")).alias("rows"), F.first(F.col("c1") - F.col("c0")).alias("cols"))
    every = shape.select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("band"), "rows", "cols").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows")))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols"))))
    out = every.join(first, ["id", "band", "row", "col"], "left").select("id", "band", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
    return out, boxes.select("id").join(at.select(F.col("id").alias("i_")), F.col("id") == F.col("i_"), "left_anti"), read.select("path", "k", "size")


def located(files: DataFrame) -> DataFrame:
    """The catalog with lon_min, lat_min, lon_max, lat_max of each file: a UTM zone's, or, in EPSG 4326, its own; null for other systems."""
    f = footprint(files)
    zone, south = F.col("epsg") % 100, F.col("epsg") >= 32700
    utm = F.when(F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760), geo.utm_bounds(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), zone, south))
    own = F.struct("xmin", "ymin", "xmax", "ymax")
    return f.withColumn("__b", F.when(F.col("epsg") == 4326, own).otherwise(utm)).select(*f.columns, *(F.col(f"__b.{a}{m}").alias(f"{n}_{m}") for n, a in (("lon", "x"), ("lat", "y")) for m in ("min", "max")))


def encoded(tiles: DataFrame, names: list[str]) -> Column:
    """A column with each tile (bands, h, w, epsg, x0, y0, dx, dy, px of unsigned 16-bit numbers) as a file."""

    @F.arrow_udf("binary")
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([encode(np.array(px, np.uint16).reshape(n, h, w), x0, y0, dx, dy, epsg, names) for n, h, w, epsg, x0, y0, dx, dy, px in rows], pa.binary())

    return run(*(tiles[c] for c in ("bands", "h", "w", "epsg", "x0", "y0", "dx", "dy", "px")))
