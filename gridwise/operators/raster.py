"""Raster tiles as arrays (id, h, w, px in rows from the top) and pixel stacks as rows.

Per-pixel work is column expressions and grouping; work on a pixel's surroundings runs over whole tiles in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.functions import scores
from gridwise.operators import selection
from gridwise.operators.graph import components
from gridwise.session import materialize

#: Scene classes that show clear ground.
CLEAR = (4, 5, 6, 7)


def median_composite(obs: DataFrame, keys: list[str], value: str = "value", day: str = "obs_date", order: str = "ts", clear: Column | None = None) -> DataFrame:
    """(keys, composite, n_days): the median over days of the first clear observation of each day, cut to an integer; 0 without any.

    Null values and observations that aren't clear don't count.
    """
    ok = F.col(value).isNotNull() & (clear if clear is not None else F.lit(True))
    per_day = obs.groupBy(*keys, day).agg(F.min_by(F.when(ok, F.col(value)), F.when(ok, F.struct(order, value))).alias("v"))
    return per_day.groupBy(*keys).agg(F.coalesce(F.floor(F.median("v")), F.lit(0)).cast("int").alias("composite"), F.count("v").alias("n_days"))


def spread(tiles: DataFrame) -> DataFrame:
    """tiles dealt by id over as many tasks as a shuffle has: little data and much work, and a file's row group is one task's."""
    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def pixels(tiles: DataFrame) -> DataFrame:
    """(id, row, col, p), a row a pixel."""
    return tiles.select("id", "w", F.posexplode("px").alias("k", "p")).select("id", F.floor(F.col("k") / F.col("w")).cast("int").alias("row"), (F.col("k") % F.col("w")).alias("col"), "p")


def window_starts(size: Column, window: int, stride: int) -> Column:
    """Where windows start so that they cover size: every stride, and one at the end; 0 alone if one is enough."""
    last = size - window
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last))))


def overlap_add(windows: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """(keys, row, col, p): the mean of overlapping windows' pixels, weighted by a raised cosine that falls off to the windows' edges.

    windows: keys, row0, col0, row, col, p (row and col inside the window). Pixels without a window's value don't come out.
    """
    hann = lambda i: (F.lit(1.0) - F.cos(i * (2 * np.pi / (size - 1)))) * 0.5
    weight = hann(F.col("row")) * hann(F.col("col")) + 1e-3
    at = windows.where("p IS NOT NULL").select(*keys, (F.col("row0") + F.col("row")).alias("row"), (F.col("col0") + F.col("col")).alias("col"), (F.col("p") * weight).alias("pw"), weight.alias("wt"))
    return at.groupBy(*keys, "row", "col").agg((F.sum("pw") / F.sum("wt")).alias("p"))


def _tilewise(fn: Callable[[np.ndarray], np.ndarray], kind: str, type_: pa.DataType) -> Callable[..., Column]:
    @F.arrow_udf(kind)
    def run(px: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        made = [None if not p.is_valid else fn(p.values.to_numpy(zero_copy_only=False).astype(float).reshape(a, b)).ravel() for p, a, b in zip(px, h.to_pylist(), w.to_pylist(), strict=True)]
        ends = np.cumsum([0, *(0 if m is None else len(m) for m in made)]).astype(np.int32)
        values = np.concatenate([np.empty(0), *(m for m in made if m is not None)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(type_.value_type.to_pandas_dtype())), mask=px.is_null())

    return run


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over size x size pixels around each, the tile mirrored at its edges (edge pixels twice)."""
    r = size // 2
    s = np.pad(np.pad(x, r, mode="symmetric").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def contrast(tiles: DataFrame, size: int, least: float = 0.3, missing: float = -99.0) -> DataFrame:
    """tiles with contrast: each pixel less the mean of the valid ones around it; ``missing`` where it or most of them are 0."""

    def one(x: np.ndarray) -> np.ndarray:
        ok = (x != 0).astype(float)
        share = box_mean(ok, size)
        with np.errstate(invalid="ignore", divide="ignore"):
            c = x - box_mean(x, size) / share
        return np.where((ok > 0) & (share > least), c, missing)

    return tiles.withColumn("contrast", _tilewise(one, "array<double>", pa.list_(pa.float64()))("px", "h", "w"))


def local_maxima(tiles: DataFrame, threshold: float) -> DataFrame:
    """(id, row, col, p) of pixels of at least threshold that no neighbour exceeds; equal neighbours all come out."""

    def one(x: np.ndarray) -> np.ndarray:
        edge = np.pad(x, 1, constant_values=-np.inf)
        top = np.lib.stride_tricks.sliding_window_view(edge, (3, 3)).max(axis=(2, 3))
        return np.where((x == top) & (x >= threshold), x, np.nan)

    peaks = tiles.withColumn("px", _tilewise(one, "array<double>", pa.list_(pa.float64()))("px", "h", "w"))
    return pixels(peaks).where(~F.isnan("p"))


def label(grow: np.ndarray, diagonal: bool) -> np.ndarray:
    """Component of each true pixel as the smallest pixel number in it, -1 elsewhere: labels sink to the least of their neighbours."""
    h, w = grow.shape
    top = h * w
    lab = np.where(grow, np.arange(top).reshape(h, w), top)
    around = [(0, 1), (1, 0), (1, 1), (1, -1)] if diagonal else [(0, 1), (1, 0)]
    while True:
        now = lab.copy()
        for dy, dx in around:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
            low = np.where(grow[a] & grow[b], np.minimum(now[a], now[b]), top)
            now[a] = np.minimum(now[a], low)
            now[b] = np.minimum(now[b], low)
        # Follow labels to their own label, so that long shapes need few rounds.
        now = np.where(grow, np.append(now.ravel(), top)[now], top)
        if np.array_equal(now, lab):
            return np.where(grow, lab, -1)
        lab = now


def hysteresis_pixels(tiles: DataFrame, low: float, high: float | None = None, diagonal: bool = False) -> DataFrame:
    """(id, label, row, col, p) of pixels of at least low, labelled by component in their tile.

    With high, components without such a pixel are left out (do that after merging where tiles adjoin).
    """

    def one(x: np.ndarray) -> np.ndarray:
        lab = label(x >= low, diagonal)
        if high is not None:
            lab = np.where(np.isin(lab, lab[x >= high]), lab, -1)
        return lab

    out = tiles.withColumn("labels", _tilewise(one, "array<int>", pa.list_(pa.int32()))("px", "h", "w"))
    cells = out.select("id", "w", F.posexplode(F.arrays_zip("labels", "px")).alias("k", "z")).where("z.labels >= 0")
    return cells.select("id", F.col("z.labels").alias("label"), F.floor(F.col("k") / F.col("w")).cast("int").alias("row"), (F.col("k") % F.col("w")).alias("col"), F.col("z.px").alias("p"))


def component_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pixels, conf_max, conf_mean, conf_p90): conf_p90 is the mean of the values from the 0.9 quantile up."""
    made = selection.with_top_mean(cells, keys, "p", 0.9)
    return made.select(*keys, F.col("n").alias("n_pixels"), F.col("most").alias("conf_max"), F.col("mean").alias("conf_mean"), F.col("top").alias("conf_p90"))


def hysteresis(tiles: DataFrame, low: float = 0.2, high: float = 0.4, diagonal: bool = False) -> DataFrame:
    """Components (id, label, statistics) of single tiles: pixels of at least low that hang together and reach high somewhere."""
    return component_stats(hysteresis_pixels(tiles, low, high, diagonal), ["id", "label"])


def mosaic_labels(tiles: DataFrame, low: float) -> tuple[DataFrame, DataFrame]:
    """(tiles with labels, (node, root)) of adjoining tiles (id, tx, ty, h, w, px), all of one size.

    Tiles are labelled by themselves; a node is a tile's number and label as one number. Labels that touch across a border
    are linked, and links are followed over the whole mosaic: root is the smallest node; nodes without links aren't listed.
    """
    labelled = tiles.withColumn("labels", _tilewise(lambda x: label(x >= low, False), "array<int>", pa.list_(pa.int32()))("px", "h", "w"))
    labelled = materialize(labelled.select("id", "tx", "ty", "h", "w", "px", "labels"), "labelled")
    # Only the rims of tiles are shuffled.
    k = F.posexplode("labels").alias("k", "label")
    row, col = F.floor(F.col("k") / F.col("w")), F.col("k") % F.col("w")
    rim = labelled.select("id", "tx", "ty", "h", "w", k).where((F.col("label") >= 0) & ((row == 0) | (row == F.col("h") - 1) | (col == 0) | (col == F.col("w") - 1)))
    rim = rim.select(mosaic_node("label").alias("node"), (F.col("ty") * F.col("h") + row).alias("y"), (F.col("tx") * F.col("w") + col).alias("x"))
    step = F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx"))))
    beyond = rim.withColumn("s", step).select(F.col("node").alias("a"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = beyond.join(rim.withColumnRenamed("node", "b"), ["y", "x"]).where("a != b").select("a", "b")
    return labelled, components(links)


def mosaic_node(label_col: str) -> Column:
    return F.col("id") * (F.col("h") * F.col("w")).cast("long") + F.col(label_col)


def mosaic_components(tiles: DataFrame, low: float = 0.2, high: float = 0.4) -> DataFrame:
    """Components across the borders of adjoining tiles (id, tx, ty, h, w, px), all of one size, that reach high somewhere.

    Returns component (its smallest tile number and label as one number), and the statistics.
    """
    labelled, roots = mosaic_labels(tiles, low)
    at = labelled.select("id", "h", "w", F.explode(F.arrays_zip("labels", "px")).alias("z")).where("z.labels >= 0").withColumn("label", F.col("z.labels"))
    at = at.select(mosaic_node("label").alias("node"), F.col("z.px").alias("p"))
    whole = at.join(roots.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").select(F.coalesce("root", "node").alias("component"), "p")
    return component_stats(whole, ["component"]).where(F.col("conf_max") >= high)


def warped(tiles: DataFrame, grid: DataFrame, to_source: Callable[[Column, Column], tuple[Column, Column]], size: tuple[int, int], how: str = "bilinear") -> DataFrame:
    """(block, row, col, value): a mosaic brought to another grid, each target pixel from where its centre lies in the source.

    tiles: (tx, ty, px), all of size (h, w); a source pixel is one unit, tile (0, 0) starts at the origin. grid: (block, x0,
    y0, step, h, w), blocks of the target with their upper left corner and pixel size in the target's coordinates; to_source
    turns those into the source's. how: nearest, or bilinear, where pixels that are 0 or not there don't count and the
    others' weights are made up to one. Without any, the value is 0. What a block wants from a tile goes to the tile as one
    row, so each pixel of the source moves only with its tile.
    """
    th, tw = size
    rows = F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row")
    at = grid.select("block", "x0", "y0", "step", "w", rows).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    x, y = to_source(F.col("x0") + (F.col("col") + 0.5) * F.col("step"), F.col("y0") + (F.col("row") + 0.5) * F.col("step"))
    at = at.select("block", "row", "col", x.alias("x"), y.alias("y"))
    if how == "nearest":
        wanted = at.select("block", "row", "col", F.floor("x").alias("sx"), F.floor("y").alias("sy"), F.lit(1.0).alias("weight"))
    else:
        fx, fy = F.col("x") - 0.5, F.col("y") - 0.5
        a, b = fx - F.floor(fx), fy - F.floor(fy)
        corner = lambda dx, dy: F.struct((F.floor(fx) + dx).alias("sx"), (F.floor(fy) + dy).alias("sy"), ((a if dx else 1 - a) * (b if dy else 1 - b)).alias("weight"))
        wanted = at.select("block", "row", "col", F.explode(F.array(*(corner(dx, dy) for dx in (0, 1) for dy in (0, 1)))).alias("c")).select("block", "row", "col", "c.*").where("weight > 0")
    place = (F.pmod("sy", F.lit(th)) * tw + F.pmod("sx", F.lit(tw))).cast("int")
    asked = wanted.groupBy("block", F.floor(F.col("sx") / tw).alias("tx"), F.floor(F.col("sy") / th).alias("ty")).agg(F.collect_list(F.struct("row", "col", "weight", place.alias("place"))).alias("asked"))
    met = asked.hint("merge").join(tiles.select("tx", "ty", "px"), ["tx", "ty"])
    got = met.select("block", F.explode(F.transform("asked", lambda q: F.struct(q["row"].alias("row"), q["col"].alias("col"), q["weight"].alias("weight"), F.get("px", q["place"]).alias("p")))).alias("g")).select("block", "g.*")
    got = got.where("p IS NOT NULL AND p <> 0").groupBy("block", "row", "col").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("value"))
    return at.select("block", "row", "col").hint("merge").join(got, ["block", "row", "col"], "left").select("block", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def zonal(cells: DataFrame, zones: list[str], value: str = "p") -> DataFrame:
    """(zones, n, mean, std) of the pixels of each zone; std is the population's."""
    return cells.groupBy(*zones).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def mosaic_first(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, value): where tiles overlap, the first by order that isn't nodata (0)."""
    return cells.where("value IS NOT NULL AND value != 0").groupBy(*keys).agg(F.min_by("value", order).alias("value"))


def burn(shapes: DataFrame, grid: DataFrame) -> DataFrame:
    """(id, row, col, value) of boxes burned into a grid's pixels: 1 over -1 over 0.

    shapes: row0, col0, row1, col1 (touched pixels, inclusive), value 1 or -1; grid: id, h, w.
    """
    touched = shapes.select("id", "value", F.explode(F.sequence("row0", "row1")).alias("row"), "col0", "col1").select("id", "value", "row", F.explode(F.sequence("col0", "col1")).alias("col"))
    best = touched.groupBy("id", "row", "col").agg(F.max("value").alias("value"))
    every = grid.select("id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"), "w").select("id", "row", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col"))
    return every.join(best, ["id", "row", "col"], "left").select("id", "row", "col", F.coalesce("value", F.lit(0)).alias("value"))


def radar_composite(obs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, dn, n): the median of the positive powers as encoded decibels, 0 without any; n counts them."""
    v = F.when(F.col(value) > 0, F.col(value))
    m = obs.groupBy(*keys).agg(F.median(v).alias("__m"), F.count(v).alias("n"))
    return m.select(*keys, scores.encode_db(F.coalesce("__m", F.lit(0.0))).alias("dn"), "n")


def with_offset(obs: DataFrame, offsets: DataFrame, day: str = "obs_date", value: str = "value", default: float = 1000.0) -> DataFrame:
    """obs with its day's offset (day, offset) added to value; the default for a day that offsets lacks."""
    known = offsets.select(F.col("day").alias("__day"), F.col("offset").alias("__offset"))
    return obs.join(known, F.col(day) == F.col("__day"), "left").withColumn(value, F.col(value) + F.coalesce("__offset", F.lit(default))).drop("__day", "__offset")


def sampled_db(samples: DataFrame, keys: list[str], scene: str, least: int = 4, scenes: int = 2, order: str | None = None, value: str = "value") -> DataFrame:
    """(keys, db, n_scenes): of each scene the mean positive power in decibels, if it has so many pixels; the median over the first scenes."""
    ok = F.when(F.col(value) > 0, F.col(value))
    per = samples.groupBy(*keys, scene).agg(F.count(ok).alias("__n"), (10 * F.log10(F.avg(ok))).alias("__db"), F.min(order or scene).alias("__o")).where(F.col("__n") >= least)
    first = F.slice(F.array_sort(F.collect_list(F.struct("__o", F.col(scene).alias("s"), "__db"))), 1, scenes)
    got = per.groupBy(*keys).agg(first.alias("__first"))
    dbs = F.array_sort(F.transform("__first", lambda x: x["__db"]))
    n = F.size("__first")
    return got.select(*keys, ((F.element_at(dbs, F.floor((n + 1) / 2).cast("int")) + F.element_at(dbs, F.floor(n / 2 + 1).cast("int"))) / 2).alias("db"), n.alias("n_scenes"))


def around(points: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """(point_id, n, mean, most, least) of the pixels (id, row, col, p) up to reach rows and columns from points (point_id, id, row, col)."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    near = points.select("point_id", "id", "row", "col").withColumn("row", F.explode(F.transform(step, lambda d: F.col("row") + d))).withColumn("col", F.explode(F.transform(step, lambda d: F.col("col") + d)))
    return near.join(cells, ["id", "row", "col"]).groupBy("point_id").agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.max("p").alias("most"), F.min("p").alias("least"))


def _picked(tiles: DataFrame, h: Column, w: Column, source: Callable[[int, int], np.ndarray]) -> DataFrame:
    """tiles of a new shape whose pixel k is the old pixel number source(old h, old w)[k], or 0 where that is below 0 or null."""

    @F.arrow_udf("array<double>")
    def run(px: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        made, places = [], {}
        for p, size in zip(px, zip(h.to_pylist(), w.to_pylist(), strict=True), strict=True):
            if None in size:
                made.append(None)
                continue
            if size not in places:
                places[size] = source(*size)
            # One more value, 0, for what isn't there.
            old = np.append(np.nan_to_num(p.values.to_numpy(zero_copy_only=False).astype(float), nan=np.nan if not p.values.null_count else 0.0) if p.is_valid else [], 0.0)
            k = places[size]
            made.append(old[np.where((k < 0) | (k >= len(old) - 1), len(old) - 1, k)])
        ends = np.cumsum([0, *(0 if m is None else len(m) for m in made)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0), *(m for m in made if m is not None)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([m is None for m in made]))

    return tiles.withColumns({"px": run(F.col("px").cast("array<double>"), "h", "w"), "h": h, "w": w})


def fitted(tiles: DataFrame, size: int) -> DataFrame:
    """tiles cut to size x size around their middle, or filled up with 0 below and to the right."""

    def source(h: int, w: int) -> np.ndarray:
        r, c = (np.arange(size) + max((n - size) // 2, 0) for n in (h, w))
        return np.where((r[:, None] < h) & (c[None, :] < w), r[:, None] * w + c[None, :], -1).ravel()

    return _picked(tiles, F.lit(size), F.lit(size), source)


def turned(tiles: DataFrame, quarters: int, mirrored: bool = False) -> DataFrame:
    """tiles turned counter-clockwise by so many quarters, then mirrored left to right if asked for."""

    def source(h: int, w: int) -> np.ndarray:
        k = np.rot90(np.arange(h * w).reshape(h, w), quarters)
        return (k[:, ::-1] if mirrored else k).ravel()

    odd = quarters % 2
    return _picked(tiles, F.col("w" if odd else "h"), F.col("h" if odd else "w"), source)


def _kernel(x: np.ndarray, mode: str) -> np.ndarray:
    x = np.abs(x)
    if mode == "bilinear":
        return np.maximum(0.0, 1 - x)
    a = -0.75
    return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0.0))


def weights(n: int, m: int, mode: str) -> np.ndarray:
    """How much each of n pixels counts in each of m that cover the same length; pixels beyond an edge count as the edge's."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    if mode == "nearest":
        return np.eye(n)[np.minimum((np.arange(m) * n) // m, n - 1)]
    out, low = np.zeros((m, n)), np.floor(at).astype(int)
    for d in range(-1, 3):
        np.add.at(out, (np.arange(m), np.clip(low + d, 0, n - 1)), _kernel(at - (low + d), mode))
    return out


def resampled(tiles: DataFrame, h: int, w: int, mode: str = "bilinear") -> DataFrame:
    """tiles of another size: nearest, bilinear or bicubic."""
    made = _tilewise(lambda x: weights(x.shape[0], h, mode) @ x @ weights(x.shape[1], w, mode).T, "array<double>", pa.list_(pa.float64()))("px", "h", "w")
    return tiles.withColumns({"px": made, "h": F.lit(h), "w": F.lit(w)})


def map_of(row: Column, col: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Place of a pixel's centre: x = a col + b row + c, y = d col + e row + f, from the pixel's corner moved by a half."""
    a, b, c, d, e, f = affine
    return (col + 0.5) * a + (row + 0.5) * b + c, (col + 0.5) * d + (row + 0.5) * e + f


def pixel_of(x: Column, y: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a place."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return F.floor(((y - f) * a - (x - c) * d) / det).cast("int"), F.floor(((x - c) * e - (y - f) * b) / det).cast("int")
