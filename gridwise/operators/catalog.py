"""Scenes for areas from a table of catalog items, and data sets of image stacks and masks brought to chips."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwise.functions import geo, grid
from gridwise.operators import regions, spatial
from gridwise.session import materialize

#: Cloud cover of scenes whose cover is unknown.
UNKNOWN_CLOUD = 100.0
#: How file names hold a place.
PLACE = r"lat_(-?[0-9.]+)_lon_(-?[0-9.]+)\.npz$"


def _contenders(areas: DataFrame, items: DataFrame, size: float, most: int, keys: list[str]) -> DataFrame:
    """(left_id, right_id) of boxes that meet, each pair once: at least the first ``most`` by keys and id of each area's."""
    at = regions._cells(items, "right", size, keys)
    x, y = F.col("cx") * size, F.col("cy") * size
    covers = (F.col("right_xmin") <= x) & (F.col("right_xmax") >= x + size) & (F.col("right_ymin") <= y) & (F.col("right_ymax") >= y + size)
    place = F.struct(*keys, "right_id")
    n = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(*keys, "right_id"))
    # One row a cell: the last scene that counts there.
    last = at.where(covers).withColumn("n", n).where(F.col("n") == most).select("cx", "cy", place.alias("last"))
    kept = at.join(materialize(last, "last"), ["cx", "cy"], "left").where(F.col("last").isNull() | (place <= F.col("last"))).drop("last", *keys)
    meet = (F.col("left_xmin") <= F.col("right_xmax")) & (F.col("right_xmin") <= F.col("left_xmax")) & (F.col("left_ymin") <= F.col("right_ymax")) & (F.col("right_ymin") <= F.col("left_ymax"))
    return spatial._met(regions._cells(areas, "left", size), materialize(kept, "kept")).where(meet).select("left_id", "right_id").distinct()


def searched(areas: DataFrame, items: DataFrame, size: float, window: tuple[str, str] | None = None, below: float | None = None, most: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """(area, n, item's columns): each area's scenes, numbered from 1 in their order, at most so many.

    areas: id, xmin, ymin, xmax, ymax; a point is a box of no size. items: id, day, cloud, xmin, ymin, xmax, ymax and more.
    A scene is an area's if their boxes share a point, its day is in the window (both ends included) and its cloud cover
    is less than ``below``; with that limit, scenes of unknown cover don't count. order: of the items' columns; without
    any by cloud cover, an unknown one as UNKNOWN_CLOUD, then by id. The last tie is always the id. size: of the cells in
    which boxes meet. Boxes with nulls meet nothing. Days and clouds are looked at before boxes meet, and only the best
    scenes fetch their columns. With ``most``, boxes meet in cells a quarter as long: scenes that cover a cell are all of
    any area that touches it, so what comes after so many of them can't be among the area's best and isn't met there.
    """
    if window is not None:
        items = items.where(F.col("day").between(*(F.lit(d).cast("date") for d in window)))
    if below is not None:
        items = items.where(F.col("cloud") < below)
    order = [F.coalesce("cloud", F.lit(UNKNOWN_CLOUD))] if order is None else order
    whole = lambda df: df.dropna(subset=["id", *regions.EDGES])
    keys = [f"__k{i}" for i in range(len(order))]
    if most is None:
        met = regions.pairs(whole(areas), whole(items), size)
    else:
        met = _contenders(whole(areas), whole(items).select("id", *regions.EDGES, *(c.alias(k) for c, k in zip(order, keys, strict=True))), size / 4, most, keys)
    ranked = met.hint("merge").join(items.select("id", *(c.alias(k) for c, k in zip(order, keys, strict=True))), F.col("right_id") == F.col("id"))
    n = F.row_number().over(Window.partitionBy("left_id").orderBy(*keys, "right_id"))
    best = ranked.select(F.col("left_id").alias("area"), F.col("right_id").alias("__item"), n.alias("n"))
    best = best if most is None else best.where(F.col("n") <= most)
    return best.hint("merge").join(items, F.col("__item") == F.col("id")).select("area", "n", *items.columns)


def file_of(path: Column) -> Column:
    """(folder, name, stem, suffix) of a path; a name without a dot, or with its only one in front, has an empty suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.struct(folder.alias("folder"), name.alias("name"), stem.alias("stem"), suffix.alias("suffix"))


def paired(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with their masks, images without one): by the files' names, whatever their folders.

    The masks' columns come along as mask_<name>. Of masks with the same name that with the smallest path counts.
    """
    own = masks.select(file_of(F.col("path"))["name"].alias("__name"), *(F.col(c).alias(f"mask_{c}") for c in masks.columns)).where("mask_path IS NOT NULL")
    one = own.groupBy("__name").agg(F.min("mask_path").alias("__least"))
    own = own.join(one.withColumnRenamed("__name", "__n"), (F.col("__name") == F.col("__n")) & (F.col("mask_path") == F.col("__least"))).dropDuplicates(["__name"]).drop("__n", "__least")
    named = images.withColumn("__file", file_of(F.col("path"))["name"])
    return named.join(own, F.col("__file") == F.col("__name")).drop("__file", "__name"), named.join(own.select("__name"), F.col("__file") == F.col("__name"), "left_anti").drop("__file")


def band_places(have: list[str], wanted: list[str]) -> list[int]:
    """Places of the wanted bands among those that there are; an unknown band raises."""
    missing = [b for b in wanted if b not in have]
    if missing:
        raise KeyError(f"unknown bands: {', '.join(missing)}; there are {', '.join(have)}")
    return [have.index(b) for b in wanted]


def bands(values: Column, have: list[str], wanted: list[str]) -> Column:
    """An array with an entry a band, cut to the wanted ones in their order; null for null."""
    return F.when(values.isNotNull(), F.transform(F.array(*map(F.lit, band_places(have, wanted))), lambda i: F.get(values, i)))


def _square(a: np.ndarray, size: int) -> np.ndarray:
    """The middle of the last two axes; what is too small is filled up with zeros at the end."""
    y, x = (max((n - size) // 2, 0) for n in a.shape[-2:])
    a = a[..., y : y + size, x : x + size]
    return np.pad(a, [(0, 0)] * (a.ndim - 2) + [(0, size - n) for n in a.shape[-2:]])


def converted(images: DataFrame, masks: DataFrame, have: list[str], wanted: list[str], size: int, target: int, pixel: float = 10.0, names: str = PLACE) -> tuple[DataFrame, DataFrame]:
    """(chips, (outcome, n)) of image stacks (path, shape (T, C, H, W), px) and masks (path, shape (H, W), px) of the same name.

    chips: chip_id, lon, lat, kind, split, sub_pixels, epsg, x0, y0 (upper left corner in that system), image (the wanted
    bands, median over T, middle square, cut to whole numbers from 0 to 65535) and mask (1 where the class is target, else
    0). All are for training. outcome: converted, unmatched (no mask), unplaced (no place in the name) or unreadable
    (shapes that don't fit). Several images of one place all come out. An image is one row's work.
    """
    both, alone = paired(images.select("path", "shape", "px"), masks.select("path", "shape", "px"))
    name = file_of(F.col("path"))["name"]
    place = lambda i: F.regexp_extract(name, names, i).try_cast("double")
    at = both.select("path", place(1).alias("lat"), place(2).alias("lon"), "shape", "px", "mask_shape", "mask_px")
    places = band_places(have, wanted)

    @F.arrow_udf("struct<image: array<int>, mask: array<int>>")
    def made(shape: pa.Array, px: pa.Array, mask_shape: pa.Array, mask_px: pa.Array) -> pa.Array:
        def one(s: pa.Scalar, p: pa.Scalar, ms: pa.Scalar, mp: pa.Scalar) -> dict | None:
            s, ms = s.as_py() or [], ms.as_py() or []
            if not (p.is_valid and mp.is_valid and len(s) == 4 and len(ms) == 2 and s[0] > 0 and s[1] == len(have) and np.prod(s) == len(p.values) and np.prod(ms) == len(mp.values)):
                return None
            a = p.values.to_numpy(zero_copy_only=False).astype(float).reshape(s)[:, places]
            a = np.nan_to_num(np.clip(_square(np.median(a, axis=0), size), 0, 65535)).astype(np.int32)
            m = _square((mp.values.to_numpy(zero_copy_only=False).astype(float).reshape(ms) == target).astype(np.int32), size)
            return {"image": a.ravel(), "mask": m.ravel()}

        rows = [one(*r) for r in zip(shape, px, mask_shape, mask_px, strict=True)]
        return pa.array(rows, pa.struct([("image", pa.list_(pa.int32())), ("mask", pa.list_(pa.int32()))]))

    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    done = at.withColumn("m", F.when(placed, made("shape", "px", "mask_shape", "mask_px"))).drop("shape", "px", "mask_shape", "mask_px")
    done = done.withColumn("outcome", F.when(~placed, "unplaced").when(F.col("m").isNull(), "unreadable").otherwise("converted"))
    done = materialize(done, "converted")
    n = done.select("outcome").unionByName(alone.select(F.lit("unmatched").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))
    lon, lat = F.col("lon"), F.col("lat")
    xy = geo.utm_xy(lon, lat, geo.utm_zone(lon), lat < 0)
    sub = F.aggregate("m.mask", F.lit(0), lambda s, v: s + v)
    chips = done.where("outcome = 'converted'").select(
        "path", grid.chip_id(lon, lat).alias("chip_id"), "lon", "lat", F.when(sub > 0, "positive").otherwise("background").alias("kind"), F.lit("train").alias("split"), sub.alias("sub_pixels"),
        geo.utm_epsg(lon, lat).alias("epsg"), (xy["x"] - size * pixel / 2).alias("x0"), (xy["y"] + size * pixel / 2).alias("y0"), "m.image", "m.mask",
    )
    return chips, n


def backfilled(index: DataFrame, layer: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(index, (outcome, n)): rows without ``column`` take it from layer (key, column); those that find none there leave the index.

    outcome: existing, written or missing. Of several values for a key the smallest counts; null keys find none.
    """
    found = layer.groupBy(F.col(key).alias("__key")).agg(F.min(column).alias("__found"))
    rows = index.join(found, F.col(key) == F.col("__key"), "left")
    rows = rows.withColumn("__outcome", F.when(F.col(column).isNotNull(), "existing").when(F.col("__found").isNotNull(), "written").otherwise("missing"))
    n = rows.groupBy(F.col("__outcome").alias("outcome")).agg(F.count("*").alias("n"))
    return rows.withColumn(column, F.coalesce(column, "__found")).where(F.col(column).isNotNull()).select(*index.columns), n
