"""Assembling training sets: unions with provenance, repeats, caps, deduplication, quotas and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwise.functions import geo, grid
from gridwise.operators import spatial
from gridwise.session import materialize

#: Parts that a hot group is cut into to number its rows.
PARTS = 256


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as times says, numbered from 1; none for 0."""
    return df.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def number_in_group(df: DataFrame, group: str, key: str, ties: list[str], key_range: int) -> DataFrame:
    """df with n: 1, 2, ... within a group by key (an integer from 0 below key_range) and then ties.

    A group is cut into PARTS ranges of the key. Rows are numbered within a range, and ranges by the counts of those
    before, so a group with a third of all rows is no single task's work.
    """
    cut = df.withColumn("__part", F.floor(F.col(key) * PARTS / key_range))
    sizes = cut.groupBy(group, "__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(group).orderBy("__part")) - F.col("__size")
    sizes = sizes.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(key, *ties))
    return cut.withColumn("__own", own).join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))).withColumn("n", F.col("__own") + F.col("__before")).drop("__part", "__own", "__g", "__p", "__before")


def proportional_cap(df: DataFrame, group: str, limit: int, key: str, ties: list[str], key_range: int) -> DataFrame:
    """At most about limit rows, taken from each group in proportion to its size, one at least; rows without a group are left out."""
    rows = df.where(F.col(group).isNotNull())
    total = rows.count()
    share = min(1.0, limit / total) if total else 1.0
    sizes = rows.groupBy(group).agg(F.greatest(F.lit(1), F.bround(F.count("*") * share).cast("long")).alias("__quota")).withColumnRenamed(group, "__h")
    numbered = number_in_group(rows, group, key, ties, key_range)
    return numbered.join(sizes, F.col(group) == F.col("__h")).where(F.col("n") <= F.col("__quota")).drop("__h", "__quota")


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row by order for each combination of keys; sums up before it shuffles, so that frequent keys are no bottleneck."""
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.struct(*(c.alias(f"__o{i}") for i, c in enumerate(order)), F.struct(*df.columns).alias("__row")).alias("__v"))
    return rows.groupBy(*names).agg(F.min("__v").alias("__v")).select("__v.__row.*")


def heads(df: DataFrame, kind: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each kind by order, as many as its quota; other kinds go."""
    quota = F.create_map(*(x for k, n in quotas.items() for x in (F.lit(k), F.lit(n))))
    n = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return df.where(F.col(kind).isin(*quotas)).withColumn("n", n).where(F.col("n") <= max(quotas.values())).where(F.col("n") <= quota[F.col(kind)])


def sample(df: DataFrame, key: Column, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose integer key falls into so many of a hundred classes, and the others; a null key is with the others."""
    inside = F.coalesce(F.pmod(key, F.lit(100)) < percent, F.lit(False))
    return df.where(inside), df.where(~inside)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of todo whose key isn't in done."""
    seen = done.select(F.col(key).alias("__done")).distinct()
    return todo.join(seen, F.col(key) == F.col("__done"), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys (null equals null)."""
    fresh = new.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return old.join(fresh, same, "left_anti").unionByName(new, allowMissingColumns=True)


def exact_sample(df: DataFrame, n: int, key: Column, ties: list[Column]) -> DataFrame:
    """n rows, those with the least keys; all if there are fewer."""
    return df.orderBy(key, *ties).limit(n)


def capped(df: DataFrame, group: str, caps: dict[str, int], key: str, ties: list[str], key_range: int) -> DataFrame:
    """At most so many rows of each group named, those with the least keys (from 0 below key_range); other groups go."""
    cap = F.create_map(*(x for k, n in caps.items() for x in (F.lit(k), F.lit(n))))
    return number_in_group(df.where(F.col(group).isin(*caps)), group, key, ties, key_range).where(F.col("n") <= cap[F.col(group)]).drop("n")


def with_validation(df: DataFrame, key: Column, split: str = "split", least: int = 8, percent: int = 20) -> DataFrame:
    """df with the split to use: as it is, or, with fewer than least validation rows, a share of the training rows for validation."""
    if df.where(F.col(split) == "val").limit(least).count() >= least:
        return df
    inside = F.pmod(key, F.lit(100)) < percent
    return df.withColumn(split, F.when((F.col(split) == "train") & inside, "val").otherwise(F.col(split)))


def frequent(df: DataFrame, group: str, least: int = 20) -> DataFrame:
    """Rows of groups that have at least so many."""
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return df.join(n, F.col(group) == F.col("__g"), "left_semi")


def pools(wanted: DataFrame, other: DataFrame, n: int, inside: bool = False) -> DataFrame:
    """The first n different rows of wanted that other lacks, or has if asked for; frames of the same columns."""
    rows = wanted.intersect(other) if inside else wanted.subtract(other)
    return rows.orderBy(*rows.columns).limit(n)


class MissingLayer(ValueError):
    """More cells than allowed lack a layer."""


def with_layer(cells: DataFrame, layers: DataFrame, key: str, most: float = 0.05) -> DataFrame:
    """Cells that have the layer; raises if more than this share of them lack it."""
    have = layers.select(F.col(key).alias("__have")).distinct()
    every, lack = cells.count(), cells.join(have, F.col(key) == F.col("__have"), "left_anti").count()
    if lack > most * every:
        raise MissingLayer(f"{lack} of {every} cells lack the layer")
    return cells.join(have, F.col(key) == F.col("__have"), "left_semi")


def recipe(text: str) -> list[tuple[str, int]]:
    """Names and repeats from ``name:times,name``; times is 1 where it isn't given."""
    parts = (p.strip().partition(":") for p in text.split(",") if p.strip())
    return [(name.strip(), int(times or 1)) for name, _, times in parts]


def merged(indexes: dict[str, DataFrame], text: str) -> DataFrame:
    """The indexes that a recipe names, with aoi (where it is null or absent) and copy; training rows come as often as it says, others once."""
    frames = []
    for name, times in recipe(text):
        df = indexes[name]
        df = df.withColumn("aoi", F.coalesce("aoi", F.lit(name)) if "aoi" in df.columns else F.lit(name))
        frames.append(repeat(df, F.when(F.col("split") == "train", times).otherwise(1)))
    return union(frames)


def rebalanced(index: DataFrame, limit: int, key: str, ties: list[str], key_range: int, group: str = "aoi", pixels: str = "sub_pixels") -> DataFrame:
    """All rows with positive pixels, and of the others about limit in proportion to their groups."""
    return index.where(F.col(pixels) > 0).unionByName(proportional_cap(index.where(F.col(pixels) == 0), group, limit, key, ties, key_range).select(index.columns))


def reused(wanted: DataFrame, present: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """wanted with status: linked already, to link (present elsewhere), or missing."""
    w = wanted
    for df, name in ((done, "__done"), (present, "__there")):
        w = w.join(df.select(F.col(key).alias(f"{name}_k")).distinct().withColumn(name, F.lit(True)), F.col(key) == F.col(f"{name}_k"), "left").drop(f"{name}_k")
    return w.withColumn("status", F.when(F.col("__done"), "linked").when(F.col("__there"), "link").otherwise("missing")).drop("__done", "__there")


def jittered_grid(box: tuple[float, float, float, float], step: float, share: float, seed: int) -> Column:
    """An array of (k, x, y): points every step over a box, each moved by up to this share of the step."""
    nx, ny = (max(1, int(-(-(box[i + 2] - box[i]) // step))) for i in (0, 1))
    off = lambda k, s: (2 * grid.uniform(k, s) - 1) * (share * step)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(nx * ny - 1).cast("long")), lambda k: F.struct(k.alias("k"), (box[0] + (k % nx) * step + off(k, seed)).alias("x"), (box[1] + F.floor(k / nx) * step + off(k, seed + 1)).alias("y")))


def clear_points(points: DataFrame, keep_off: list[tuple[DataFrame, float]], n: int | None = None, key: Column | None = None) -> DataFrame:
    """Points (id, x, y) with nothing of any frame within its distance; of them n by the least keys and ids, if asked for."""
    for other, radius in keep_off:
        points = spatial.clear_of(points, other, radius)
    return points if n is None else exact_sample(points, n, key if key is not None else F.col("id"), [F.col("id")])


def chip_centres(labels: DataFrame, line_points: DataFrame, near: DataFrame, box: tuple[float, float, float, float], seed: int = 42, voltage_weight: int = 1, clearance: float = 1500.0) -> DataFrame:
    """(kind, id, lon, lat) of chips to cut: labels, lines far from any label, and the background.

    labels: id, lon, lat, voltage_v (positives). Each is moved by up to 900 m; of those in one square of 0.02 degrees the
    first by id stays; one with a voltage comes voltage_weight times, the further ones moved by up to 300 m more.
    line_points: id, lon, lat, x, y; those with a point of near (id, x, y) within clearance are left out, and 0.7 times as
    many as positives are kept. The background is 0.3 times as many, anywhere in the box; what lies outside goes.
    """
    lon, lat = grid.jittered(F.col("lon"), F.col("lat"), F.col("id"), seed, 900.0)
    moved = labels.select("id", lon.alias("lon"), lat.alias("lat"), "voltage_v")
    kept = first_of(moved, [grid.round_key(F.col("lon"), F.col("lat"), 0.02)], [F.col("id")])
    times = F.when(F.col("voltage_v") > 0, voltage_weight).otherwise(1)
    copies = repeat(kept, times)
    lon, lat = grid.jittered(F.col("lon"), F.col("lat"), F.col("id") * 31 + F.col("copy"), seed + 2, 300.0)
    further = F.col("copy") > 1
    positive = materialize(copies.select(F.lit("positive").alias("kind"), "id", F.when(further, lon).otherwise(F.col("lon")).alias("lon"), F.when(further, lat).otherwise(F.col("lat")).alias("lat")), "positives")
    n = max(positive.count(), 1)
    far = spatial.clear_of(line_points, near, clearance)
    lon, lat = grid.jittered(F.col("lon"), F.col("lat"), F.col("id"), seed + 4, 900.0)
    negative = exact_sample(far, int(0.7 * n), grid.uniform(F.col("id"), seed + 6), [F.col("id")]).select(F.lit("line_negative").alias("kind"), "id", lon.alias("lon"), lat.alias("lat"))
    at = lambda i, s: box[i] + (box[i + 2] - box[i]) * grid.uniform(F.col("id"), s)
    background = labels.sparkSession.range(max(int(0.3 * n), 1)).select(F.lit("background").alias("kind"), "id", at(0, seed + 8).alias("lon"), at(1, seed + 9).alias("lat"))
    return union([positive, negative, background]).where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def line_vertices(lines: DataFrame, spacing: float = 3000.0) -> DataFrame:
    """(id, line_id, k, x, y): points along segments (id, x0, y0, x1, y1), ends included, spacing apart at most; id is a number of its own."""
    ends = (F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    p = lines.select(F.col("id").alias("line_id"), F.posexplode(geo.densify(*ends, spacing)).alias("k", "p"))
    return p.select((F.col("line_id") * 100000 + F.col("k")).alias("id"), "line_id", "k", "p.x", "p.y")


def drawn(groups: DataFrame, keep_off: list[tuple[DataFrame, float]], attempts: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((group, k, x, y), (group, got, lacking)): random points in each group's box, clear of all frames, until its quota is met.

    groups: group (a whole number), xmin, ymin, xmax, ymax, quota. A group's draws are numbered; those with nothing of a
    frame within its distance are taken, in order, until there are quota or the draws are used up. A round draws only as
    many as the groups still lack and some more, so what is drawn doesn't grow with the number of attempts allowed.
    """
    todo = materialize(groups.select("group", "xmin", "ymin", "xmax", "ymax", F.col("quota").cast("long").alias("quota"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("got")), "todo")
    found, most = None, F.lit(attempts).cast("long")
    over = lambda lo, hi, s: F.col(lo) + (F.col(hi) - F.col(lo)) * grid.uniform(F.col("group") * 1_000_003 + F.col("k"), s)
    while True:
        lacking = todo.where((F.col("got") < F.col("quota")) & (F.col("from") < most))
        # Half as many again as are lacking, for what is too near.
        upto = F.least(most, F.col("from") + F.ceil((F.col("quota") - F.col("got")) * 1.5) + 8)
        draws = lacking.select("group", "xmin", "ymin", "xmax", "ymax", F.explode(F.sequence(F.col("from"), upto - 1)).alias("k"))
        draws = draws.select(F.struct("group", "k").alias("id"), over("xmin", "xmax", seed).alias("x"), over("ymin", "ymax", seed + 1).alias("y"))
        kept = materialize(clear_points(draws, keep_off), "draws")
        found = kept if found is None else found.unionByName(kept)
        n = kept.groupBy(F.col("id.group").alias("g")).agg(F.count("*").alias("n"))
        again = (F.col("got") < F.col("quota")) & (F.col("from") < most)
        todo = todo.join(n, F.col("group") == F.col("g"), "left").select("group", "xmin", "ymin", "xmax", "ymax", "quota", F.when(again, upto).otherwise(F.col("from")).alias("from"), (F.col("got") + F.coalesce("n", F.lit(0))).alias("got"))
        todo = materialize(todo, "todo")
        if todo.where((F.col("got") < F.col("quota")) & (F.col("from") < most)).isEmpty():
            break
    rows = found.select("id.group", "id.k", "x", "y").join(todo.select(F.col("group").alias("g"), "quota"), F.col("group") == F.col("g"))
    # A group has its quota and a few more.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("k"))).where(F.col("n") <= F.col("quota"))
    return first.select("group", "k", "x", "y"), todo.select("group", F.least("got", "quota").alias("got"), F.greatest(F.col("quota") - F.col("got"), F.lit(0).cast("long")).alias("lacking"))
