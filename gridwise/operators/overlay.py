"""Union, intersection and difference of polygons as polygons, and rings from loose sides.

Polygons come in groups (group, part, rings): the parts of a component, or the two of a pair. All sides of a group are cut
where they meet, joined by the cells that they touch; a piece of a side stays if a point just beside it is held by the
right parts; the pieces that are left are put in rings. Each step is a join or an aggregation over sides, so a group of
any size is spread over the cluster, and only a finished ring is one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StructField, StructType

from gridwise.functions import cells, geo, polygon
from gridwise.operators import regions, spatial
from gridwise.session import materialize

#: Decimal places of coordinates: corners and crossings nearer than that are one. How far beside a side its neighbourhood is looked up.
PLACES, BESIDE = 4, 1e-3
ENDS = ("x0", "y0", "x1", "y1")
#: A polygon is about so many of open_sides' small cells long, and a larger cell so many of them; it is dealt out in blocks of so many polygons.
FINE, WIDE, BLOCK = 8, 32, 20_000


def _turned(ring: Column) -> Column:
    """Twice the signed area of a closed ring: above 0 if it runs counter-clockwise."""
    return F.aggregate(geo._pairs(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])


def sides(parts: DataFrame) -> DataFrame:
    """(side, group, part, x0, y0, x1, y1) of polygons (group, part, rings), each with the inside on its left. Written once, with a number each."""
    rounded = F.transform("ring", lambda p: F.struct(F.round(p["x"], PLACES).alias("x"), F.round(p["y"], PLACES).alias("y")))
    rows = parts.select("group", "part", F.posexplode("rings").alias("k", "ring")).where("size(ring) >= 4").select("group", "part", "k", rounded.alias("ring"))
    ring = F.when((_turned(F.col("ring")) > 0) == (F.col("k") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    rows = rows.select("group", "part", F.explode(geo._pairs(ring)).alias("e")).where("e.a.x <> e.b.x OR e.a.y <> e.b.y")
    return materialize(rows.select(F.monotonically_increasing_id().alias("side"), "group", "part", *(F.col(f"e.{p}").alias(f"{p[-1]}{'ab'.index(p[0])}") for p in ("a.x", "a.y", "b.x", "b.y"))), "sides")


def _oriented(rings: Column) -> Column:
    """Rings with rounded corners and the inside on their left, those of fewer than four points left out."""
    rounded = lambda r: F.transform(r, lambda p: F.struct(F.round(p["x"], PLACES).alias("x"), F.round(p["y"], PLACES).alias("y")))
    return F.filter(F.transform(F.transform(rings, rounded), lambda r, k: F.when((_turned(r) > 0) == (k == 0), r).otherwise(F.reverse(r))), lambda r: F.size(r) >= 4)


def open_sides(parts: DataFrame) -> DataFrame:
    """(side, group, part, x0, y0, x1, y1, cx, cy) of polygons (group, part, rings): as sides, beside each small cell that they touch, without cells that a part of the group covers wholly.

    Where a side goes from a union's edge to its inside, it meets a side of another part, and no part covers the small cell
    around that point. So sides of a union are cut right by what meets in these cells alone, and where many parts lie on
    each other, nearly all sides are gone. Polygons go to larger cells with their rings, crowded ones in blocks.
    """
    b = polygon.box(F.col("rings"))
    rows = parts.select("group", "part", _oriented(F.col("rings")).alias("rings")).select("*", *(c.alias(n) for n, c in b.items())).where("xmin IS NOT NULL AND ymin IS NOT NULL")
    rows = materialize(rows, "turned")
    long = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    # By squares, so that all polygons together cover a bounded number of small cells each, on average.
    fine = max(math.sqrt(rows.agg(F.avg(long * long)).first()[0] or 1.0) / FINE, 100 * BESIDE)
    span = lambda axis: F.explode(F.sequence(F.floor((F.col(f"{axis}min") - 2 * BESIDE) / (fine * WIDE)), F.floor((F.col(f"{axis}max") + 2 * BESIDE) / (fine * WIDE))))
    kind = parts.schema["group"].dataType
    name = F.to_json(F.struct("group")) if isinstance(kind, (ArrayType, MapType, StructType)) else F.col("group").cast("string")
    rows = rows.withColumn("cx", span("x")).withColumn("cy", span("y")).select(F.coalesce(name, F.lit("")).alias("name"), "cx", "cy", "group", "part", "rings")
    held = materialize(rows.groupBy("name", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "crowded")
    if held.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:
        # One row for BLOCK polygons at least.
        full = held.select(F.col("name").alias("fn"), F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(F.broadcast(full), (F.col("name") == F.col("fn")) & (F.col("cx") == F.col("fx")) & (F.col("cy") == F.col("fy")), "left")
        rows = rows.withColumn("block", F.coalesce(F.pmod(F.xxhash64("part"), F.col("blocks")).cast("int"), F.lit(0)))
    key = ["name", "cx", "cy", "block"]
    rows = rows.select(*key, "group", "part", "rings").repartition(*key).sortWithinPartitions(*key)
    fields = [StructField("group", kind), StructField("part", parts.schema["part"].dataType), StructField("k", IntegerType()), *(StructField(c, DoubleType()) for c in ENDS), StructField("cx", LongType()), StructField("cy", LongType())]
    out = rows.mapInArrow(lambda batches: cells.open_sides(batches, fine, WIDE, 2 * BESIDE), StructType(fields))
    return materialize(out.select(F.struct("group", "part", "k").alias("side"), "group", "part", *ENDS, "cx", "cy"), "open")


def cut(own: DataFrame, cells: DataFrame) -> DataFrame:
    """(group, part, x0, y0, x1, y1): sides in pieces, ended wherever another part's side of the group crosses or touches them. cells: the sides beside the cells in which they meet."""
    a = cells.select("group", "cx", "cy", *(F.col(c).alias(f"a_{c}") for c in ("side", "part", *ENDS)))
    b = cells.select("group", "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in ("side", "part", *ENDS)))
    # Each pair of parts meets once, so that both sides get the very same point.
    pairs = a.hint("merge").join(b, ["group", "cx", "cy"]).where("a_part < b_part AND least(a_x0, a_x1) <= greatest(b_x0, b_x1) AND least(b_x0, b_x1) <= greatest(a_x0, a_x1) AND least(a_y0, a_y1) <= greatest(b_y0, b_y1) AND least(b_y0, b_y1) <= greatest(a_y0, a_y1)")
    end = lambda s, k: F.struct(F.col(f"{s}_x{k}").alias("x"), F.col(f"{s}_y{k}").alias("y"))
    on = lambda s, o: F.filter(F.array(end(o, 0), end(o, 1)), lambda p: geo.segment_distance(p["x"], p["y"], *(F.col(f"{s}_{c}") for c in ENDS)) <= 10.0**-PLACES / 2)
    rx, ry, qx, qy = (F.col(f"{s}_{c}1") - F.col(f"{s}_{c}0") for s in "ab" for c in "xy")
    dx, dy = F.col("b_x0") - F.col("a_x0"), F.col("b_y0") - F.col("a_y0")
    turn = F.nullif(rx * qy - ry * qx, F.lit(0.0))
    t, u = (dx * qy - dy * qx) / turn, (dx * ry - dy * rx) / turn
    cross = F.struct(F.round(F.col("a_x0") + t * rx, PLACES).alias("x"), F.round(F.col("a_y0") + t * ry, PLACES).alias("y"))
    pairs = pairs.withColumns({"on_a": on("a", "b"), "on_b": on("b", "a")})
    proper = (F.size("on_a") == 0) & (F.size("on_b") == 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    pairs = pairs.withColumn("at", F.when(proper, F.array(cross)).otherwise(F.array().cast("array<struct<x: double, y: double>>")))
    each = F.explode(F.array(F.struct(F.col("a_side").alias("s"), F.concat("on_a", "at").alias("at")), F.struct(F.col("b_side").alias("s"), F.concat("on_b", "at").alias("at"))))
    cuts = pairs.select(each.alias("c")).where("size(c.at) > 0").select("c.s", F.explode("c.at").alias("p")).groupBy("s").agg(F.collect_set("p").alias("cuts"))
    x0, y0, x1, y1 = (F.col(c) for c in ENDS)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    along = lambda p: (p["x"] - x0) * (x1 - x0) + (p["y"] - y0) * (y1 - y0)
    stops = F.array_distinct(F.concat(F.array(point(x0, y0), point(x1, y1)), F.coalesce("cuts", F.array().cast("array<struct<x: double, y: double>>"))))
    stops = F.array_sort(F.transform(stops, lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    rows = own.hint("merge").join(cuts, F.col("side") == F.col("s"), "left").withColumn("stops", stops).select("group", "part", F.explode(geo._pairs(F.col("stops"))).alias("e"))
    return rows.select("group", "part", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def holders(points: DataFrame, parts: DataFrame, size: float) -> DataFrame:
    """(pid, held_by): for each point (pid, group, part, x, y), the other parts of its group that hold it. Boxes meet in cells; rings are fetched for what they let through."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    boxes = parts.select("group", F.col("part").alias("other"), *(c.alias(n) for n, c in polygon.box(F.col("rings")).items())).where("xmin IS NOT NULL")
    boxes = boxes.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    at = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    near = at.hint("merge").join(boxes, ["group", "cx", "cy"]).where("part <> other AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax").select("pid", "group", "other", "x", "y")
    held = near.hint("merge").join(parts.select("group", F.col("part").alias("other"), "rings"), ["group", "other"]).where(polygon.contains(F.col("rings"), F.col("x"), F.col("y")))
    return held.groupBy(F.col("pid").alias("h")).agg(F.collect_set("other").alias("held_by"))


def cycles(way: DataFrame) -> DataFrame:
    """(e, ring, off) of steps (e, next), next null at an open end: the ring's least e, and how many steps it is away. Steps in no closed ring are left out.

    Each step knows the least one among the next 2**k steps and how far that is, which takes as many joins as the longest
    ring has binary digits (list ranking by doubling); no ring is a task's work.
    """
    way = materialize(way.select("e", F.col("e").alias("least"), F.lit(0).cast("long").alias("off"), "next"), "way")
    step, before = 1, None
    while (now := way.agg(F.sum(F.col("least").cast("decimal(38,0)")), F.count("next")).first()) != before:
        before = now
        there = way.select(F.col("e").alias("next"), F.col("least").alias("l"), F.col("off").alias("o"), F.col("next").alias("n"))
        nearer = F.col("l") < F.col("least")
        far = way.hint("merge").join(there, "next", "left").select("e", F.when(nearer, F.col("l")).otherwise(F.col("least")).alias("least"), F.when(nearer, F.col("o") + step).otherwise(F.col("off")).alias("off"), F.col("n").alias("next"))
        way = materialize(far, "way")
        step *= 2
    return way.where("next IS NOT NULL").select("e", F.col("least").alias("ring"), "off")


def rings(edges: DataFrame) -> DataFrame:
    """(group, ring, points, turned) of directed sides (group, x0, y0, x1, y1) with the inside on their left.

    Where several sides leave a point, the one goes on that closes the narrowest inside, so rings touch at points only.
    points is closed and without corners on straight lines; turned is twice the signed area, above 0 for outer rings.
    Sides that close no ring are left out.
    """
    own = materialize(edges.select(F.monotonically_increasing_id().alias("e"), "group", *ENDS), "edges")
    after = own.select("group", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("e").alias("n"), F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    back = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1"))
    sweep = F.pmod(back - F.atan2(F.col("ny") - F.col("y1"), F.col("nx") - F.col("x1")), F.lit(2 * math.pi))
    sweep = F.when((sweep < 1e-9) | (sweep > 2 * math.pi - 1e-9), F.lit(2 * math.pi)).otherwise(sweep)
    way = own.hint("merge").join(after, ["group", "x1", "y1"]).groupBy("e").agg(F.min_by("n", F.struct(sweep, "n")).alias("next"))
    closed = cycles(own.select("e").hint("merge").join(way.select("e", "next"), "e", "left"))
    size = F.struct(F.when(F.col("off") == 0, F.lit(0)).otherwise(-F.col("off")).alias("k"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    whole = own.hint("merge").join(closed, "e").groupBy("group", "ring").agg(F.array_sort(F.collect_list(size)).alias("s"))
    # The head of a ring, off 0, comes last.
    corners = F.concat(F.slice(F.col("s"), F.size("s"), 1), F.slice(F.col("s"), 1, F.size("s") - 1))
    whole = whole.withColumn("s", corners).withColumn("m", F.size("s"))
    # Each corner between its neighbours; got by place, they would be looked up in a ring made anew for each corner.
    before, after = F.concat(F.slice("s", F.col("m"), 1), F.slice("s", 1, F.col("m") - 1)), F.concat(F.slice("s", 2, F.col("m") - 1), F.slice("s", 1, 1))
    three = F.arrays_zip(before.alias("p"), F.col("s").alias("q"), after.alias("r"))

    def bends(t: Column) -> Column:
        p, q, r = t["p"], t["q"], t["r"]
        area = (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])
        return F.abs(area) > 10.0**-PLACES * (F.abs(r["x"] - p["x"]) + F.abs(r["y"] - p["y"]))

    kept = F.transform(F.filter(three, bends), lambda t: F.struct(t["q"]["x"].alias("x"), t["q"]["y"].alias("y")))
    whole = whole.withColumn("c", kept).where("size(c) >= 3").withColumn("points", F.concat("c", F.slice("c", 1, 1)))
    return whole.select("group", "ring", "points", _turned(F.col("points")).alias("turned"))


def assembled(made: DataFrame) -> DataFrame:
    """(group, id, rings): polygons of rings (group, ring, points, turned), each hole with the smallest outer ring around it; id is the outer ring's."""
    made = materialize(made, "rings")
    outer = made.where("turned > 0").select("group", F.col("ring").alias("id"), F.array("points").alias("rings"), "turned")
    inside = polygon.interior_point(F.array("points"))
    holes = made.where("turned < 0").select(F.struct("group", "ring").alias("pid"), "group", F.lit(-1).cast("long").alias("part"), inside.alias("p")).select("pid", "group", "part", "p.x", "p.y")
    around = holders(holes, outer.select("group", F.col("id").alias("part"), "rings"), _span(outer))
    around = around.select("h", F.explode("held_by").alias("outer"))
    size = outer.select(F.col("group").alias("g"), F.col("id").alias("o"), "turned")
    around = around.join(size, (F.col("h.group") == F.col("g")) & (F.col("outer") == F.col("o"))).groupBy("h").agg(F.min_by("outer", F.struct("turned", "outer")).alias("outer"))
    held = made.select(F.struct("group", "ring").alias("h"), F.struct("ring", "points").alias("hole")).join(around, "h")
    held = held.groupBy(F.col("h.group").alias("g"), F.col("outer").alias("o")).agg(F.array_sort(F.collect_list("hole")).alias("holes"))
    out = outer.join(held, (F.col("group") == F.col("g")) & (F.col("id") == F.col("o")), "left")
    return out.select("group", "id", F.concat("rings", F.coalesce(F.transform("holes", lambda h: h["points"]), F.array().cast(polygon.POLYGON))).alias("rings"))


def _span(parts: DataFrame) -> float:
    """A cell about as long as a polygon's box, on average; 1 for none."""
    b = polygon.box(F.col("rings"))
    return max(parts.agg(F.avg(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]))).first()[0] or 1.0, 10.0**-PLACES)


def _overlay(parts: DataFrame, keep: str, size: float | None) -> DataFrame:
    parts = materialize(parts.select("group", "part", "rings").where("size(rings) > 0"), "parts")
    size = size or _span(parts)
    if keep == "union":
        touched = open_sides(parts)
        own = touched.select("side", "group", "part", *ENDS).dropDuplicates(["side"])
        size = min(size, _span(parts))
    else:
        own = sides(parts)
        touched = spatial._touched(own, size)
    pieces = materialize(cut(own, touched).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    length = geo.distance(*(F.col(c) for c in ENDS))
    # The inside is on the left; a union asks for what is on the right.
    beside = lambda way: (
        ((F.col("x0") + F.col("x1")) / 2 - way * BESIDE * (F.col("y1") - F.col("y0")) / length).alias("x"),
        ((F.col("y0") + F.col("y1")) / 2 + way * BESIDE * (F.col("x1") - F.col("x0")) / length).alias("y"),
    )
    if keep == "difference":
        # Of the first part the pieces in no other; of the others, run backwards, those in the first and in no third.
        first = parts.groupBy(F.col("group").alias("g")).agg(F.min("part").alias("first"))
        pieces = pieces.join(first, F.col("group") == F.col("g")).drop("g")
        way = F.when(F.col("part") == F.col("first"), F.lit(1.0)).otherwise(F.lit(-1.0))
    else:
        way = F.lit(-1.0 if keep == "union" else 1.0)
    held = holders(pieces.select("pid", "group", "part", *beside(way)), parts, size)
    rows = pieces.hint("merge").join(held, F.col("pid") == F.col("h"), "left").withColumn("n", F.coalesce(F.size("held_by"), F.lit(0)))
    if keep == "union":
        rows = rows.where("n = 0").select("group", *ENDS)
    elif keep == "intersection":
        all_parts = parts.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("parts"))
        rows = rows.join(all_parts, F.col("group") == F.col("g")).where("n = parts - 1").select("group", *ENDS)
    else:
        own, back = rows.where("part = first AND n = 0").select("group", *ENDS), rows.where("part <> first AND n = 1 AND array_contains(held_by, first)")
        rows = own.unionByName(back.select("group", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")))
    # What two parts share is there twice.
    return assembled(rings(rows.distinct()))


def union(parts: DataFrame, size: float | None = None) -> DataFrame:
    """(group, id, rings): the union of each group's parts as polygons with holes. size: of the cells in which sides meet.

    parts: (group, part, rings), parts numbered or named within a group, each ring closed and without crossings of its own.
    """
    return _overlay(parts, "union", size)


def intersection(parts: DataFrame, size: float | None = None) -> DataFrame:
    """(group, id, rings): what all parts of a group share; no row for none."""
    return _overlay(parts, "intersection", size)


def difference(parts: DataFrame, size: float | None = None) -> DataFrame:
    """(group, id, rings): what of each group's first part (the smallest by name) no other covers; no row for none."""
    return _overlay(parts, "difference", size)


def paired(pairs: DataFrame) -> DataFrame:
    """(group, part, rings) of pairs (left_id, right_id, left_rings, right_rings): the left one is part 0."""
    two = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("left_rings").alias("rings")), F.struct(F.lit(1).alias("part"), F.col("right_rings").alias("rings"))))
    return pairs.select(F.struct("left_id", "right_id").alias("group"), two.alias("t")).select("group", "t.part", "t.rings")


def overlaid(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(left_id, right_id, shared, rest) of polygons (id, rings) that share area: what two of them share, and what is left of the left one, as arrays of polygons.

    As intersection and difference of each pair, but worked out where the two meet, in Arrow batches: pairs with their rings
    aren't shuffled. Pairs with a polygon too large to go to cells are put together by joins as there.
    """
    kind = ArrayType(left.schema["rings"].dataType)
    turned = lambda df: df.select("id", _oriented(F.col("rings")).alias("rings"))

    def large(p: DataFrame, q: DataFrame) -> DataFrame:
        two = materialize(paired(regions.fetched(p, q, size)), "pairs")
        made = [f(two, size).groupBy(F.col("group").alias(g)).agg(F.collect_list("rings").alias(name)) for f, g, name in ((intersection, "g", "shared"), (difference, "h", "rest"))]
        both = made[0].hint("merge").join(made[1], F.col("g") == F.col("h"), "left")
        return both.select("g.left_id", "g.right_id", "shared", F.coalesce("rest", F.array().cast(kind)).alias("rest"))

    more = [StructField(c, kind) for c in ("shared", "rest")]
    return regions._joined(turned(left), turned(right), size, 0.0, lambda rows: cells.overlaid_pairs(rows, size, PLACES, BESIDE), more, large)
