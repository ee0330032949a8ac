"""Map elements clipped to a box without broken shapes, and rings put together from ways.

Elements are three tables: nodes (id, x, y), ways as (way, pos, node), relations as (relation, kind, role, ref), where kind
is node, way or relation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.operators import overlay
from gridwise.session import materialize

#: Ways of a relation and role up to which rings_of puts them together in one row.
FEW = 1_000


def clipped(nodes: DataFrame, ways: DataFrame, members: DataFrame, box: tuple[float, float, float, float], whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) as ids of what a box takes, with shapes complete.

    Nodes in the box, edges included, take the ways that they are in; both take the relations with such a member, and
    relations take those that have them as members, repeated until nothing is added. Of the relations in ``whole`` (a frame
    of ids; all by default) every way and node is taken, and all nodes of every way. What a relation adds this way takes no
    further relations. Members that aren't there are passed over.
    """
    x, y = F.col("x"), F.col("y")
    inside = materialize(nodes.where(x.between(box[0], box[2]) & y.between(box[1], box[3])).select(F.col("id").alias("n_")).distinct(), "inside")
    ways_in = materialize(ways.join(inside, F.col("node") == F.col("n_"), "left_semi").select(F.col("way").alias("w_")).distinct(), "ways")
    of = lambda kind: members.where(F.col("kind") == kind)
    hit = of("node").join(inside, F.col("ref") == F.col("n_"), "left_semi").select("relation").unionByName(of("way").join(ways_in, F.col("ref") == F.col("w_"), "left_semi").select("relation"))
    taken = new = materialize(hit.distinct(), "relations")
    while not new.isEmpty():
        above = of("relation").join(new.select(F.col("relation").alias("r_")), F.col("ref") == F.col("r_"), "left_semi").select("relation").distinct()
        new = materialize(above.join(taken.select(F.col("relation").alias("r_")), F.col("relation") == F.col("r_"), "left_anti"), "above")
        taken = taken.unionByName(new)
    taken = materialize(taken, "taken")
    full = taken if whole is None else taken.join(whole.select(F.col("id").alias("i_")), F.col("relation") == F.col("i_"), "left_semi")
    added = members.join(full.select(F.col("relation").alias("r_")), F.col("relation") == F.col("r_"), "left_semi").select("kind", "ref")
    all_ways = ways_in.select(F.col("w_").alias("way")).unionByName(added.where("kind = 'way'").select(F.col("ref").alias("way"))).distinct()
    there = ways.select(F.col("way").alias("there")).distinct()
    all_ways = materialize(all_ways.join(there, F.col("way") == F.col("there"), "left_semi"), "all_ways")
    held = ways.join(all_ways.select(F.col("way").alias("w_")), F.col("way") == F.col("w_"), "left_semi").select("node")
    all_nodes = inside.select(F.col("n_").alias("node")).unionByName(held).unionByName(added.where("kind = 'node'").select(F.col("ref").alias("node"))).distinct()
    all_nodes = all_nodes.join(nodes.select(F.col("id").alias("there")).distinct(), F.col("node") == F.col("there"), "left_semi")
    return all_nodes, all_ways, taken


def _steps(ways: pa.Array) -> pa.Array:
    """For an Arrow array of lists of ways (good, a, b), a and b their end nodes: each one's ring, named by its first way's place in the list, steps from there back to the first, and direction; null for ways in no closed ring.

    All lists go at once. A half is a way run from one of its ends, numbered 2 * way and 2 * way + 1; the next half starts
    where just two ends meet. The least half of a ring is found by doubling.
    """
    sizes = ways.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ways.flatten()
    ends = pa.concat_arrays([flat.field("a"), flat.field("b")]).dictionary_encode()
    code = pc.fill_null(ends.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(2, -1).T.ravel()
    first = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    good = np.repeat(flat.field("good").to_numpy(zero_copy_only=False).astype(bool), 2) & (code >= 0)
    key = (np.repeat(group, 2) * (len(ends.dictionary) + 1) + code)[good]
    at = np.flatnonzero(good)[order := np.argsort(key, kind="stable")]
    start = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))[: len(key)]
    two = start[np.diff(np.append(start, len(key))) == 2]
    other = np.full(len(code), -1)
    other[at[two]], other[at[two + 1]] = at[two + 1], at[two]
    half = np.arange(len(code))
    least, off, ahead, step = half.copy(), np.zeros(len(code), np.int64), other[half ^ 1], 1
    while step < sizes.max(initial=0):
        nearer = (ahead >= 0) & (least[ahead] < least)
        least, off = np.where(nearer, least[ahead], least), np.where(nearer, off[ahead] + step, off)
        ahead, step = np.where(ahead >= 0, ahead[ahead], -1), step * 2
    # Of a ring and its reverse, the one whose first way runs as it was drawn.
    kept = np.flatnonzero((ahead >= 0) & (least % 2 == 0))
    out, gone = np.zeros((3, len(group)), np.int32), np.ones(len(group), bool)
    out[:, kept // 2] = least[kept] // 2 - first[group[kept // 2]], off[kept], kept % 2
    gone[kept // 2] = False
    struct = pa.StructArray.from_arrays([pa.array(c) for c in out], ["ring", "off", "d"], mask=pa.array(gone))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), struct)


def _joined(steps: Column) -> Column:
    """Points of the ring whose ways' points are in steps, in order; closed."""
    points = F.flatten(F.transform(steps, lambda s: F.slice(s["line"], F.lit(1), F.size(s["line"]) - 1)))
    return F.concat(points, F.slice(F.get(steps, F.lit(0))["line"], 1, 1))


def rings_of(nodes: DataFrame, ways: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((relation, role, ring, points), (relation, role, way)): closed rings of each relation's ways by role, and the ways that are in none.

    A null role is empty. Two ways go on in each other where they share an end node of the relation and role. A ring is closed if each of its end
    nodes has two ends of ways there; points are in order, closed, and start at the least way. Ways that are missing, or
    whose nodes are, break their ring. Relations with few ways of a role are put together where these are; those with
    more than FEW are ranked by joins, so that none is a task's work.
    """
    at = ways.hint("merge").join(nodes.select(F.col("id").alias("i_"), "x", "y"), F.col("node") == F.col("i_"), "left")
    point = F.struct(F.col("pos"), F.col("node"), F.struct("x", "y").alias("p"), F.col("i_").isNotNull().alias("known"))
    lines = at.groupBy("way").agg(F.array_sort(F.collect_list(point)).alias("line"))
    use = members.where("kind = 'way'").select("relation", F.coalesce("role", F.lit("")).alias("role"), F.col("ref").alias("way"))
    use, nowhere = use.where("relation IS NOT NULL"), use.where("relation IS NULL").distinct()
    many = materialize(use.groupBy(F.col("relation").alias("rel_"), F.col("role").alias("role_")).count().where(F.col("count") > FEW).select("rel_", "role_"), "many")
    same = (F.col("relation") == F.col("rel_")) & (F.col("role") == F.col("role_"))
    ranked = not many.isEmpty()
    # One row for FEW ways at least.
    few = use.join(F.broadcast(many), same, "left_anti") if ranked else use
    good = F.coalesce((F.size("line") >= 2) & F.forall("line", lambda p: p["known"]), F.lit(False))
    each = few.hint("merge").join(lines, "way", "left").select("relation", "role", "way", good.alias("good"), "line")
    of = lambda p: F.when(F.col("good"), p)
    each = each.select("relation", "role", F.struct("way", "good", of(F.get("line", F.lit(0))["node"]).alias("a"), of(F.get("line", F.size("line") - 1)["node"]).alias("b"), of(F.transform("line", lambda p: p["p"])).alias("line")).alias("w"))
    group = each.groupBy("relation", "role").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    steps = F.arrow_udf(_steps, "array<struct<ring: int, off: int, d: int>>")
    group = group.withColumn("at", steps(F.transform("ws", lambda w: F.struct(w["good"].alias("good"), w["a"].alias("a"), w["b"].alias("b")))))
    turned = lambda w, t: F.when(t["d"] == 0, w["line"]).when(t["d"] == 1, F.reverse(w["line"]))
    placed = lambda w, t: F.struct(F.get("ws", t["ring"])["way"].alias("ring"), t["off"].alias("off"), w["way"].alias("way"), turned(w, t).alias("line"))
    group = group.select("relation", "role", F.explode(F.zip_with("ws", "at", placed)).alias("e")).select("relation", "role", "e.*")
    step = F.struct(F.when(F.col("off") == 0, F.lit(-(2**31))).otherwise(-F.col("off")).alias("k"), "way", "line")
    # What has been dealt by relation and role stays where it is.
    made = group.groupBy("relation", "role", "ring").agg(F.array_sort(F.collect_list(step)).alias("s"))
    loose = F.when(F.col("ring").isNull(), F.transform("s", lambda s: s["way"]))
    made = materialize(made.select("relation", "role", "ring", F.when(F.col("ring").isNotNull(), _joined(F.col("s"))).alias("points"), loose.alias("ways")), "rings")
    rings, rest = made.where("ring IS NOT NULL").drop("ways"), made.where("ring IS NULL").select("relation", "role", F.explode("ways").alias("way"))
    if ranked:
        more, left = _ranked(use.join(F.broadcast(many), same, "left_semi").distinct().join(lines, "way", "left").withColumn("good", good))
        rings, rest = rings.unionByName(more), rest.unionByName(left)
    return rings, rest.unionByName(nowhere)


def _ranked(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What rings_of returns, by joins, for distinct ways (relation, role, way, line, good)."""
    own = materialize(own, "use")
    # Each way can be run both ways; the same ring run backwards is left out in the end.
    both = F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("line")[0]["node"].alias("a"), F.get("line", F.size("line") - 1)["node"].alias("b")), F.struct(F.lit(1).alias("d"), F.get("line", F.size("line") - 1)["node"].alias("a"), F.col("line")[0]["node"].alias("b"))))
    half = materialize(own.where("good").select("relation", "role", "way", both.alias("h")).select("relation", "role", "way", "h.*").orderBy("way", "d").withColumn("e", F.monotonically_increasing_id()), "halves")
    ends = half.groupBy("relation", "role", F.col("a").alias("node")).agg(F.count("*").alias("n"))
    pairs = ends.where("n = 2").select("relation", "role", F.col("node").alias("b"))
    after = half.select("relation", "role", F.col("a").alias("b"), F.col("e").alias("next"), F.col("way").alias("w"), F.col("d").alias("d_"))
    # On at a shared end with the other way; a way that ends where it starts goes on with itself.
    way = half.join(pairs, ["relation", "role", "b"]).join(after, ["relation", "role", "b"]).where("CASE WHEN a = b THEN w = way AND d_ = d ELSE w <> way END").select("e", "next")
    way = half.select("e").join(way, "e", "left")
    closed = overlay.cycles(way)
    named = half.join(closed, "e").select("relation", "role", "ring", "off", "way", "d")
    # Of a ring and its reverse, the one whose first way runs as it was drawn.
    first = named.where("off = 0").select(F.col("ring").alias("r_"), F.col("way").alias("head"), F.col("d").alias("turn"))
    named = named.join(first, F.col("ring") == F.col("r_")).where("turn = 0")
    run = named.join(own.select(F.col("relation").alias("rel_"), F.col("role").alias("role_"), F.col("way").alias("way_"), F.transform("line", lambda p: p["p"]).alias("line")), (F.col("relation") == F.col("rel_")) & (F.col("role") == F.col("role_")) & (F.col("way") == F.col("way_")))
    step = F.struct(F.when(F.col("off") == 0, F.lit(-(2**62))).otherwise(-F.col("off")).alias("k"), "way", F.when(F.col("d") == 0, F.col("line")).otherwise(F.reverse("line")).alias("line"))
    made = run.groupBy("relation", "role", "ring").agg(F.array_sort(F.collect_list(step)).alias("s"))
    rest = own.select("relation", "role", "way").join(named.select(F.col("relation").alias("rel_"), F.col("role").alias("role_"), F.col("way").alias("way_")), (F.col("relation") == F.col("rel_")) & (F.col("role") == F.col("role_")) & (F.col("way") == F.col("way_")), "left_anti")
    return made.select("relation", "role", F.col("s")[0]["way"].alias("ring"), _joined(F.col("s")).alias("points")), rest
