"""Areas from closed ways and from relations whose members' lines close into rings.

A relation's open ways are chained where their ends meet: at a place the ends are taken in order of their angle, two by two, so rings that touch there do
not cross. A way and the direction that it is run in have a successor then, and rounds that double how far each looks ahead find every ring, its order,
and whether it is open. A ring of n ways needs about log2(n) rounds of one join, a relation of any size is never one task's work, and each round is
written, so a lost executor costs its own tasks.

How deep a ring lies among those of its relation is counted by crossings of a ray within bands; there are as many bands as the root of the relation's
sides. Rings at even depth are parts, those at odd depth are holes of the part one up; members' roles are often wrong, so they decide nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry, shapes
from wayfield.session import materialize

#: Keys that make a closed way an area, unless the value is among those that don't; kinds of relations that are areas.
AREA_KEYS = {
    "amenity": (), "boundary": (), "building": (), "historic": (), "landuse": (), "leisure": ("track",), "man_made": ("cutline", "embankment", "pipeline"),
    "military": (), "natural": ("arete", "cliff", "coastline", "ridge", "tree_row"), "office": (), "place": (), "public_transport": (), "shop": (), "tourism": (),
}
AREA_RELATIONS = ("boundary", "multipolygon")


def is_area() -> Column:
    """Whether the tags of a closed way say that it is an area: ``area`` decides where it is set."""
    value = lambda k: F.col("tags")[k]
    said = F.lit(False)
    for key, lines in AREA_KEYS.items():
        said = said | (value(key).isNotNull() & (value(key) != "no") & ~value(key).isin(*lines))
    return F.coalesce(F.when(value("area").isNotNull(), value("area") != "no").otherwise(said), F.lit(False))


def lines(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(way, line, first, last): a way's points in order; a way that names a node which is not there, or none, goes."""
    steps = ways.select("way", F.size("nodes").alias("n"), F.posexplode("nodes").alias("k", "id"))
    at = nodes.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").dropDuplicates(["id"])
    found = steps.join(at, "id").groupBy("way", "n").agg(F.array_sort(F.collect_list(F.struct("k", "id", "x", "y"))).alias("p"))
    whole = found.filter(F.size("p") == F.col("n"))
    return whole.select("way", F.transform("p", lambda p: F.struct(p["x"], p["y"])).alias("line"), F.col("p")[0]["id"].alias("first"), F.element_at("p", -1)["id"].alias("last"))


def _closed(line: Column) -> Column:
    """A ring with an area to speak of: it ends where it starts and has two more points at least."""
    return (F.size(line) >= 4) & (line[0] == F.element_at(line, -1))


def successors(members: DataFrame) -> DataFrame:
    """(relation, way, dir, to_way, to_dir) of open member lines (relation, way, line, first, last): what is run after a way that is run forward (0) or back
    (1); null where no other end is left."""
    angle = lambda a, b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    line = F.col("line")
    start = F.struct(F.lit(0).alias("dir"), F.col("first").alias("node"), angle(line[0], line[1]).alias("angle"))
    stop = F.struct(F.lit(1).alias("dir"), F.col("last").alias("node"), angle(F.element_at(line, -1), F.element_at(line, -2)).alias("angle"))
    ends = members.select("relation", "way", F.inline(F.array(start, stop)))
    at = Window.partitionBy("relation", "node").orderBy("angle", "way", "dir")
    ranked = ends.withColumn("no", F.row_number().over(at))
    other = lambda c: F.when(F.col("no") % 2 == 1, F.lead(c).over(at)).otherwise(F.lag(c).over(at))
    # who runs a way forward arrives at its last end
    return ranked.select("relation", "way", (1 - F.col("dir")).alias("dir"), other("way").alias("to_way"), other("dir").alias("to_dir"))


def chains(steps: DataFrame) -> DataFrame:
    """(relation, ring, way, dir, place) of ways in closed chains, once each: ``ring`` is the least way, run forward at place 0."""
    me = F.struct("way", "dir")
    state = steps.select(
        "relation", "way", "dir", F.coalesce("to_way", "way").alias("to_way"), F.when(F.col("to_way").isNull(), F.col("dir")).otherwise(F.col("to_dir")).alias("to_dir"),
        me.alias("least"), F.lit(0).cast("long").alias("steps"), F.col("to_way").isNull().alias("open"), F.lit(True).alias("changed"),
    )
    state, span = materialize(state, "chains"), 1
    while not state.filter("changed").isEmpty():
        ahead = state.select("relation", F.col("way").alias("to_way"), F.col("dir").alias("to_dir"), F.col("to_way").alias("way2"), F.col("to_dir").alias("dir2"), F.col("least").alias("least2"), F.col("steps").alias("steps2"), F.col("open").alias("open2"))
        less = F.col("least2") < F.col("least")
        seen = state.join(ahead, ["relation", "to_way", "to_dir"]).select(
            "relation", "way", "dir", F.col("way2").alias("to_way"), F.col("dir2").alias("to_dir"), F.least("least", "least2").alias("least"),
            F.when(less, span + F.col("steps2")).otherwise(F.col("steps")).alias("steps"), (F.col("open") | F.col("open2")).alias("open"), (less | (F.col("open2") & ~F.col("open"))).alias("changed"),
        )
        state, span = materialize(seen, "chains"), 2 * span
    # a ring is there in both directions; the one that runs its least way forward is taken
    ring = state.filter("NOT open AND least.dir = 0").select("relation", F.col("least.way").alias("ring"), "way", "dir", "steps")
    size = F.count("*").over(Window.partitionBy("relation", "ring"))
    return ring.select("relation", "ring", "way", "dir", ((size - F.col("steps")) % size).alias("place"))


def rings(members: DataFrame) -> DataFrame:
    """(relation, ring, line, n_ways) of closed rings among member lines (relation, way, line, first, last); a way that a relation names twice counts once."""
    members = members.dropDuplicates(["relation", "way"])
    alone = members.filter(_closed(F.col("line"))).select("relation", F.col("way").alias("ring"), "line", F.lit(1).cast("long").alias("n_ways"))
    apart = members.filter((F.size("line") >= 2) & (F.col("first") != F.col("last")))
    run = F.when(F.col("dir") == 1, geometry.reversed_line(F.col("line"))).otherwise(F.col("line"))
    placed = chains(successors(apart)).join(apart.select("relation", "way", "line"), ["relation", "way"])
    parts = placed.groupBy("relation", "ring").agg(F.array_sort(F.collect_list(F.struct("place", F.slice(run, 2, F.size(run) - 1).alias("line")))).alias("parts"), F.count("*").alias("n_ways"))
    points = F.flatten(F.transform("parts", lambda p: p["line"]))
    closed = parts.select("relation", "ring", F.concat(F.array(F.element_at(points, -1)), points).alias("line"), "n_ways")
    return alone.unionByName(closed.filter(F.size("line") >= 4))


def holders(closed: DataFrame) -> DataFrame:
    """(relation, ring, holder) of rings (relation, ring, line) that lie in another one of the same relation.

    A ring stands for itself by the middle of its first side; rings of a relation may touch but not cross. Relations of one ring are left out unlooked at.
    """
    several = closed.join(closed.groupBy("relation").agg(F.count("*").alias("n")).filter("n > 1").select("relation"), "relation", "left_semi")
    box = geometry.bbox(F.col("line"))
    of = several.select("relation", (F.size("line") - 1).alias("n"), box["ymin"].alias("lo"), box["ymax"].alias("hi")).groupBy("relation").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bands = of.select("relation", "lo", (F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) / F.ceil(F.sqrt("n"))).alias("high"))
    band = lambda y: F.floor((y - F.col("lo")) / F.col("high")).cast("long")
    own = several.join(bands, "relation")
    middle = lambda c: (F.col("line")[0][c] + F.col("line")[1][c]) / 2
    points = own.select("relation", "ring", middle("x").alias("px"), middle("y").alias("py"), band(middle("y")).alias("band"))
    sides = own.select("relation", "lo", "high", F.col("ring").alias("holder"), F.inline(geometry.segments(F.col("line"))))
    a, b = F.col("a"), F.col("b")
    spread = sides.filter(a["y"] != b["y"]).select("relation", "holder", "a", "b", F.explode(F.sequence(band(F.least(a["y"], b["y"])), band(F.greatest(a["y"], b["y"])))).alias("band"))
    x, y = F.col("px"), F.col("py")
    crossed = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    met = points.join(spread, ["relation", "band"]).filter((F.col("ring") != F.col("holder")) & crossed)
    return met.groupBy("relation", "ring", "holder").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def parts_of(closed: DataFrame) -> DataFrame:
    """(relation, shape) of rings (relation, ring, line): rings at even depth with the holes right below them, in order of their ring."""
    closed = materialize(closed.select("relation", "ring", "line"), "stitched-rings")
    inside = materialize(holders(closed), "stitched-holders")
    depth = inside.groupBy("relation", "ring").agg(F.count("*").alias("depth"))
    deep = closed.join(depth, ["relation", "ring"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    above = inside.join(depth.select("relation", F.col("ring").alias("holder"), F.col("depth").alias("above")), ["relation", "holder"], "left").withColumn("above", F.coalesce("above", F.lit(0)))
    parent = above.filter("above % 2 = 0").groupBy("relation", "ring").agg(F.max(F.struct("above", "holder"))["holder"].alias("part"))
    holed = deep.join(parent, ["relation", "ring"], "left")
    is_hole = (F.col("depth") % 2 == 1) & F.col("part").isNotNull()
    placed = holed.select("relation", F.when(is_hole, F.col("part")).otherwise(F.col("ring")).alias("part"), F.struct(is_hole.alias("hole"), "ring", "line").alias("r"))
    part = placed.groupBy("relation", "part").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("rings"))
    whole = part.groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("parts"))
    return whole.select("relation", F.transform("parts", lambda p: p["rings"]).cast(shapes.SHAPE).alias("shape"))


def areas(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id, shape, tags, open_ways) of all areas: closed ways whose tags say so, and relations of AREA_RELATIONS.

    ``open_ways`` counts a relation's member ways that are in no ring, for they are not there, lack nodes, or end where no other goes on. A relation
    without any ring has a shape without parts. Null lists, tags and ids of members count as none; elements that come twice count once.
    """
    ways = ways.filter("way IS NOT NULL AND nodes IS NOT NULL").dropDuplicates(["way"])
    chosen = relations.filter(F.col("relation").isNotNull() & F.col("tags")["type"].isin(*AREA_RELATIONS)).dropDuplicates(["relation"])
    members = chosen.select("relation", F.explode("members").alias("m")).filter("m.kind = 'way' AND m.ref IS NOT NULL").select("relation", F.col("m.ref").alias("way")).distinct()
    wanted = ways.filter(is_area() & (F.get("nodes", F.lit(0)) == F.try_element_at("nodes", F.lit(-1)))).select("way").union(members.select("way")).distinct()
    drawn = materialize(lines(nodes, ways.join(wanted, "way", "left_semi")), "stitched-lines")
    single = drawn.filter(_closed(F.col("line"))).join(ways.filter(is_area()).select("way", "tags"), "way")
    single = single.select(F.lit("way").alias("kind"), F.col("way").alias("id"), shapes.of_ring(F.col("line")).cast(shapes.SHAPE).alias("shape"), "tags", F.lit(0).cast("long").alias("open_ways"))
    closed = materialize(rings(members.join(drawn, "way")), "stitched-chains")
    shaped = parts_of(closed).join(closed.groupBy("relation").agg(F.sum("n_ways").alias("used")), "relation")
    named = members.groupBy("relation").agg(F.count("*").alias("n"))
    joined = chosen.select("relation", "tags").join(named, "relation", "left").join(shaped, "relation", "left")
    open_ways = F.coalesce("n", F.lit(0)) - F.coalesce("used", F.lit(0))
    whole = joined.select(F.lit("relation").alias("kind"), F.col("relation").alias("id"), F.coalesce("shape", F.array().cast(shapes.SHAPE)).alias("shape"), "tags", open_ways.alias("open_ways"))
    return single.unionByName(whole)
