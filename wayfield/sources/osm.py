"""OpenStreetMap elements as tables: tags map<string,string>; catalogue of points of interest; way networks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry, shapes
from wayfield.operators import graph, overlay, stitching
from wayfield.operators.spatial import pairs_that_meet
from wayfield.session import materialize
from wayfield.sources import pbf


def _is(key: str, *values: str) -> Column:
    return F.coalesce(F.col("tags")[key].isin(*values), F.lit(False))


def _like(key: str, pattern: str) -> Column:
    return F.coalesce(F.col("tags")[key].rlike(pattern), F.lit(False))


def _has(key: str) -> Column:
    return F.coalesce(F.map_contains_key("tags", key), F.lit(False))


#: What each kind of place is tagged as (patterns match anywhere in the tag's value).
PLACES: dict[str, Callable[[], Column]] = {
    "green_areas": lambda: _is("leisure", "garden", "park") | _is("landuse", "greenfield", "grass", "forest"),
    "bus_stops": lambda: _is("highway", "bus_stop"),
    "schools": lambda: _is("amenity", "school"),
    "healthcare": lambda: _like("amenity", "hospital|clinic|doctors|healthcare") | _has("healthcare"),
    "groceries": lambda: _like("shop", "supermarket|grocery|convenience") | _is("amenity", "marketplace"),
    "shops": lambda: _has("shop"),
    "restaurants": lambda: _like("amenity", "restaurant|bar|pub|cafe|fast_food"),
    "libraries": lambda: _is("amenity", "library"),
    "pharmacies": lambda: _is("amenity", "pharmacy"),
    "gyms": lambda: _is("amenity", "gym"),
    "cinemas": lambda: _is("amenity", "cinema"),
}

#: The highway values of each network profile.
WALK = ("footway", "pedestrian", "path", "living_street", "steps", "residential", "service", "unclassified", "track")
BIKE = ("cycleway", "path", "residential", "living_street", "unclassified", "service", "track")
DRIVE = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "residential", "unclassified", "service", "living_street",
)
PRIMARY = (
    "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "residential", "unclassified", "service", "living_street",
)


def places(elements: DataFrame, kind: str) -> DataFrame:
    if kind not in PLACES:
        raise ValueError(f"unknown kind of place: {kind}")
    return elements.filter(PLACES[kind]())


def network_filters(profile: str) -> dict[str, bool | list[str]]:
    """The tags, by key, of which a way needs one to be in the network of this profile."""
    both = sorted({*WALK, *BIKE})
    rules: dict[str, dict[str, bool | list[str]]] = {
        "walk": {"highway": list(WALK), "foot": ["yes"]},
        "bike": {"highway": list(BIKE), "bicycle": ["yes"]},
        "drive": {"highway": list(DRIVE)},
        "walk+bike": {"highway": both, "foot": ["yes"], "bicycle": ["yes"]},
        "walk+bike+primary": {"highway": sorted({*both, *PRIMARY}), "foot": ["yes"], "bicycle": ["yes"]},
        "all": {"highway": True},
    }
    if profile not in rules:
        raise ValueError(f"unknown network profile: {profile}")
    return rules[profile]


def network(ways: DataFrame, profile: str) -> DataFrame:
    """Ways that a network of this profile has: walk, bike, drive, walk+bike, walk+bike+primary or all."""
    return ways.filter(tag_filter(network_filters(profile)))


def filter_arguments(filters: Mapping[str, bool | str | list[str]]) -> list[str]:
    """The same filters as w/key=value,... arguments of a command-line tag filter."""
    return [f"w/{k}" if v is True else f"w/{k}=" + ",".join(sorted([v] if isinstance(v, str) else v)) for k, v in filters.items()]


def large_areas(areas: DataFrame, min_area: float = 200.0, min_width: float = 10.0) -> DataFrame:
    """Areas (closed ring in metres) of at least ``min_area`` whose mean width, 2 * area / length of the ring, is half of
    ``min_width`` or more: what a park has to be to count as one."""
    area, around = F.abs(geometry.signed_area(F.col("ring"))), geometry.length(F.col("ring"))
    return areas.filter((area >= min_area) & (2 * area / around >= min_width / 2))


def green_areas(areas: DataFrame, min_area: float = 200.0, min_width: float = 10.0, gap: float = 5.0, meets: DataFrame | None = None, tile: float = 500.0) -> DataFrame:
    """Parts (shape, area) of green areas (``shape`` or closed ``ring``, in metres) grown together: small and narrow ones go, by an opening of their
    union. With ``meets`` (bid, ``shape`` or ``ring``) only parts that meet one of those."""
    parts = overlay.opened(areas.select(F.lit("").alias("key"), shapes.of(areas).alias("shape")), min_area, min_width, gap, tile).select("shape", "area")
    if meets is None:
        return parts
    named = parts.withColumn("aid", F.xxhash64(F.to_json("shape")))
    return named.join(pairs_that_meet(named, meets, tile).select("aid").distinct(), "aid", "left_semi").drop("aid")


def bounded(query: str, box: tuple[float, float, float, float]) -> str:
    """A query text with {{bbox}} filled in as south, west, north, east; ``box`` is xmin, ymin, xmax, ymax."""
    x0, y0, x1, y1 = box
    return query.replace("{{bbox}}", f"{y0},{x0},{y1},{x1}")


def tag_filter(filters: Mapping[str, bool | str | list[str]]) -> Column:
    """Any of: key there (True), key equal to a value, key among values."""
    parts = [_has(k) if v is True else _is(k, *([v] if isinstance(v, str) else v)) for k, v in filters.items()]
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y, tags) and ways (way, nodes, tags) of an OSM XML file."""
    tag = "array<struct<_k:string,_v:string>>"
    tags = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))).alias("tags")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id long, _lon double, _lat double, tag {tag}").load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(f"_id long, nd array<struct<_ref:long>>, tag {tag}").load(path)
    return nodes.select(F.col("_id").alias("id"), F.col("_lon").alias("x"), F.col("_lat").alias("y"), tags), ways.select(F.col("_id").alias("way"), F.col("nd._ref").alias("nodes"), tags)


def read_xml_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations (relation, members, tags) of an OSM XML file."""
    rows = spark.read.format("xml").option("rowTag", "relation").schema("_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag array<struct<_k:string,_v:string>>").load(path)
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("kind"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")))
    return rows.select(F.col("_id").alias("relation"), F.coalesce(members, F.array().cast("array<struct<kind:string,ref:long,role:string>>")).alias("members"), tags.alias("tags"))


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of a PBF (by its ending) or XML file."""
    if path.rstrip("/").lower().endswith(".pbf"):
        return pbf.read_pbf(spark, path)
    return *read_xml(spark, path), read_xml_relations(spark, path)


def with_tags(nodes: DataFrame, ways: DataFrame, filters: Mapping[str, bool | str | list[str]]) -> tuple[DataFrame, DataFrame]:
    """Ways that the filter lets through and the nodes that they name; both are written, so a source that is slow to decode is read once."""
    kept = materialize(ways.filter(tag_filter(filters)), "tagged-ways")
    return materialize(nodes.join(kept.select(F.explode("nodes").alias("id")).distinct(), "id", "left_semi"), "tagged-nodes"), kept


def extract(nodes: DataFrame, ways: DataFrame, relations: DataFrame, inside: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lies in an area (``inside`` gives the nodes there): ways with a node in it, whole, with all their nodes; relations with a node in it or such a
    way as a member, and relations of those, up to the last."""
    within = materialize(inside(nodes).select("id").distinct(), "extract-nodes")
    steps = ways.select("way", F.explode("nodes").alias("id"))
    kept = materialize(ways.join(steps.join(within, "id", "left_semi").select("way").distinct(), "way", "left_semi"), "extract-ways")
    named = within.union(kept.select(F.explode("nodes").alias("id"))).distinct()
    relations = materialize(relations, "extract-all-relations")
    member = relations.select("relation", F.explode("members").alias("m")).select("relation", "m.kind", F.col("m.ref").alias("ref"))
    of = lambda kind, found: member.filter(F.col("kind") == kind).join(found, "ref", "left_semi").select("relation")
    fresh = of("node", within.withColumnRenamed("id", "ref")).union(of("way", kept.select(F.col("way").alias("ref")))).distinct()
    found = fresh = materialize(fresh, "extract-relations")
    while not fresh.isEmpty():
        parents = of("relation", fresh.select(F.col("relation").alias("ref"))).distinct()
        fresh = materialize(parents.join(found, "relation", "left_anti"), "extract-relations")
        found = found.union(fresh)
    return nodes.join(named, "id", "left_semi"), kept, relations.join(found, "relation", "left_semi")


def areas(elements: tuple[DataFrame, DataFrame, DataFrame], kind: str | None = None) -> DataFrame:
    """(kind, id, shape, tags, open_ways) of the areas among nodes, ways and relations, of one kind of PLACES or all. Ways and relations of other kinds are
    left out before any line is drawn."""
    nodes, ways, relations = elements
    found = stitching.areas(nodes, ways, relations if kind is None else places(relations, kind))
    return found if kind is None else places(found, kind)


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Elements (type, id, x, y, tags) of a saved Overpass answer."""
    schema = "elements array<struct<type:string,id:long,lon:double,lat:double,center:struct<lon:double,lat:double>,tags:map<string,string>>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    return one.select("e.type", "e.id", F.coalesce("e.lon", "e.center.lon").alias("x"), F.coalesce("e.lat", "e.center.lat").alias("y"), "e.tags")


def read_overpass_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of a saved Overpass answer: with the nodes that ways name, or with geometry at ways and members; there a
    point's id is a hash of its coordinates, and a point that the answer cuts off (null) has none."""
    point = "struct<lat:double,lon:double>"
    member = f"struct<type:string,ref:long,role:string,geometry:array<{point}>>"
    schema = f"elements array<struct<type:string,id:long,lon:double,lat:double,nodes:array<long>,geometry:array<{point}>,members:array<{member}>,tags:map<string,string>>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    no_tags = F.create_map().cast("map<string,string>")
    tags = F.coalesce("tags", no_tags).alias("tags")
    part = one.filter("type = 'relation'").select(F.explode("members").alias("m")).filter("m.type = 'way' AND m.geometry IS NOT NULL")
    drawn = one.filter("type = 'way' AND geometry IS NOT NULL").select(F.col("id").alias("way"), "geometry", tags).union(part.select(F.col("m.ref"), F.col("m.geometry"), no_tags))
    # a way may be there itself and as a member: its own row, with tags, is the larger one
    drawn = drawn.groupBy("way").agg(F.max(F.struct(F.size("tags").alias("n"), F.map_entries("tags").alias("t"), "geometry")).alias("b")).select("way", "b.geometry", F.map_from_entries("b.t").alias("tags"))
    key = lambda p: F.when(p["lon"].isNotNull() & p["lat"].isNotNull(), F.xxhash64(p["lon"], p["lat"]))
    at = drawn.select(F.explode("geometry").alias("p")).select(key(F.col("p")).alias("id"), F.col("p.lon").alias("x"), F.col("p.lat").alias("y")).filter("id IS NOT NULL").distinct()
    nodes = one.filter("type = 'node'").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), tags).dropDuplicates(["id"]).unionByName(at.withColumn("tags", no_tags))
    plain = one.filter("type = 'way' AND geometry IS NULL AND nodes IS NOT NULL").select(F.col("id").alias("way"), "nodes", tags).dropDuplicates(["way"]).join(drawn, "way", "left_anti")
    ways = drawn.select("way", F.transform("geometry", key).alias("nodes"), "tags").unionByName(plain)
    members = F.transform("members", lambda m: F.struct(m["type"].alias("kind"), m["ref"].alias("ref"), m["role"].alias("role")))
    return nodes, ways, one.filter("type = 'relation'").select(F.col("id").alias("relation"), members.alias("members"), tags).dropDuplicates(["relation"])


def expanded(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tags as columns, ``type`` as ``geometry_type``; a column that is there already stays and its tag goes. Without ``keys`` all that occur, in
    order of the alphabet: their names come to the driver, as any table's do."""
    if keys is None:
        keys = [r.k for r in df.select(F.explode(F.map_keys("tags")).alias("k")).distinct().orderBy("k").collect()]
    named = {"geometry_type" if k == "type" else k: k for k in keys}
    there = {c.lower() for c in df.columns if c != "tags"}
    tags = [F.col("tags")[k].alias(name) for name, k in named.items() if name.lower() not in there]
    return df.select(*(f"`{c}`" for c in df.columns if c != "tags"), *tags)


def smallest_region(regions: DataFrame, contains: Column) -> DataFrame:
    """Of the regions that contain the area, the one of least area."""
    return regions.filter(contains).orderBy("area", "id").limit(1)


def street_graph(spark: SparkSession, path: str, profile: str, project: Callable[[Column, Column], Column] | None = None, inside: Callable[[DataFrame], DataFrame] | None = None, min_edge: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a saved OSM extract (XML or PBF): the profile's ways, projected, cropped to ``inside`` (a clip of nodes) and simplified."""
    nodes, ways, _ = read_elements(spark, path)
    return graph_of(nodes, ways, profile, project, inside, min_edge)


def graph_of(nodes: DataFrame, ways: DataFrame, profile: str, project: Callable[[Column, Column], Column] | None = None, inside: Callable[[DataFrame], DataFrame] | None = None, min_edge: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The same of nodes and ways."""
    at = nodes.select("id", "x", "y")
    if project is not None:
        at = at.select("id", project(F.col("x"), F.col("y")).alias("p")).select("id", "p.x", "p.y")
    nodes, edges = graph.from_ways(network(ways, profile).select("way", "nodes"), at)
    if inside is not None:
        nodes, edges = graph.crop(nodes, edges, inside(nodes).select("id"))
    return graph.simplify(nodes, edges, min_edge)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and edges (u, v, key_no, len) of a GraphML file; attributes are found by the names its keys declare."""
    data = "array<struct<_key:string,_VALUE:string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    named = {(r[2], r[1]): r[0] for r in keys.collect()}  # the declarations, a few per file
    value = lambda kind, name: F.expr(f"filter(data, d -> d._key = '{named.get((kind, name), '')}')[0]._VALUE")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id long, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source long, _target long, _id int, data {data}").load(path)
    at = nodes.select(F.col("_id").alias("id"), value("node", "x").cast("double").alias("x"), value("node", "y").cast("double").alias("y"))
    lines = edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), value("edge", "length").cast("double").alias("len"), F.coalesce("_id", F.lit(0)).alias("k"))
    return at, graph.keyed(lines, "k", "len").select("u", "v", "key_no", "len")


def address_fields(spark: SparkSession, path: str, fields: list[str]) -> dict[str, list[str]]:
    """The different values of address fields in saved geocoder answers (one JSON object a line, ``address`` a map)."""
    rows = spark.read.schema("address map<string,string>").json(path)
    got = rows.select(*(F.array_sort(F.collect_set(F.col("address")[f])).alias(f) for f in fields)).first()
    return got.asDict()


def write_poly(df: DataFrame, name: str, path: str) -> None:
    """Areas (closed ring, hole: bool) as a .poly text: one numbered section a ring, holes marked with "!"."""
    point = lambda p: F.concat(F.lit("   "), F.format_string("%.7E", p["x"]), F.lit("   "), F.format_string("%.7E", p["y"]))
    body = F.concat(F.when(F.col("hole"), "!").otherwise(""), F.col("section").cast("string"), F.lit("\n"), F.array_join(F.transform("ring", point), "\n"), F.lit("\nEND\n"))
    # an area has few rings: numbering them is one small sort
    numbered = df.withColumn("section", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("hole", F.xxhash64("ring"))))
    one = numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", body.alias("t")))), lambda s: s["t"]), "").alias("t"))
    one.select(F.concat(F.lit(name + "\n"), "t", F.lit("END")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
