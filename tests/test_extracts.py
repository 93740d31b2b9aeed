"""PBF files, extracts and areas stitched from ways, on general shapes and against plain code."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from wayfield.facade import AreaOfInterest, PointsOfInterest, StreetNetwork
from wayfield.functions import shapes
from wayfield.operators import stitching
from wayfield.sources import osm, pbf

NODES, WAYS, RELATIONS = pbf.NODES, pbf.WAYS, pbf.RELATIONS


def as_rows(df):
    return sorted((tuple(json.dumps(v, default=lambda o: o.asDict() if hasattr(o, "asDict") else str(o), sort_keys=True) for v in r) for r in df.collect()))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """20,001 nodes, ways and relations, and the file that they are written to."""
    tags = lambda k: F.when(F.col("id") % k == 0, F.create_map(F.lit("name"), F.concat(F.lit("ü\n\x07"), F.col("id").cast("string")), F.lit("ref"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>")).alias("tags")
    ids = spark.range(20_001)
    at = lambda c: F.expr(f"({c}) / 1e7D")
    nodes = ids.select((F.col("id") * 3_000_000_007 - 7).alias("id"), at("(id * 7919) % 3600000000 - 1800000000").alias("x"), at("900000000 - (id * 104729) % 1800000000").alias("y"), tags(5))
    ways = ids.filter("id < 9000").select(F.col("id").alias("way"), F.sequence("id", F.col("id") + F.col("id") % 7).alias("nodes"), tags(2))
    relations = spark.createDataFrame([(-5, [("way", 3, "outer"), ("node", -7, ""), ("relation", 1 << 60, "x")], {"type": "multipolygon"}), (6, [], {})], RELATIONS)
    path = f"{tmp_path_factory.mktemp('pbf')}/a.osm.pbf"
    pbf.write_pbf(nodes, ways, relations, path)
    return path, (nodes, ways, relations)


@pytest.mark.parametrize("split", [None, 3000])
def test_pbf_is_read_as_written_however_it_is_split(spark, saved, split):
    path, tables = saved
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names if split else ():
            spark.conf.set(n, str(split))
        got = pbf.read_pbf(spark, path)
        if split:
            assert got[0].rdd.getNumPartitions() > 20
        for read, written in zip(got, tables, strict=True):
            assert as_rows(read) == as_rows(written)
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def file_of(block, pack):
    """A file of one block, encoded by hand."""
    head = b"".join(pbf._field(4, f) for f in (b"OsmSchema-V0.6", b"DenseNodes"))
    out = b""
    for kind, blob in ((b"OSMHeader", pbf._field(1, head)), (b"OSMData", pack(block))):
        header = pbf._field(1, kind) + (pbf._field(2, b"index") if kind == b"OSMData" else b"") + pbf._field(3, len(blob))
        out += struct.pack(">I", len(header)) + header + blob
    return out


def test_pbf_of_other_writers(spark, tmp_path):
    """Nodes one by one, offsets and another granularity; plain, lzma and zstd blobs; the separator's bytes in a plain blob are an error."""
    import lzma

    import pyarrow as pa

    zig = lambda v: (v << 1) ^ (v >> 63)
    node = pbf._field(1, zig(-12)) + pbf._field(2, pbf._packed([1])) + pbf._field(3, pbf._packed([2])) + pbf._field(4, pbf._field(1, 3)) + pbf._field(8, zig(-15)) + pbf._field(9, zig(25))
    strings = b"".join(pbf._field(1, s) for s in (b"", b"k", b"v"))
    block = pbf._field(1, strings) + pbf._field(2, pbf._field(1, node)) + pbf._field(17, 1000) + pbf._field(19, 5_000_000_000) + pbf._field(20, -1_000_000_000)
    packs = {
        "plain": lambda b: pbf._field(1, b),
        "lzma": lambda b: pbf._field(2, len(b)) + pbf._field(4, lzma.compress(b)),
        "zstd": lambda b: pbf._field(2, len(b)) + pbf._field(7, pa.compress(b, codec="zstd", asbytes=True)),
        "lz4": lambda b: pbf._field(2, len(b)) + pbf._field(6, pa.compress(b, codec="lz4_raw", asbytes=True)),
    }
    for name, pack in packs.items():
        (tmp_path / f"{name}.pbf").write_bytes(file_of(block, pack))
    nodes, ways, relations = pbf.read_pbf(spark, str(tmp_path))
    assert [(r.id, r.x, r.y, r.tags) for r in nodes.collect()] == [(-12, -0.999975, 4.999985, {"k": "v"})] * 4
    assert ways.count() == 0 and relations.count() == 0
    whole = (tmp_path / "plain.pbf").read_bytes()
    bad = {"cut": whole[:-3], "held": file_of(pbf._field(1, pbf._field(1, b"OSMData")), packs["plain"]), "old": whole.replace(b"DenseNodes", b"Historical")}
    for name, content in bad.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.pbf").write_bytes(content)
        with pytest.raises(Exception, match="length|broken|needs"):
            pbf.read_pbf(spark, f"{tmp_path}/{name}/a.pbf")[0].collect()
    (tmp_path / "none.pbf").write_bytes(b"")
    assert pbf.read_pbf(spark, f"{tmp_path}/none.pbf")[0].count() == 0


def test_extract_takes_whole_ways_and_relations_of_relations(spark, tmp_path):
    nodes = spark.createDataFrame([(i, float(i), 0.0, {}) for i in range(10)], NODES)
    ways = spark.createDataFrame([(1, [0, 1, 2], {"highway": "path"}), (2, [2, 3], {"highway": "path"}), (3, [5, 6], {"highway": "motorway"}), (4, [], {}), (5, None, None)], WAYS)
    relations = spark.createDataFrame([(1, [("way", 1, "")], {}), (2, [("relation", 1, "")], {}), (3, [("relation", 2, "")], {}), (4, [("node", 9, "")], {}), (5, [("node", 2, "")], {}), (6, None, None), (7, [("relation", 7, "")], {})], RELATIONS)
    inside = lambda df: df.filter("x < 1.5")
    got = osm.extract(nodes, ways, relations, inside)
    assert [sorted(r[0] for r in df.collect()) for df in got] == [[0, 1, 2], [1], [1, 2, 3]]
    kept, chosen = osm.with_tags(nodes, ways, osm.network_filters("walk"))
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3] and sorted(r.way for r in chosen.collect()) == [1, 2]
    pbf.write_pbf(nodes, ways, relations, f"{tmp_path}/s.osm.pbf")
    net = StreetNetwork(*osm.street_graph(spark, f"{tmp_path}/s.osm.pbf", "walk"))
    assert net.edges.agg(F.sum("len")).first()[0] == 3.0


def star(rng, x, y, radius, n):
    """A ring around a point, its distance from it never under half of the radius."""
    return [(x + radius * f * math.cos(2 * math.pi * k / n), y + radius * f * math.sin(2 * math.pi * k / n)) for k in range(n) for f in [rng.uniform(0.5, 1.0)]]


def drawn(spark, relations, rng, first=0):
    """Elements of relations (id: rings of points), each ring cut into ways at random places, run in random directions, in random order."""
    nodes, ways, rows = {}, [], []
    for rel, rings in relations.items():
        members = []
        for ring in rings:
            ids = [nodes.setdefault(p, first + len(nodes)) for p in ring]
            cuts = sorted(rng.sample(range(len(ids)), rng.randint(1, min(6, len(ids)))))
            for a, b in zip(cuts, [*cuts[1:], cuts[0] + len(ids)], strict=True):
                way = [ids[k % len(ids)] for k in range(a, b + 1)]
                ways.append((first + len(ways), way[::-1] if rng.random() < 0.5 else way, {}))
                members.append(("way", ways[-1][0], rng.choice(["outer", "inner", "", None])))
        rng.shuffle(members)
        rows.append((rel, members, {"type": "multipolygon", "leisure": "park"}))
    at = [(i, *p, {}) for p, i in nodes.items()]
    return spark.createDataFrame(at, NODES), spark.createDataFrame(ways, WAYS), spark.createDataFrame(rows, RELATIONS)


def shoelace(ring):
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def test_nested_rings_of_many_ways(spark):
    """Rings in rings, five deep, and rings side by side; a long ring of hundreds of ways."""
    rng = random.Random(5)
    relations, areas, sizes = {}, {}, {}
    for rel in range(1, 13):
        rings, area, parts = [], 0.0, 0
        for spot in range(rng.randint(1, 4)):
            for depth in range(rng.randint(1, 5)):
                ring = star(rng, 300.0 * spot + rel, 100.0 * rel, 100 * 0.45**depth, rng.randint(5, 40))
                rings.append(ring)
                area += shoelace(ring) * (-1) ** depth
                parts += depth % 2 == 0
        relations[rel], areas[rel], sizes[rel] = rings, area, parts
    got = {r.id: r for r in stitching.areas(*drawn(spark, relations, rng)).withColumn("area", shapes.area(F.col("shape"))).withColumn("ok", shapes.is_valid(F.col("shape"))).collect()}
    assert set(got) == set(relations)
    for rel, r in got.items():
        assert r.open_ways == 0 and r.ok and len(r.shape) == sizes[rel], rel
        assert r.area == pytest.approx(areas[rel])

    ring = star(rng, 0, 0, 100, 700)
    points = spark.createDataFrame([(k, *p, {}) for k, p in enumerate(ring)], NODES)
    ways = spark.createDataFrame([(k, [k, (k + 1) % 700][:: rng.choice([1, -1])], None) for k in range(700)], WAYS)
    one = spark.createDataFrame([(1, [("way", k, "") for k in range(700)], {"type": "boundary"})], RELATIONS)
    r = stitching.areas(points, ways, one).select("shape", shapes.area(F.col("shape")).alias("area")).first()
    assert r.area == pytest.approx(shoelace(ring)) and len(r.shape[0][0]) == 701


def test_rings_that_touch_at_points(spark):
    """A chain of squares that share corners, as one ring or many: the area is that of the squares, whatever order members have."""
    rng = random.Random(1)
    squares = [[(10.0 * k, 10.0 * k), (10.0 * k + 10, 10.0 * k), (10.0 * k + 10, 10.0 * k + 10), (10.0 * k, 10.0 * k + 10)] for k in range(9)]
    for seed in range(4):
        rng.seed(seed)
        r = stitching.areas(*drawn(spark, {1: squares}, rng)).select(shapes.area(F.col("shape")).alias("area"), "open_ways").first()
        assert r.open_ways == 0 and r.area == pytest.approx(900)


def test_broken_and_odd_elements(spark):
    square = [(1, 0.0, 0.0, {}), (2, 4.0, 0.0, {}), (3, 4.0, 4.0, {}), (4, 0.0, 4.0, {}), (4, 0.0, 4.0, {}), (9, None, 1.0, None)]
    nodes = spark.createDataFrame(square, NODES).withColumn("way", F.lit("clash"))
    park = {"leisure": "park"}
    ways = spark.createDataFrame(
        [(1, [1, 2, 3, 4, 1], park), (1, [1, 2, 3, 4, 1], park), (2, [1, 2, 3], park), (3, [1, 2, 1], park), (4, [1, 2, 9, 1], park), (5, [1, 2, 77, 1], park), (6, [], park), (7, None, park), (None, [1, 2, 3, 1], park),
         (8, [1, 2, 3, 1], {"highway": "path"}), (9, [1, 2, 3, 1], {"highway": "path", "area": "yes"}), (10, [1, 2, 3, 1], {"landuse": "grass", "area": "no"}), (11, [1, 2, 3, 1], {"natural": "coastline"}), (12, [3, 4, 1], None), (13, [1, 1], None)], WAYS)
    kind = {"type": "multipolygon"}
    relations = spark.createDataFrame(
        [(1, [("way", 2, "outer"), ("way", 12, "outer"), ("way", 12, "outer"), ("way", None, ""), ("node", 1, "")], kind), (2, [("way", 2, "outer")], kind), (3, [("way", 555, "")], kind), (4, [], kind), (5, None, kind),
         (6, [("way", 1, "")], {"type": "route"}), (7, [("way", 1, "")], None), (8, [("way", 13, ""), ("way", 1, "inner")], kind), (1, [], kind), (None, [("way", 1, "")], kind)], RELATIONS).dropDuplicates(["relation", "members"])
    relations = relations.filter("NOT (relation <=> 1 AND size(members) = 0)")
    got = {(r.kind, r.id): (r.n, r.area, r.open_ways) for r in stitching.areas(nodes, ways, relations).select("kind", "id", F.size("shape").alias("n"), shapes.area(F.col("shape")).alias("area"), "open_ways").collect()}
    assert got == {("way", 1): (1, 16, 0), ("way", 9): (1, 8, 0), ("relation", 1): (1, 16, 0), ("relation", 2): (0, 0, 1), ("relation", 3): (0, 0, 1), ("relation", 4): (0, 0, 0), ("relation", 5): (0, 0, 0), ("relation", 8): (1, 16, 1)}
    assert stitching.areas(nodes.limit(0), ways.limit(0), relations.limit(0)).count() == 0


def test_overpass_answers_with_geometry_and_with_nodes(spark, tmp_path):
    at = {1: (0.0, 0.0), 2: (4.0, 0.0), 3: (4.0, 4.0), 4: (0.0, 4.0)}
    line = lambda ids: [{"lon": at[i][0], "lat": at[i][1]} for i in ids]
    park = {"type": "multipolygon", "leisure": "park", "name": "A"}
    member = lambda ref, ids, geometry: {"type": "way", "ref": ref, "role": "outer", **({"geometry": line(ids)} if geometry else {})}
    geometry = [{"type": "relation", "id": 7, "tags": park, "members": [member(1, [1, 2, 3], True), member(2, [1, 4, 3], True)]}, {"type": "way", "id": 3, "tags": {"leisure": "garden"}, "geometry": line([1, 2, 3, 1]), "nodes": [1, 2, 3, 1]}, {"type": "way", "id": 1, "geometry": line([1, 2, 3])}]
    nodes = [{"type": "node", "id": i, "lon": x, "lat": y} for i, (x, y) in at.items()]
    plain = [*nodes, {"type": "relation", "id": 7, "tags": park, "members": [member(1, [], False), member(2, [], False)]}, {"type": "way", "id": 3, "tags": {"leisure": "garden"}, "nodes": [1, 2, 3, 1]}, {"type": "way", "id": 1, "nodes": [1, 2, 3]}, {"type": "way", "id": 2, "nodes": [1, 4, 3]}]
    for name, elements in (("g", geometry), ("n", plain)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"elements": elements}))
        parks = PointsOfInterest.areas_from_overpass(spark, f"{tmp_path}/{name}.json", "green_areas").places
        got = {(r.kind, r.pid): (r.area, r.leisure, r["name"], r.geometry_type) for r in osm.expanded(parks.withColumn("area", shapes.area(F.col("shape")))).collect()}
        assert got == {("relation", 7): (16, "park", "A", "multipolygon"), ("way", 3): (8, "garden", None, None)}
        some = PointsOfInterest.areas_from_overpass(spark, f"{tmp_path}/{name}.json", "green_areas", AreaOfInterest("POLYGON ((-9 3, 1 3, 1 9, -9 9, -9 3))")).places
        assert [r.pid for r in some.collect()] == [7]


def test_xml_relations(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lon="0" lat="0"/><way id="4"><nd ref="1"/></way><relation id="5"><member type="way" ref="4" role="outer"/><member type="node" ref="1" role=""/><tag k="type" v="multipolygon"/></relation></osm>')
    nodes, ways, relations = osm.read_elements(spark, f"{tmp_path}/a.osm")
    r = relations.first()
    assert (r.relation, [tuple(m)[:2] for m in r.members], r.tags) == (5, [("way", 4), ("node", 1)], {"type": "multipolygon"}) and nodes.count() == ways.count() == 1
