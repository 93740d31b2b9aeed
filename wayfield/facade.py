"""Layers as objects: thin wrappers over tables, with methods that call the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.functions import hexgrid, scoring, shapes
from wayfield.operators import graph, hexcells, isochrone, overlay, population, raster, snapping
from wayfield.operators.spatial import nearest, within
from wayfield.session import materialize
from wayfield.sources import files, osm


#: A matrix has a row for each quality and step, and is made on the driver.
MAX_QUALITIES = 100_000


class Layer:
    """Named tables with attributes, saved in one folder with a manifest."""

    def tables(self) -> dict[str, DataFrame]:
        raise NotImplementedError

    def attributes(self) -> dict:
        return {}

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        files.save(spark, path, type(self).__name__, self.tables(), self.attributes(), overwrite)

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        tables, attributes = files.load(spark, path, cls.__name__)
        return cls(**tables, **attributes)


@dataclass
class AreaOfInterest(Layer):
    """An area of one or more parts, with holes, as WKT (POLYGON or MULTIPOLYGON)."""

    wkt: str

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def attributes(self) -> dict:
        return {"wkt": self.wkt}

    @classmethod
    def union_of(cls, areas: DataFrame, tile: float = 500.0) -> AreaOfInterest:
        """The union of areas (``shape`` or closed ``ring``). Its text comes to the driver, as that of any area of interest."""
        parts = overlay.union(areas.select(F.lit("").alias("key"), shapes.of(areas).alias("shape")), tile)
        whole = parts.agg(F.flatten(F.collect_list("shape")).alias("shape"))
        return cls(whole.select(shapes.to_wkt(F.col("shape")).alias("wkt")).first().wkt)

    def shape(self) -> Column:
        return shapes.from_wkt(F.lit(self.wkt))

    def bounds(self, spark: SparkSession) -> tuple[float, float, float, float]:
        return tuple(spark.range(1).select(shapes.bbox(self.shape()).alias("b")).first()["b"])

    def clip(self, points: DataFrame) -> DataFrame:
        """Rows whose x, y lie inside: the box as plain comparisons for the scan, then the shape."""
        x0, y0, x1, y1 = self.bounds(points.sparkSession)
        inside = points.filter((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))
        return inside.filter(shapes.contains(self.shape(), F.col("x").cast("double"), F.col("y").cast("double")))


@dataclass
class StreetNetwork(Layer):
    """Nodes (id, x, y) and edges (u, v, key_no, len; also ``line``, the way that an edge takes, and other columns, which stay with it)."""

    nodes: DataFrame
    edges: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "edges": self.edges}

    def simplify(self, min_edge: float = 0.0, separation: float = 0.0, loops: bool = False, multi: bool = False, undirected: bool = True) -> StreetNetwork:
        return StreetNetwork(*graph.simplify(self.nodes, self.edges, min_edge, loops, multi, separation, undirected))

    def crop(self, area: AreaOfInterest) -> StreetNetwork:
        return StreetNetwork(*graph.crop(self.nodes, self.edges, area.clip(self.nodes).select("id")))

    def add_points(self, points: DataFrame, cell: float, max_distance: float, min_edge: float = 0.0) -> tuple[StreetNetwork, DataFrame]:
        """The network with a node where each point (pid, x, y) snaps to its nearest street, and (pid, node, distance)."""
        edges = self.edges.withColumn("edge", F.xxhash64("u", "v", "key_no"))
        nodes, parts, placed = snapping.add_points(points, self.nodes, edges, cell, max_distance, min_edge)
        return StreetNetwork(nodes, graph.keyed(parts.drop("edge"), "len")), placed

    @classmethod
    def from_osm_xml(cls, spark: SparkSession, path: str, profile: str, **options) -> StreetNetwork:
        return cls(*osm.street_graph(spark, path, profile, **options))

    @classmethod
    def from_pbf(cls, spark: SparkSession, path: str, profile: str, area: AreaOfInterest | None = None, **options) -> StreetNetwork:
        """The network of a PBF file, or of its part with a node in ``area`` (in degrees)."""
        nodes, ways, relations = osm.read_elements(spark, path)
        if area is not None:
            nodes, ways, _ = osm.extract(*osm.with_tags(nodes, ways, osm.network_filters(profile)), relations.limit(0), area.clip)
        return cls(*osm.graph_of(nodes, ways, profile, **options))

    @classmethod
    def from_graphml(cls, spark: SparkSession, path: str) -> StreetNetwork:
        return cls(*osm.read_graphml(spark, path))

    def nearest_nodes(self, points: DataFrame, cell: int, max_distance: float | None = None) -> DataFrame:
        """points (pid, x, y) with the nearest node, null where it is farther than ``max_distance``."""
        near = nearest(points, self.nodes.select(F.col("id").alias("tid"), "x", "y"), cell)
        close = F.lit(True) if max_distance is None else F.col("d2") <= max_distance * max_distance
        return points.join(near.select("pid", F.when(close, F.col("tid")).alias("node")), "pid", "left")


@dataclass
class PointsOfInterest(Layer):
    """Places (pid, x, y, ...), with a score where one was assigned."""

    places: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"places": self.places}

    def assign_score(self, score: Callable[..., Column], columns: Sequence[str]) -> PointsOfInterest:
        missing = [c for c in columns if c not in self.places.columns]
        if missing:
            raise KeyError(f"no column {missing}")
        return PointsOfInterest(self.places.withColumn("score", score(*(F.col(c) for c in columns))))

    def assign_score_by_values(self, column: str, ordered: Sequence[str]) -> PointsOfInterest:
        return PointsOfInterest(self.places.withColumn("score", scoring.by_values(F.col(column), ordered)))

    def assign_score_by_area(self, column: str, steps: Sequence[float]) -> PointsOfInterest:
        """Thresholds exceeded, spread over (0, 1] between the fewest and the most that occur; none is null."""
        k = self.places.withColumn("__k", scoring.thresholds_exceeded(F.col(column), sorted(steps)))
        ends = k.filter("__k > 0").agg(F.min("__k").alias("__lo"), F.max("__k").alias("__hi"))
        share = F.round((F.col("__k") - F.col("__lo") + 1) / (F.col("__hi") - F.col("__lo") + 1), 3)
        return PointsOfInterest(k.crossJoin(F.broadcast(ends)).withColumn("score", F.when(F.col("__k") > 0, share)).drop("__k", "__lo", "__hi"))

    def clip(self, area: AreaOfInterest) -> PointsOfInterest:
        return PointsOfInterest(area.clip(self.places))

    @classmethod
    def from_elements(cls, elements: DataFrame, kind: str, area: AreaOfInterest | None = None) -> PointsOfInterest:
        """Places of a kind of ``osm.PLACES`` (parks, bus_stops, ... as there) among elements (id, x, y, tags), score 0 until one is assigned."""
        found = osm.places(elements, kind).withColumnRenamed("id", "pid").withColumn("score", F.lit(0.0))
        out = cls(found)
        return out.clip(area) if area is not None else out

    @classmethod
    def from_overpass(cls, spark: SparkSession, path: str, kind: str, area: AreaOfInterest | None = None) -> PointsOfInterest:
        """The same from a saved Overpass answer."""
        return cls.from_elements(osm.read_overpass(spark, path), kind, area)

    @classmethod
    def areas_from_elements(cls, elements: tuple[DataFrame, DataFrame, DataFrame], kind: str, area: AreaOfInterest | None = None) -> PointsOfInterest:
        """Areas (kind, pid, shape, tags, open_ways, score) of a kind of ``osm.PLACES`` among nodes, ways and relations; with ``area`` those that meet it."""
        found = osm.areas(elements, kind).withColumnRenamed("id", "pid").withColumn("score", F.lit(0.0))
        return cls(found if area is None else files.in_box(found, area.bounds(found.sparkSession)).filter(shapes.meets(F.col("shape"), area.shape())))

    @classmethod
    def areas_from_overpass(cls, spark: SparkSession, path: str, kind: str, area: AreaOfInterest | None = None) -> PointsOfInterest:
        """The same from a saved Overpass answer."""
        return cls.areas_from_elements(osm.read_overpass_elements(spark, path), kind, area)

    def to_points(self, network: StreetNetwork, block: float = 500.0) -> PointsOfInterest:
        """Areas (pid, ``shape`` or closed ``ring``) as the points where streets enter them, other columns kept; those that no street enters go."""
        edges = network.edges.withColumn("edge", F.xxhash64("u", "v", "key_no"))
        at = snapping.boundary_points(self.places.select("pid", shapes.of(self.places).alias("shape")), edges, network.nodes, block).distinct().select("pid", "x", "y")
        return PointsOfInterest(at.join(self.places.drop("ring", "shape", "x", "y"), "pid"))

    def to_hex(self, values: dict[str, str], base: float, resolution: int) -> HexGrid:
        return HexGrid.from_points(self.places, values, base, resolution)

    def count(self) -> int:
        return self.places.count()


@dataclass
class HexGrid(Layer):
    """Cells (q, r, ...) of one resolution."""

    cells: DataFrame
    base: float
    resolution: int

    def tables(self) -> dict[str, DataFrame]:
        return {"cells": self.cells}

    def attributes(self) -> dict:
        return {"base": self.base, "resolution": self.resolution}

    @classmethod
    def from_points(cls, points: DataFrame, values: dict[str, str], base: float, resolution: int) -> HexGrid:
        """Values (name to first, last, min, max, mean or sum) of points per cell."""
        how = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "first": F.first, "last": F.last}
        cell = hexgrid.cell(F.col("x"), F.col("y"), hexgrid.edge(base, resolution))
        rows = points.withColumn("__c", cell).groupBy("__c").agg(*(how[m](v).alias(v) for v, m in values.items()))
        return cls(rows.select("__c.q", "__c.r", *values), base, resolution)

    @classmethod
    def from_shapes(cls, areas: DataFrame, key: str, values: dict[str, str], base: float, resolution: int, contain: str = "center", orders: dict | None = None) -> HexGrid:
        """Values of areas (``shape`` or closed ``ring``) per cell: those cells that each is in as ``contain`` says, values by ``hexcells.aggregate``."""
        size = hexgrid.edge(base, resolution)
        cells = hexcells.fill(areas, key, size, contain).groupBy(key).agg(F.collect_list(hexcells.cell_id(F.col("q"), F.col("r"))).alias("__cells"))
        rows = areas.drop("__cells").withColumn("__km2", shapes.area(shapes.of(areas)) / 1e6).join(cells, key)
        out = hexcells.aggregate(rows, "__cells", values, orders, key, hexcells.hex_area_km2(size), "__km2")
        q, r = hexcells.from_cell_id(F.col("cell"))
        return cls(out.select(q.alias("q"), r.alias("r"), *values), base, resolution)

    @classmethod
    def from_raster(cls, cells: DataFrame, grid: raster.Grid, base: float, resolution: int) -> HexGrid:
        """A raster's values shared among the cells that its pixels meet, the total kept."""
        return cls(hexcells.from_raster(raster.vectorize(cells, grid), hexgrid.edge(base, resolution)), base, resolution)

    def with_rings(self) -> DataFrame:
        """Cells with ``ring``, their closed boundary; cells without coordinates go."""
        corners = hexgrid.boundary(F.col("q"), F.col("r"), hexgrid.edge(self.base, self.resolution))
        return self.cells.filter("q IS NOT NULL AND r IS NOT NULL").withColumn("ring", F.concat(corners, F.slice(corners, 1, 1)))

    def clip(self, area: AreaOfInterest) -> HexGrid:
        """Cells whose centre lies in the area."""
        x, y = hexgrid.centre(F.col("q").cast("double"), F.col("r").cast("double"), hexgrid.edge(self.base, self.resolution))
        return HexGrid(area.clip(self.cells.withColumns({"x": x, "y": y})).drop("x", "y"), self.base, self.resolution)

    def resample(self, resolution: int, values: dict[str, str]) -> HexGrid:
        how = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
        up = hexgrid.parent(F.col("q"), F.col("r"), hexgrid.edge(self.base, self.resolution), hexgrid.edge(self.base, resolution))
        rows = self.cells.withColumn("__c", up).groupBy("__c").agg(*(how[m](v).alias(v) for v, m in values.items()))
        return HexGrid(rows.select("__c.q", "__c.r", *values), self.base, resolution)

    def join(self, other: HexGrid, how: str = "left") -> HexGrid:
        named = {c: f"{c}_right" for c in other.cells.columns if c not in ("q", "r") and c in self.cells.columns}
        return HexGrid(self.cells.join(other.cells.withColumnsRenamed(named), ["q", "r"], how), self.base, self.resolution)


@dataclass
class PopulationLayer(Layer):
    """A raster of population: cells (row_no, col, value) on a grid."""

    cells: DataFrame
    grid: dict

    def tables(self) -> dict[str, DataFrame]:
        return {"cells": self.cells}

    def attributes(self) -> dict:
        return {"grid": self.grid}

    @classmethod
    def of(cls, cells: DataFrame, grid: raster.Grid) -> PopulationLayer:
        return cls(cells, asdict(grid))

    @classmethod
    def from_ascii_grid(cls, spark: SparkSession, path: str) -> PopulationLayer:
        """Rows of the file run down from the top."""
        cells, h = files.read_ascii_grid(spark, path)
        size = h["cellsize"]
        x0, y0 = h.get("xllcorner", h.get("xllcenter", 0.0) - size / 2), h.get("yllcorner", h.get("yllcenter", 0.0) - size / 2)
        return cls.of(cells, raster.Grid(x0, y0 + size * h["nrows"], size, -size, int(h["nrows"]), int(h["ncols"])))

    @property
    def where(self) -> raster.Grid:
        return raster.Grid(**self.grid)

    def filter_by_streets(self, network: StreetNetwork, buffer: float, least: float = 0.0) -> PopulationLayer:
        ends = snapping.with_ends(network.edges, network.nodes)
        return PopulationLayer(population.filter_by_streets(self.cells, self.where, ends, buffer, least), self.grid)

    def density(self, buffer: float, shape: str = "disk") -> DataFrame:
        return raster.density(self.cells, self.where, buffer, shape)

    def to_hex(self, base: float, resolution: int) -> HexGrid:
        return HexGrid.from_raster(self.cells, self.where, base, resolution)

    def level_of_service(self, offer: DataFrame, thresholds: Sequence[tuple[float, float, str]], labels: Sequence[str], path: str | None = None) -> DataFrame:
        """Demand, offer and difference per cell; with ``path`` all layers are also written there."""
        levels = population.level_of_service(self.cells, self.where, offer, thresholds, labels)
        if path is not None:
            population.save_layers(levels, self.cells, path)
        return levels


@dataclass
class AccessScore(Layer):
    """The transit score's parameters; they are all that is saved, and functions are built from them."""

    parameters: dict = field(default_factory=lambda: dict(scoring.TRANSIT))

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def attributes(self) -> dict:
        return {"parameters": self.parameters}

    def score_stops(self, stops: DataFrame, headway: str = "headway", mode: str = "mode", speed: str = "speed") -> DataFrame:
        return stops.withColumn("score", scoring.TransitScore(self.parameters).stop()(F.col(headway), F.col(mode), F.col(speed)))

    def distance_matrix(self, stops: DataFrame, distances: Sequence[float], grid: Sequence[float]) -> DataFrame:
        """(score, distance, value) for the distinct stop scores."""
        model = scoring.TransitScore(self.parameters)
        return scoring.score_matrix(stops, "score", distances, model.walk, grid)


@dataclass
class AccessibilityAnalyzer(Layer):
    """Levels that places give to a street network's nodes and edges."""

    network: StreetNetwork
    pois: PointsOfInterest
    distances: Sequence[int]
    cell: int = 100
    result: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        inner = {f"network_{k}": v for k, v in self.network.tables().items()} | {f"pois_{k}": v for k, v in self.pois.tables().items()}
        return inner | {f"result_{k}": v for k, v in self.result.items()}

    def attributes(self) -> dict:
        return {"distances": list(self.distances), "cell": self.cell}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AccessibilityAnalyzer:
        tables, attributes = files.load(spark, path, cls.__name__)
        part = lambda p: {k.removeprefix(p): v for k, v in tables.items() if k.startswith(p)}
        return cls(StreetNetwork(**part("network_")), PointsOfInterest(**part("pois_")), result=part("result_"), **attributes)

    def run(self, min_edge: int = 0, max_distance: float = 1000.0, matrix: DataFrame | None = None, exact: bool = True) -> dict[str, DataFrame]:
        """Tables ``reach`` (node, rank_no, remaining), ``nodes`` (node, rank_no), ``edges`` with their labels, ``placed`` (pid, node) and
        ``points`` (id, x, y, rank_no): all nodes that edges name, those where places snap and edges are cut too.

        Places snap to their nearest streets, which get nodes there. ``matrix`` (quality, distance, rank_no) gives levels by quality, with
        the places' ``quality`` column; without it the distances are the levels. With ``exact`` edges are cut where a level's reach ends.
        """
        spark = self.network.nodes.sparkSession
        network, placed = self.network.add_points(self.pois.places.select("pid", "x", "y"), self.cell, max_distance, min_edge)
        quality = F.col("quality").cast("long") if matrix is not None else F.lit(1).cast("long")
        sources = placed.join(self.pois.places.select("pid", quality.alias("quality")), "pid").filter("node IS NOT NULL").select("quality", "node")
        matrix = isochrone.list_matrix(spark, self.distances) if matrix is None else matrix
        ranks = (matrix.agg(F.max("rank_no")).first()[0] or 0) + 1
        whole = network.edges.withColumn("len", F.round("len").cast("long"))  # whole metres, so that searches are exact
        reach = materialize(isochrone.reaches(whole, sources, matrix, network.nodes), "reach")
        edges = whole.withColumn("edge", F.xxhash64("u", "v", "key_no"))
        if exact:
            points, labelled = isochrone.result_network(network.nodes, edges.drop("key_no"), reach, ranks, min_edge)
            points, labelled = materialize(points, "result-points"), materialize(labelled, "result-edges")
        else:
            labelled = isochrone.edge_reaches(edges, reach, ranks, min_edge)
            points = network.nodes.join(isochrone.node_labels(reach, min_edge).withColumnRenamed("node", "id"), "id", "left").select("id", "x", "y", "rank_no")
        self.result = {"reach": reach, "nodes": isochrone.node_labels(reach, min_edge), "edges": labelled, "placed": placed, "points": points}
        return self.result

    def default_distance_matrix(self, steps: Sequence[int]) -> DataFrame:
        """The standard matrix over the qualities (thousandths) that the places have."""
        found = self.pois.places.select((F.col("quality") / 1000).alias("q")).filter("q > 0").distinct().limit(MAX_QUALITIES + 1).collect()
        if len(found) > MAX_QUALITIES:
            raise ValueError(f"more than {MAX_QUALITIES} qualities; round them first")
        return isochrone.default_matrix(self.network.nodes.sparkSession, sorted((r["q"] for r in found), reverse=True), steps)

    def run_buffers(self, points: DataFrame) -> DataFrame:
        """points (pid, x, y) with the best ring of straight-line distance, null where none reaches."""
        targets = self.pois.places.select(F.col("pid").alias("tid"), "x", "y")
        near = within(points.select("pid", "x", "y"), targets, max(self.distances))
        rank = F.lit(None).cast("int")
        for k in reversed(range(len(self.distances))):
            rank = F.when(F.col("d2") <= self.distances[k] ** 2, k).otherwise(rank)
        return points.select("pid").join(near.groupBy("pid").agg(F.min(rank).alias("rank_no")), "pid", "left")

    def buffer_rings(self, matrix: DataFrame | None = None, tile: float = 500.0) -> DataFrame:
        """Parts (rank_no, shape, area) of straight-line reach: each level without the better ones. Places have x, y or ``shape``."""
        quality = F.col("quality").cast("long") if matrix is not None else F.lit(1).cast("long")
        matrix = isochrone.list_matrix(self.network.nodes.sparkSession, self.distances) if matrix is None else matrix
        return overlay.rings_by_level(self.pois.places.withColumn("quality", quality), matrix, tile)

    def to_hex(self, base: float, resolution: int) -> HexGrid:
        """The best level of the nodes in each hexagon, those where places snap and edges are cut too."""
        levels = self.result["points"].filter("rank_no IS NOT NULL").select("x", "y", "rank_no")
        return HexGrid.from_points(levels, {"rank_no": "min"}, base, resolution)
