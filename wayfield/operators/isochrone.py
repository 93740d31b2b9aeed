"""Accessibility levels on a street graph: per level its reach, exact cuts of edges, labels of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.operators.graph import split_edges
from wayfield.operators.raster import rank_of
from wayfield.operators.snapping import cut_places
from wayfield.operators.sssp import bounded_distances


def reaches(edges: DataFrame, pois: DataFrame, matrix: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank_no, remaining): the largest remaining distance per rank (0 best), from pois (node, quality) and
    matrix (quality, distance, rank_no). One search per quality, cut off at its largest distance, serves all ranks.
    ``nodes`` (id, x, y) places the cells of a large graph."""
    limit = matrix.agg(F.max("distance")).first()[0] or 0
    reach = bounded_distances(edges, pois.select(F.col("quality").cast("long").alias("grp"), "node"), limit, nodes=nodes)
    widest = matrix.groupBy(F.col("quality").cast("long").alias("grp"), "rank_no").agg(F.max("distance").alias("distance"))
    left = reach.join(F.broadcast(widest), "grp").withColumn("remaining", F.col("distance") - F.col("dist")).filter("remaining >= 0")
    return left.groupBy("node", "rank_no").agg(F.max("remaining").alias("remaining"))


def node_labels(reach: DataFrame, min_edge: int = 0) -> DataFrame:
    """(node, rank_no): the best rank that reaches farther than ``min_edge`` past the node; as large as the graph, so joins exchange it."""
    return reach.filter(F.col("remaining") > min_edge).groupBy("node").agg(F.min("rank_no").alias("rank_no")).hint("merge")


def _wide(reach: DataFrame, ranks: int, side: str) -> DataFrame:
    """A row per node with what is left per rank; as large as the graph, so joins exchange it."""
    return reach.groupBy(F.col("node").alias(side)).agg(*(F.max(F.when(F.col("rank_no") == k, F.col("remaining"))).alias(f"{side}_{k}") for k in range(ranks))).hint("merge")


def edge_reaches(edges: DataFrame, reach: DataFrame, ranks: int, min_edge: int = 0) -> DataFrame:
    """Edges (edge, u, v, len) with ``rank_no`` (best rank whose reaches from both ends meet) and the cuts per rank.

    A cut from an end lies at the rank's reach if that is inside the edge by ``min_edge``, past what better ranks
    reach from there and short of what they reach from the other end. Two cuts that overlap are no cuts. ``after`` is the label of
    a node at the cut: the best of the worse ranks that reach past it from there.
    """
    out = edges.join(_wide(reach, ranks, "u"), "u", "left").join(_wide(reach, ranks, "v"), "v", "left")
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    room, label, cuts = F.col("len") - min_edge, F.lit(None).cast("int"), []
    better: dict[str, Column] = {"u": F.lit(0), "v": F.lit(0)}

    def after(side: str, k: int) -> Column:
        found = F.lit(None).cast("int")
        for a in range(ranks - 1, k, -1):
            nearer = [zero(f"{side}_{b}") for b in range(a)]
            past = (zero(f"{side}_{a}") > (F.greatest(*nearer) if len(nearer) > 1 else nearer[0])) & (zero(f"{side}_{a}") > min_edge)
            found = F.when(past, a).otherwise(found)
        return found.alias("after")

    for k in range(ranks):
        u, v = zero(f"u_{k}"), zero(f"v_{k}")
        label = F.coalesce(label, F.when(u + v > room, k))
        at = {}
        for mine, other, value in (("u", "v", u), ("v", "u", v)):
            ok = (value >= min_edge) & (value > 0) & (value <= room) & (value <= room - better[other]) & (value >= better[mine] + min_edge)
            at[mine] = F.when(ok, value)
        both = F.coalesce(at["u"], F.lit(0)) + F.coalesce(at["v"], F.lit(0)) <= room
        cuts += [F.struct(F.lit(k).alias("rank_no"), F.when(both, at["u"]).alias("at"), after("u", k)), F.struct(F.lit(k).alias("rank_no"), F.when(both, F.col("len") - at["v"]).alias("at"), after("v", k))]
        better = {"u": F.greatest(better["u"], u), "v": F.greatest(better["v"], v)}
    return out.select("edge", "u", "v", "len", label.alias("rank_no"), F.filter(F.array(*cuts), lambda c: c["at"].isNotNull()).alias("cuts"))


def edge_labels(edges: DataFrame, reach: DataFrame, ranks: int, min_edge: int = 0) -> DataFrame:
    """Edges (edge, u, v, len) with ``rank_no``: the best of both ends' labels and of what both ends' reaches cover together; null without any."""
    own = edge_reaches(edges, reach, ranks, min_edge).drop("cuts")
    labels = node_labels(reach, min_edge)
    side = lambda s: labels.select(F.col("node").alias(s), F.col("rank_no").alias(f"{s}_rank"))
    out = own.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return out.withColumn("rank_no", F.least("rank_no", "u_rank", "v_rank")).select("edge", "u", "v", "len", "rank_no")


def default_matrix(spark, qualities: Sequence[float], steps: Sequence[float]) -> DataFrame:
    """(poi_quality, distance, value): 1 - (place of quality, best first + place of step) / (qualities + steps - 1), an implicit quality 0
    counted, not under 0, three decimals."""
    ordered = sorted(set(qualities), reverse=True)
    whole = len(ordered) + 1 + len(steps) - 2
    rows = [(float(q), int(s), round(max(0.0, 1 - (i + j) / whole), 3)) for i, q in enumerate(ordered) for j, s in enumerate(steps)]
    return spark.createDataFrame(rows, "poi_quality double, distance int, value double")


def exact(edges: DataFrame, reach: DataFrame, ranks: int, first_id: int, min_edge: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cut nodes (id, edge, cut, rank_no: their own label, null for none) and edges (edge, u, v, len, rank_no) with every edge cut where
    a rank's reach ends."""
    judged = edge_reaches(edges, reach, ranks, min_edge)
    cuts = judged.select("edge", "len", F.explode("cuts").alias("c")).select("edge", "len", F.col("c.at").alias("cut"), "c.after").filter("cut > 0 AND cut < len")
    named, parts = split_edges(edges, cuts.select("edge", "cut"), first_id)
    named = named.join(cuts.groupBy("edge", "cut").agg(F.min("after").alias("rank_no")), ["edge", "cut"]).hint("merge")
    wide = edges.select("edge", F.col("u").alias("eu"), F.col("v").alias("ev"), F.col("len").alias("elen")).join(_wide(reach, ranks, "u").withColumnRenamed("u", "eu"), "eu", "left").join(_wide(reach, ranks, "v").withColumnRenamed("v", "ev"), "ev", "left")
    at = named.select(F.col("id"), F.col("cut"))
    placed = parts.join(at.withColumnRenamed("id", "u").withColumnRenamed("cut", "from"), "u", "left").join(at.withColumnRenamed("id", "v").withColumnRenamed("cut", "to"), "v", "left")
    placed = placed.join(wide.hint("merge"), "edge").withColumns({"from": F.coalesce("from", F.lit(0.0)), "to": F.coalesce("to", F.col("elen").cast("double"))})
    middle, label = (F.col("from") + F.col("to")) / 2, F.lit(None).cast("int")
    for k in range(ranks):
        label = F.coalesce(label, F.when((F.coalesce(F.col(f"u_{k}"), F.lit(-1)) >= middle) | (F.coalesce(F.col(f"v_{k}"), F.lit(-1)) >= F.col("elen") - middle), k))
    others = [c for c in edges.columns if c not in ("edge", "u", "v", "len")]
    return named, placed.select("edge", "u", "v", "len", label.alias("rank_no"), *others)


def result_network(nodes: DataFrame, edges: DataFrame, reach: DataFrame, ranks: int, min_edge: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y, rank_no) and edges (edge, u, v, len, rank_no) of a graph (nodes: id, x, y; edges: edge, u, v, len) cut where the reach of a
    rank ends: every end of an edge is a node there. Cut nodes get ids after the largest, lie on the edge's line (or
    straight between its ends) and have labels of their own; an edge has the best of what its place on the old edge is reached with."""
    last = nodes.agg(F.max("id")).first()[0]
    named, parts = exact(edges, reach, ranks, (last or 0) + 1, min_edge)
    fresh = cut_places(named, edges, nodes, "rank_no")
    old = nodes.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(node_labels(reach, min_edge).withColumnRenamed("node", "id"), "id", "left")
    return old.unionByName(fresh), parts


def nearest_origin(edges: DataFrame, pois: DataFrame, cutoff: int, nodes: DataFrame | None = None) -> DataFrame:
    """(node, poi, dist): the nearest poi (poi, node) of every node within the cutoff; the least id among equals. One search."""
    sources = pois.select(F.lit(1).cast("long").alias("grp"), "node", F.col("poi").alias("label"))
    return bounded_distances(edges, sources, cutoff, nodes=nodes).select("node", F.col("label").alias("poi"), "dist")


def served(reach: DataFrame, origins: DataFrame) -> DataFrame:
    """(node, rank_no, remaining, poi): levels of nodes with the place that serves each."""
    return reach.join(origins.select("node", "poi"), "node", "left")


def processing_order(matrix: DataFrame, values: Sequence | None = None) -> DataFrame:
    """(rank_no, distance, qualities, value) of a long matrix (quality, distance, value): the farthest distance at which a quality still
    gives a value, qualities with the same one together; the worst rank first, far before near.

    Ranks go by ``values``, best first; without it by the values themselves, highest first.
    """
    widest = matrix.filter("value IS NOT NULL").groupBy("quality", "value").agg(F.max("distance").alias("distance"))
    if values is None:
        ranked = widest.withColumn("rank_no", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"))) - 1)  # a matrix is a few dozen rows
    else:
        ranked = widest.withColumn("rank_no", rank_of(F.col("value"), values))
    grouped = ranked.groupBy("rank_no", "distance").agg(F.array_sort(F.collect_set("quality")).alias("qualities"), F.first("value").alias("value"))
    return grouped.orderBy(F.desc("rank_no"), F.desc("distance"))


def list_matrix(spark, distances: Sequence[int], quality: int = 1) -> DataFrame:
    """A list of distances as a matrix: one rank per distance, by position."""
    return spark.createDataFrame([(quality, int(x), i) for i, x in enumerate(distances)], "quality long, distance long, rank_no int")
