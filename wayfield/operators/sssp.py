"""Bounded multi-source shortest paths over an undirected street graph (edges u, v, len; sources grp, node, and label if asked for).

Small graphs (edges are counted first) are sent to every task once, as arrays; the sources of a group are dealt into stretches of node ids, each is
searched by whole frontiers in its own task, and the least distance of a node over the stretches counts, so one group uses all cores.

Larger graphs are cut into cells of bounded size. A cell is one row of a table: its nodes, the arcs inside it and those that leave it. In a round every cell
that got better distances at some of its nodes is searched to its end, and what that betters beyond its border goes to the next cells as messages, the best
for each node. Rounds are as many as cells lie along a shortest path, not as many as arcs do; every round is written to the shared folder, so
a lost executor repeats one round at most. Cells are squares of the nodes' coordinates where these are given, cut into quarters until each is small enough,
else stretches of node ids; the choice changes the work and not the result.

Distances are exact for whole-number lengths. With a ``label`` (a long) the least label among the nearest sources comes along, so one search
names the nearest source of every node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.session import discard, exchanged_joins, materialize

MAX_BROADCAST_EDGES = 2_000_000
#: Nodes of a cell; sources that make a stretch of their own worth while.
CELL_NODES, STRETCH = 20_000, 256


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "len").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "len")).filter("u <> v")


def bounded_distances(edges: DataFrame, sources: DataFrame, cutoff: int, max_broadcast_edges: int = MAX_BROADCAST_EDGES, nodes: DataFrame | None = None) -> DataFrame:
    """(grp, node, dist[, label]): the least distance from any source of the group, where it is at most ``cutoff``. ``nodes`` (id, x, y) places
    the cells of a large graph."""
    labelled = "label" in sources.columns
    label = F.col("label").cast("long") if labelled else F.lit(0).cast("long").alias("label")
    sources = sources.select("grp", "node", label.alias("label")).groupBy("grp", "node").agg(F.min("label").alias("label"))
    arcs = both_ways(edges).groupBy("u", "v").agg(F.min("len").alias("len"))
    if edges.limit(max_broadcast_edges + 1).count() <= max_broadcast_edges:
        out = _in_tasks(edges.sparkSession, arcs.toArrow(), sources, cutoff)
    else:
        out = in_cells(arcs, sources, cutoff, nodes)
    return out if labelled else out.drop("label")


def frontiers(starts: np.ndarray, heads: np.ndarray, lengths: np.ndarray, at: np.ndarray, labels: np.ndarray, cutoff) -> tuple[np.ndarray, np.ndarray]:
    """Distance (cutoff + 1 where not reached) and label of every node, from the nodes ``at``; arcs are in CSR form."""
    n = len(starts) - 1
    dist, label = np.full(n, cutoff + 1, dtype=lengths.dtype), np.full(n, np.iinfo(np.int64).max)
    dist[at], label[at] = 0, labels
    relax(starts, heads, lengths, dist, label, at, cutoff)
    return dist, label


def relax(starts: np.ndarray, heads: np.ndarray, lengths: np.ndarray, dist: np.ndarray, label: np.ndarray, at: np.ndarray, cutoff) -> np.ndarray:
    """Carry on a search in place from nodes ``at`` whose distances have just got better; which nodes have got better, those too."""
    touched = np.zeros(len(dist), bool)
    touched[at] = True
    while len(at):
        many = starts[at + 1] - starts[at]
        arc = np.arange(many.sum()) + np.repeat(starts[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        to, far, name = heads[arc], np.repeat(dist[at], many) + lengths[arc], np.repeat(label[at], many)
        better = (far <= cutoff) & ((far < dist[to]) | ((far == dist[to]) & (name < label[to])))
        to, far, name = to[better], far[better], name[better]
        order = np.lexsort((name, far, to))
        to, far, name = to[order], far[order], name[order]
        first = np.flatnonzero(np.concatenate([[len(to) > 0], to[1:] != to[:-1]]))
        at = to[first]
        dist[at], label[at] = far[first], name[first]
        touched[at] = True
    return np.flatnonzero(touched)


def _in_tasks(spark: SparkSession, arcs: pa.Table, sources: DataFrame, cutoff: int) -> DataFrame:
    u, v, lengths = (arcs.column(c).to_numpy() for c in ("u", "v", "len"))
    order = np.lexsort((v, u))
    u, v, lengths = u[order], v[order], lengths[order]
    names = np.unique(np.concatenate([u, v])) if len(u) else np.empty(0, dtype=np.int64)
    starts = np.searchsorted(np.searchsorted(names, u), np.arange(len(names) + 1))
    graph = spark.sparkContext.broadcast((names, starts, np.searchsorted(names, v), lengths))

    def search(group: pa.Table) -> pa.Table:
        names, starts, heads, lengths = graph.value
        grp, node, mark = group.column("grp")[0].as_py(), group.column("node").to_numpy(), group.column("label").to_numpy()
        known = np.isin(node, names)
        dist, label = frontiers(starts, heads, lengths, np.searchsorted(names, node[known]), mark[known], cutoff)
        hit = np.flatnonzero(dist <= cutoff)
        lone = np.zeros((~known).sum(), dtype=np.int64)  # sources that no edge has
        columns = [np.concatenate([names[hit], node[~known]]), np.concatenate([dist[hit].astype(np.int64), lone]), np.concatenate([label[hit], mark[~known]])]
        return pa.table([pa.array([grp] * len(columns[0]), pa.int64()), *map(pa.array, columns)], names=["grp", "node", "dist", "label"])

    low, wide = (int(names[0]), int(names[-1]) - int(names[0]) + 1) if len(names) else (0, 1)
    parts = max(1, min(spark.sparkContext.defaultParallelism, sources.count() // STRETCH))
    stretch = F.floor((F.col("node") - low) / F.lit(wide) * parts).cast("long")
    found = sources.withColumn("stretch", stretch).groupBy("grp", "stretch").applyInArrow(search, "grp long, node long, dist long, label long")
    if parts == 1:
        return found
    return found.groupBy("grp", "node").agg(F.min(F.struct("dist", "label")).alias("b")).select("grp", "node", "b.dist", "b.label")


def cells_of(arcs: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(node, cell): a cell has at most CELL_NODES nodes, unless nodes lie on one spot."""
    if nodes is None:
        ids = arcs.select(F.col("u").alias("node")).distinct()
        n, low, high = ids.agg(F.count("*"), F.min("node"), F.max("node")).first()
        width = max(1, (high - low + 1) * CELL_NODES // n) if n else 1
        return materialize(ids.select("node", F.expr(f"(node - {low or 0}L) div {width}L").alias("cell")), "cells")
    spots = nodes.select(F.col("id").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    x0, y0, x1, y1 = spots.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    side = max((x1 or 0) - (x0 or 0), (y1 or 0) - (y0 or 0), 1e-9)
    waiting, done = spots, []
    for level in range(40):
        k = 1 << level
        index = lambda v, v0: F.least(F.floor((F.col(v) - v0) / side * k), F.lit(k - 1)).cast("long")  # noqa: B023, E731
        placed = waiting.withColumns({"cx": index("x", x0), "cy": index("y", y0)})
        load = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"))
        small = materialize(placed.join(load.filter(F.col("n") <= CELL_NODES), ["cx", "cy"]).select("node", F.xxhash64(F.lit(level), "cx", "cy").alias("cell")), "cells")
        done.append(small)
        waiting = materialize(placed.join(load.filter(F.col("n") > CELL_NODES), ["cx", "cy"]).select("node", "x", "y"), "cells-waiting")
        if waiting.isEmpty():
            break
    else:
        done.append(waiting.select("node", F.xxhash64("x", "y").alias("cell")))
    out = materialize(reduce(DataFrame.unionByName, done), "cells")
    for t in [*done, waiting]:
        discard(t)
    return out


#: A cell of the graph, arrays as bytes of longs: its nodes in order, arcs inside it in CSR form, arcs that leave it.
CELL = "cell long, names binary, starts binary, heads binary, lengths binary, tails binary, far binary, far_cells binary, far_lengths binary"
#: What a cell knows of a group (kind 0) or is told (kind 1): nodes with distances and labels.
TOLD = "kind int, grp long, cell long, node array<long>, dist array<long>, label array<long>"


def _or_own(cell: str, node: str):
    """The cell of a node; one that has no coordinates is in a cell by its id."""
    return F.coalesce(cell, F.expr(f"{node} div {CELL_NODES}L"))


def _cell_graphs(arcs: DataFrame, cells: DataFrame) -> DataFrame:
    cell = lambda s, name: cells.select(F.col("node").alias(s), F.col("cell").alias(name))
    placed = arcs.join(cell("u", "cell"), "u", "left").join(cell("v", "far_cell"), "v", "left")
    placed = placed.withColumns({"cell": _or_own("cell", "u"), "far_cell": _or_own("far_cell", "v")})

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        u, v, far_cell, lengths = (table.column(c).to_numpy().astype(np.int64) for c in ("u", "v", "far_cell", "len"))
        inside = far_cell == key[0].as_py()
        names = np.unique(u)
        tail, head = np.searchsorted(names, u), np.searchsorted(names, v[inside])
        order = np.lexsort((head, tail[inside]))
        starts = np.searchsorted(tail[inside][order], np.arange(len(names) + 1))
        parts = [names, starts, head[order], lengths[inside][order], tail[~inside], v[~inside], far_cell[~inside], lengths[~inside]]
        columns = [pa.array([key[0].as_py()], pa.int64()), *(pa.array([p.astype(np.int64).tobytes()], pa.binary()) for p in parts)]
        return pa.Table.from_arrays(columns, names=["cell", "names", "starts", "heads", "lengths", "tails", "far", "far_cells", "far_lengths"])

    return placed.groupBy("cell").applyInArrow(build, CELL)


def _told(kind: int, grp: int, cell: int, node: np.ndarray, dist: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([a.tolist()], pa.list_(pa.int64())) for a in (node, dist, label)]
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([grp], pa.int64()), pa.array([cell], pa.int64()), *lists], names=["kind", "grp", "cell", "node", "dist", "label"])


def in_cells(arcs: DataFrame, sources: DataFrame, cutoff: int, nodes: DataFrame | None = None) -> DataFrame:
    """(grp, node, dist, label) by rounds over cells. Sources that no arc has reach themselves. All joins are by exchanges: the tables of a
    large graph are small files when written, and Spark would send them whole through the driver in every round; what is found is marked likewise."""
    with exchanged_joins(arcs.sparkSession):
        return _by_rounds(arcs, sources, cutoff, nodes).hint("merge")


def _by_rounds(arcs: DataFrame, sources: DataFrame, cutoff: int, nodes: DataFrame | None) -> DataFrame:

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, starts, heads, lengths, tails, far, far_cells, far_lengths = (np.frombuffer(row[c], np.int64) for c in ("names", "starts", "heads", "lengths", "tails", "far", "far_cells", "far_lengths"))
                dist, label = np.full(len(names), cutoff + 1), np.full(len(names), np.iinfo(np.int64).max)
                if row["known"]:
                    at = np.searchsorted(names, row["known"]["node"])
                    dist[at], label[at] = row["known"]["dist"], row["known"]["label"]
                told = np.array([(m["node"], m["dist"], m["label"]) for m in row["told"]], np.int64).reshape(-1, 3)
                at = np.searchsorted(names, told[:, 0])
                better = (told[:, 1] < dist[at]) | ((told[:, 1] == dist[at]) & (told[:, 2] < label[at]))
                at, told = at[better], told[better]
                if not len(at):
                    continue
                dist[at], label[at] = told[:, 1], told[:, 2]
                changed = relax(starts, heads, lengths, dist, label, at, cutoff)
                hit = np.flatnonzero(dist <= cutoff)
                yield _told(0, row["grp"], row["cell"], names[hit], dist[hit], label[hit])
                mark = np.zeros(len(names), bool)
                mark[changed] = True
                out = np.flatnonzero(mark[tails] & (dist[tails] + far_lengths <= cutoff))
                for cell in np.unique(far_cells[out]):
                    mine = out[far_cells[out] == cell]
                    yield _told(1, row["grp"], int(cell), far[mine], dist[tails[mine]] + far_lengths[mine], label[tails[mine]])

    cells = cells_of(arcs, nodes)
    graphs = materialize(_cell_graphs(arcs, cells), "cell-graphs")
    ends = arcs.select(F.col("u").alias("node")).distinct()
    start = sources.withColumn("dist", F.lit(0).cast("long"))
    lone = start.join(ends, "node", "left_anti").select("grp", "node", "dist", "label")
    first = start.join(ends, "node", "left_semi").join(cells, "node", "left").select("grp", _or_own("cell", "node").alias("cell"), "node", "dist", "label")
    told, rounds = first, []
    while True:
        # One message for each node, then one list for each cell; a cell has a bounded number of nodes.
        least = told.groupBy("grp", "cell", "node").agg(F.min(F.struct("dist", "label")).alias("b")).select("grp", "cell", F.struct("node", "b.dist", "b.label").alias("m"))
        news = least.groupBy("grp", "cell").agg(F.collect_list("m").alias("told"))
        if rounds:
            # One row for each group and cell in a round, so the latest one is found among few.
            past = reduce(DataFrame.unionByName, [t.filter("kind = 0").select("grp", "cell", F.struct("node", "dist", "label").alias("known"), F.lit(i).alias("i")) for i, t in enumerate(rounds)])
            latest = past.join(news.select("grp", "cell"), ["grp", "cell"], "left_semi").groupBy("grp", "cell").agg(F.max_by("known", "i").alias("known"))
            news = news.join(latest, ["grp", "cell"], "left")
        else:
            news = news.withColumn("known", F.lit(None).cast("struct<node:array<long>,dist:array<long>,label:array<long>>"))
        after = materialize(news.join(graphs, "cell").mapInArrow(search, TOLD), "round")
        rounds.append(after)
        messages = after.filter("kind = 1")
        if messages.isEmpty():
            break
        told = messages.select("grp", "cell", F.explode(F.arrays_zip("node", "dist", "label")).alias("m")).select("grp", "cell", "m.node", "m.dist", "m.label")
    past = reduce(DataFrame.unionByName, [t.filter("kind = 0").select("grp", "cell", F.struct("node", "dist", "label").alias("known"), F.lit(i).alias("i")) for i, t in enumerate(rounds)])
    last = past.groupBy("grp", "cell").agg(F.max_by("known", "i").alias("known"))
    reached = last.select("grp", F.explode(F.arrays_zip("known.node", "known.dist", "known.label")).alias("m")).select("grp", F.col("m.node").alias("node"), F.col("m.dist").alias("dist"), F.col("m.label").alias("label"))
    out = materialize(reached.unionByName(lone), "reach")
    for t in [*rounds, graphs, cells]:
        discard(t)
    return out
