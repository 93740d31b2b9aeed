"""Street graphs as two tables: nodes (id, x, y) and edges (u, v, key_no, len)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry
from wayfield.operators.components import components
from wayfield.session import dealt, discard, materialize

#: Points of a component, or pairs left, that one task links.
MAX_TASK = 100_000


def keyed(edges: DataFrame, *order: str) -> DataFrame:
    """Edges with key_no counted per (u, v) in a total order."""
    w = Window.partitionBy("u", "v").orderBy(*(order or ("len",)))
    return edges.withColumn("key_no", (F.row_number().over(w) - 1).cast("int"))


def from_ways(ways: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of ways (way, nodes: array<long>) over positions (id, x, y): consecutive nodes are edges."""
    steps = ways.select("way", F.posexplode("nodes").alias("k", "u"))
    follow = steps.withColumn("v", F.lead("u").over(Window.partitionBy("way").orderBy("k"))).filter("v IS NOT NULL")
    a, b = positions.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), positions.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    edges = follow.join(a, "u").join(b, "v").select("u", "v", F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")).alias("len"), "way", "k")
    edges = keyed(edges, "way", "k").select("u", "v", "key_no", "len")
    used = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return positions.join(used, "id", "left_semi"), edges


def crop(nodes: DataFrame, edges: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with an end in ``inside`` (id), then the nodes that they have."""
    a, b = inside.select(F.col("id").alias("u")), inside.select(F.col("id").alias("v"))
    kept = edges.join(a, "u", "left_semi").union(edges.join(b, "v", "left_semi").select(*edges.join(a, "u", "left_semi").columns)).distinct()
    return nodes.join(kept.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi"), kept


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v")


def shortest_parallel(edges: DataFrame, undirected: bool = True) -> DataFrame:
    """One edge per pair of nodes: the shortest, then the least (u, v, key_no)."""
    pair = [F.least("u", "v"), F.greatest("u", "v")] if undirected else [F.col("u"), F.col("v")]
    w = Window.partitionBy(*pair).orderBy("len", "u", "v", "key_no")
    return edges.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def _close_pairs(xy: np.ndarray, limit: float) -> Iterator[tuple[float, int, int]]:
    """(distance, i, j), i < j, of all points at most ``limit`` apart, by grid cells of that size."""
    cells = defaultdict(list)
    for i, at in enumerate(map(tuple, np.floor(xy / (limit or 1.0)).tolist())):
        cells[at].append(i)
    for (cx, cy), own in cells.items():
        mine = np.array(own)
        for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
            if (other := cells.get((cx + dx, cy + dy))) is None:
                continue
            for i in mine:
                near = np.array(other)
                near = near[near > i] if dx == dy == 0 else near
                far = np.hypot(xy[i, 0] - xy[near, 0], xy[i, 1] - xy[near, 1])
                for j, d in zip(near[far <= limit].tolist(), far[far <= limit].tolist(), strict=True):
                    yield d, min(int(i), j), max(int(i), j)


def merges_of(pairs: Iterable[tuple[float, int, int]]) -> Iterator[tuple[int, int]]:
    """(gone, into): merges of complete linkage over all pairs (distance, a, b), a < b, that may merge. The nearest groups merge first (the least members
    among equals), and go by their least member."""
    far = defaultdict(dict)
    heap = list(pairs)
    for d, a, b in heap:
        far[a][b] = far[b][a] = d
    heapify(heap)
    while heap:
        d, a, b = heappop(heap)
        if far[a].get(b) != d:
            continue
        yield b, a
        mine, gone = far[a], far.pop(b)
        del mine[b], gone[a]
        for c in gone:
            del far[c][b]
        for c in [c for c in mine if c not in gone]:
            del mine[c], far[c][a]
        for c in mine:
            if gone[c] > mine[c]:
                mine[c] = far[c][a] = gone[c]
                heappush(heap, (gone[c], min(a, c), max(a, c)))


def _linked(xy: np.ndarray, limit: float, two_merge: bool) -> list[int]:
    """For each point the first point of its group, such that no two members of a group are farther apart than ``limit``.

    Groups farther apart than ``limit`` never merge, so only the pairs within it are held, however many points there are.
    """
    into = list(range(len(xy)))
    if len(xy) == 2 and two_merge:
        return [0, 0]
    for gone, a in merges_of(_close_pairs(xy, limit)):
        into[gone] = a
    for i in range(len(into)):  # groups go by their least member, so what a node merged into is settled before it
        into[i] = into[into[i]]
    return into


def _complete_linkage(limit: float):
    """Groups of each component (all rows are one, without that column) such that no two members are farther apart than ``limit``; two nodes always merge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["component", "id"] if "component" in pdf else ["id"]).reset_index(drop=True)
        ids, xy = pdf["id"].to_numpy(), pdf[["x", "y"]].to_numpy(dtype=float)
        component = pdf["component"].to_numpy() if "component" in pdf else np.zeros(len(ids))
        starts = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
        ends = np.concatenate([starts[1:], [len(ids)]])
        into = np.repeat(starts, ends - starts)
        for k in np.flatnonzero(ends - starts > 2):
            i, j = starts[k], ends[k]
            into[i:j] = i + np.array(_linked(xy[i:j], limit, True))
        return pd.DataFrame({"id": ids, "target": ids[into]})

    return run


def _linked_in_tasks(points: DataFrame, limit: float) -> DataFrame:
    """Components are dealt to all cores and come after each other in a task: most have two nodes, and a group of rows of its own for each
    costs more than its work."""
    targets = _complete_linkage(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["component"] == pdf["component"].iloc[-1]  # its rows may go on in the next batch
            held, whole = pdf[last], pdf[~last]
            if len(whole):
                yield targets(whole)
        if held is not None:
            yield targets(held)

    rows = dealt(points.select("component", "id", "x", "y"), "component").sortWithinPartitions("component", "id")
    return rows.mapInPandas(run, "id long, target long")


def linked(points: DataFrame, limit: float, max_task: int = MAX_TASK) -> DataFrame:
    """(id, target): the groups of points (id, x, y, component) by complete linkage in each component, as ``_linked`` has them, by their least id.

    Components of at most ``max_task`` points are one task's work each, the larger ones are linked by rounds.
    """
    size = points.groupBy("component").agg(F.count("*").alias("n"))
    large = materialize(size.filter(F.col("n") > max(max_task, 2)).select("component"), "large-components")
    if large.isEmpty():
        return _linked_in_tasks(points, limit)
    return _linked_in_tasks(points.join(large, "component", "left_anti"), limit).unionByName(_linked_by_rounds(points.join(large, "component", "left_semi"), limit, max_task))


def _near_pairs(points: DataFrame, limit: float) -> DataFrame:
    """(a, b, d), a < b, of points (id, x, y, component) of one component at most ``limit`` apart, by grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / (limit or 1.0)).cast("long")
    placed = points.select("component", "id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    shift = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    spread = placed.select("component", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.inline(shift))
    spread = spread.select("component", "id2", "x2", "y2", ((F.col("i") == 0) & (F.col("j") == 0)).alias("own"), (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    met = placed.join(spread, ["component", "cx", "cy"]).filter("NOT own OR id < id2").withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    return met.filter(F.col("d") <= limit).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "d")


def _linked_by_rounds(points: DataFrame, limit: float, max_task: int) -> DataFrame:
    """The groups that the nearest-first order gives, for components of any size.

    Two groups that are each other's nearest stay so whatever else merges, as no merge brings a third one nearer; so all of them merge at once. A round is
    an aggregate over ends, two joins and an aggregate over pairs, and is written. Rounds end when at most ``max_task`` pairs are left, which one
    task merges; there are few on street networks, and in the worst case (groups each nearer to the next, along a line) half as many as points.

    Points at one place are one from the start: nothing is nearer to them, and they are as far from all others.
    """
    spots = materialize(points.groupBy("component", "x", "y").agg(F.min("id").alias("id")), "linkage-spots")
    same = points.join(spots.withColumnRenamed("id", "a"), ["component", "x", "y"]).filter("id <> a").select(F.col("id").alias("b"), "a")
    pairs = materialize(_near_pairs(spots, limit), "linkage-pairs")
    done = [same]
    while pairs.count() > max_task:
        near = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("c"), "d", "a", "b"), F.struct(F.col("b").alias("c"), "d", "a", "b"))))
        nearest = near.groupBy("c").agg(F.min(F.struct("d", "a", "b")).alias("m"))
        mutual = nearest.groupBy("m").agg(F.count("*").alias("n")).filter("n = 2").select("m.a", "m.b")
        merged = materialize(mutual, "linkage-merges")
        done.append(merged.select("b", "a"))
        moved = merged.select(F.inline(F.array(F.struct(F.col("a").alias("c"), F.col("a").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to")))))
        side = lambda s: moved.select(F.col("c").alias(s), F.col("to").alias(f"{s}_to"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        end = lambda s: F.coalesce(f"{s}_to", s)
        of = lambda s: F.when(F.col(f"{s}_to").isNull(), 1).otherwise(2)
        named = both.select(F.least(end("a"), end("b")).alias("a"), F.greatest(end("a"), end("b")).alias("b"), "d", (of("a") * of("b")).alias("need")).filter("a <> b")
        whole = named.groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("need").alias("need"))
        after = materialize(whole.filter("n = need").select("a", "b", "d"), "linkage-pairs")
        discard(pairs)
        pairs = after

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = zip(pdf["d"].tolist(), pdf["a"].tolist(), pdf["b"].tolist(), strict=True)
        return pd.DataFrame(list(merges_of(rest)), columns=["b", "a"], dtype="int64")

    done.append(pairs.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(last, "b long, a long"))
    into = components(materialize(reduce(DataFrame.unionByName, done), "linkage-merges").select(F.col("b").alias("u"), F.col("a").alias("v")))
    return points.join(into.select(F.col("node").alias("id"), F.col("component").alias("target")), "id", "left").select("id", F.coalesce("target", "id").alias("target"))



def without_near_parallels(edges: DataFrame, separation: float) -> DataFrame:
    """Of edges (u, v, key_no, len, mx, my: its midpoint) between the same two nodes, those whose midpoints are at most ``separation``
    apart are one: the shortest stays (the least u, v, key_no among equals)."""
    pair = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    numbered = edges.select("*", *pair, F.row_number().over(Window.partitionBy(*pair).orderBy("len", "u", "v", "key_no")).alias("id"))
    beside = Window.partitionBy("a", "b")
    many = numbered.withColumn("n", F.count("*").over(beside)).filter("n > 1").select("a", "b", "id", "n", F.col("mx").alias("x"), F.col("my").alias("y"))
    # Of two the second goes where they are near; three and more are linked, pair after pair as the sorted rows come.
    order = beside.orderBy("id")
    apart = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    of_two = many.filter("n = 2").withColumn("apart", apart).filter(F.col("apart") <= separation).select("a", "b", "id")

    def gone_of(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, place = (pdf[c].to_numpy() for c in ("a", "b", "id"))
        xy = pdf[["x", "y"]].to_numpy(dtype=float)
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        gone = np.zeros(len(a), bool)
        for i, j in zip(starts, [*starts[1:], len(a)], strict=True):
            # A group goes by its least place, which is its shortest edge.
            gone[i:j] = np.array(_linked(xy[i:j], separation, False)) != np.arange(j - i)
        return pd.DataFrame({"a": a[gone], "b": b[gone], "id": place[gone]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["a"] == pdf["a"].iloc[-1]) & (pdf["b"] == pdf["b"].iloc[-1])  # its rows may go on in the next batch
            held, whole = pdf[last], pdf[~last]
            if len(whole):
                yield gone_of(whole)
        if held is not None:
            yield gone_of(held)

    sorted_pairs = many.filter("n > 2").select("a", "b", "id", "x", "y").repartition("a", "b").sortWithinPartitions("a", "b", "id")
    of_more = sorted_pairs.mapInPandas(run, "a long, b long, id int")
    return numbered.join(of_two.unionByName(of_more), ["a", "b", "id"], "left_anti").select(*edges.columns)


def contract_short(nodes: DataFrame, edges: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Merge nodes joined by edges of at most ``limit``: to their mean position, under the least id.

    Components over short edges are split where members are more than twice ``limit`` apart. Edges that fall inside one merged node go, and of
    the edges between two merged nodes of one component the shortest stays; others stay beside each other. An edge's ``line``, where there
    is one, is drawn to the merged nodes, and its length is the new line's; other columns stay.
    """
    short = edges.filter((F.col("len") <= limit) & (F.col("u") != F.col("v")))
    comp = components(short.select("u", "v"))
    placed = materialize(nodes.join(comp, nodes["id"] == comp["node"]).select("id", "x", "y", "component"), "short-components")
    target = materialize(linked(placed, 2 * limit), "short-targets")  # written, so that nodes are linked once for all that reads them
    moved = nodes.join(target, "id", "left").withColumn("target", F.coalesce("target", "id"))
    merged = moved.groupBy("target").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumnRenamed("target", "id")
    known = moved.select("id", "target").join(placed.select("id", "component"), "id", "left")
    there = known.join(merged.select(F.col("id").alias("target"), "x", "y"), "target")
    side = lambda s: there.select(F.col("id").alias(s), F.col("target").alias(f"{s}_t"), F.col("component").alias(f"{s}_c"), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))
    wired = edges.join(side("u"), "u").join(side("v"), "v").filter("u_t <> v_t OR u = v")
    others = [c for c in edges.columns if c not in ("u", "v", "key_no", "len", "line")]
    if "line" in edges.columns:
        first = F.when(F.col("u_c").isNotNull(), geometry.with_first(F.col("line"), F.col("u_x"), F.col("u_y"))).otherwise(F.col("line"))
        wired = wired.withColumn("line", first)
        wired = wired.withColumn("line", F.when(F.col("v_c").isNotNull(), geometry.with_last(F.col("line"), F.col("v_x"), F.col("v_y"))).otherwise(F.col("line")))
        wired = wired.withColumn("len", geometry.length(F.col("line")))
        others = ["line", *others]
    wired = wired.withColumn("__own", F.coalesce(F.col("u_c") == F.col("v_c"), F.lit(False))).select(F.col("u_t").alias("u"), F.col("v_t").alias("v"), "key_no", "len", *others, "__own")
    wired = materialize(wired, "contracted")
    within = shortest_parallel(wired.filter("__own"), undirected=False)
    return merged, keyed(within.unionByName(wired.filter("NOT __own")).drop("__own"), "len", "key_no")


def one_of_equal(edges: DataFrame) -> DataFrame:
    """Undirected edges from the smaller node to the larger, lines turned with them; one of those with equal ends, length and, where there is
    one, ``maxspeed``."""
    turned = F.col("u") > F.col("v")
    line = {"line": F.when(turned, F.reverse("line")).otherwise(F.col("line"))} if "line" in edges.columns else {}
    out = edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v"), **line})
    w = Window.partitionBy("u", "v", "len", *(["maxspeed"] if "maxspeed" in edges.columns else [])).orderBy("key_no")
    return keyed(out.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k"), "len", "key_no")


def with_midpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with mx, my: half-way along the ``line``, or between the ends where there are no lines."""
    if "line" in edges.columns:
        return edges.withColumn("__m", geometry.midpoint(F.col("line"))).withColumns({"mx": F.col("__m.x"), "my": F.col("__m.y")}).drop("__m")
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("x").cast("double").alias(f"__{s}x"), F.col("y").cast("double").alias(f"__{s}y"))
    out = edges.join(side("u"), "u").join(side("v"), "v")
    return out.withColumns({"mx": (F.col("__ux") + F.col("__vx")) / 2, "my": (F.col("__uy") + F.col("__vy")) / 2}).select(*edges.columns, "mx", "my")


def simplify(
    nodes: DataFrame, edges: DataFrame, min_edge: float = 0.0, loops: bool = False, multi: bool = False, separation: float = 0.0, undirected: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what says nothing new: loops (unless ``loops``), parallels (the shortest stays, or with ``multi`` one of equal ones), edges of
    at most ``min_edge``, contracted, and, with ``multi``, parallels whose midpoints are at most ``separation`` apart. Lines and other columns of edges stay."""
    if not loops:
        edges = without_loops(edges)
    if not multi:
        edges = keyed(shortest_parallel(edges, undirected), "len")
    elif undirected:
        edges = one_of_equal(edges)
    if min_edge > 0:
        nodes, edges = contract_short(nodes, edges, min_edge)
        return simplify(nodes, edges, 0.0, loops, multi, separation, undirected)
    if multi and separation > 0:
        edges = keyed(without_near_parallels(with_midpoints(nodes, edges), separation).drop("mx", "my"), "len", "key_no")
    return nodes, edges


def merge_snaps(snaps: DataFrame, limit: float) -> DataFrame:
    """Snaps (edge, pd, len, ...) with ``cut``: null near an end, else the mean of the snaps in the same bucket of ``limit``."""
    inner = (F.col("pd") >= limit) & (F.col("pd") <= F.col("len") - limit)
    bucket = F.round(F.col("pd") / limit) if limit > 0 else F.col("pd")
    mean = F.avg("pd").over(Window.partitionBy("edge", "__in", "__b"))
    return snaps.withColumns({"__in": inner, "__b": bucket}).withColumn("cut", F.when(F.col("__in"), mean)).drop("__in", "__b")


def split_edges(edges: DataFrame, cuts: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Edges (edge, u, v, len) cut at (edge, cut): the new nodes (id, edge, cut) and all edges (edge, u, v, len), lengths kept in sum. A ``line`` is cut
    at the same shares of its length; other columns go to every part. The new nodes are as many as the graph's edges, so joins exchange them."""
    named = cuts.select("edge", "cut").filter("cut IS NOT NULL").distinct().repartitionByRange("edge", "cut").sortWithinPartitions("edge", "cut")
    named = materialize(named.withColumn("id", F.monotonically_increasing_id() + first_id), "cut-nodes").hint("merge")  # written once, so that the ids hold
    ends = edges.select("edge", F.lit(0.0).alias("cut"), F.col("u").alias("id")).union(edges.select("edge", F.col("len").cast("double"), "v"))
    points = named.select("edge", F.col("cut").cast("double").alias("cut"), "id").union(ends)
    w = Window.partitionBy("edge").orderBy("cut", "id")
    parts = points.withColumns({"v": F.lead("id").over(w), "len": F.lead("cut").over(w) - F.col("cut")}).filter("v IS NOT NULL")
    out = parts.select("edge", F.col("id").alias("u"), "v", "len", "cut")
    others = [c for c in edges.columns if c not in ("edge", "u", "v", "len", "line")]
    if "line" in edges.columns or others:
        scale = geometry.length(F.col("line")) / F.col("__len") if "line" in edges.columns else None
        out = out.join(edges.select("edge", F.col("len").alias("__len"), *(["line"] if scale is not None else []), *others), "edge")
        if scale is not None:
            whole = (F.col("cut") <= 0) & (F.col("len") >= F.col("__len"))
            out = out.withColumn("line", F.when(whole, F.col("line")).otherwise(geometry.substring(F.col("line"), F.col("cut") * scale, (F.col("cut") + F.col("len")) * scale)))
        return named, out.select("edge", "u", "v", "len", *(["line"] if scale is not None else []), *others)
    return named, out.drop("cut")
