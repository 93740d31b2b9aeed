"""Jaccard self-join of shingle sets by vertical partitioning of the global shingle order.

The global order puts rare shingles first: a count sketch over all texts gives each shingle a
frequency class, ties go by hash. In that order a set of n shingles can only be linked with
another if they share one of its first n - ceil(0.75 n) + 1 (its prefix), so the fragment of the order
that holds a shared shingle brings the two together. Then each pair is counted exactly: the order is cut by pivots
into ``FRAGMENTS`` runs of about equal numbers of shingles in all, both sets are cut at the same pivots, a join per
fragment counts the partial overlaps, and these are summed per pair.

Texts with equal sets are one class from the start and meet no more. Links are searched for
components, not for all pairs: at a shingle, members are compared with the leaders of the
components there; when leaders have joined what they can, pairs that still are in different
components are compared exhaustively, so no link between different texts is lost, while a
group of near copies never meets all against all. A pair is left out only where no overlap of
0.75 is possible: by the sets' sizes, or by the places at which the shared shingle stands.

Exchanges carry hashes only. The text is read twice more for sets of classes that are candidates;
the list of those is sent to all tasks where it is counted and small, and joined otherwise.

Defined cases: null or empty text has an empty set and is linked with nothing; with fewer words than
a shingle the whole sequence is one; texts of any length count whole; repeated rows are one class; null doc_id
takes no part in the least doc_id; an empty table gives no rows; extra columns, whatever their names, are ignored
(``keep_one`` keeps them as they are, and of rows with the same doc_id and text one).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.llm.carry import packed, unpacked
from wayfield.operators.components import components
from wayfield.llm.tokens64 import shingle_set, word_hashes
from wayfield.llm.word_ids import raw_texts, short_batches
from wayfield.session import discard, exchanged_joins, materialize, small_batches

WORDS = 5
#: The threshold as a fraction, so that every comparison is between whole numbers.
NUMERATOR, DENOMINATOR = 3, 4
SKETCH_BITS = 20
SKETCH_SLICES = 16
FRAGMENTS = 4
LEADERS = 4
LEADER_ROUNDS = 2
MAX_BROADCAST_CLASSES = 2_000_000
#: Classes that a task remembers having sent; what it forgets is sent again and merged.
MAX_SEEN = 100_000
_PLACE_BITS = 32


def _class_of(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(shingles.tobytes())], dtype=np.uint64).view(np.int64)[0])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles per cell, 4 to 8 cells a shingle, as longs. Where two sets' bitmaps differ in x cells,
    they differ in x shingles at least."""
    cells = max(64, 1 << int(4 * len(shingles) - 1).bit_length())
    odd = np.bincount(((shingles >> np.uint64(SKETCH_BITS)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differ() -> str:
    """How many cells of u_bits and v_bits differ, the larger bitmap folded to the smaller's cells."""
    half = lambda x, n: f"CASE WHEN size({x}) > {n} THEN zip_with(slice({x}, 1, {n}), slice({x}, {n} + 1, {n}), (p, q) -> p ^ q) ELSE {x} END"
    least = "least(size(u_bits), size(v_bits))"
    return f"aggregate(zip_with({half('u_bits', least)}, {half('v_bits', least)}, (p, q) -> bit_count(p ^ q)), 0, (a, x) -> a + x)"


def sketch_slices(counts: np.ndarray) -> list[bytes]:
    """A task's counts, cut into slices that can be added up row by row."""
    return [part.astype("<u4").tobytes() for part in np.split(counts, SKETCH_SLICES)]


def sketch_of(slices: DataFrame) -> np.ndarray:
    """The whole sketch from all tasks' (slice, counts); its size is fixed, whatever the input's. Slices come to the driver deflated."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(part, dtype="<u4").astype(np.int64)
                sums[k] = sums[k] + got if k in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), dtype=np.int64)
    for row in slices.repartition(SKETCH_SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return out.ravel()


def read_once(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, np.ndarray]:
    """Per row doc_id, content (hash of the text), n (set size), cls (hash of the set; null where empty) and the set's
    bitmap (once per class and task); and a count sketch of all shingles by the low bits of their hash.

    The sketch is 2**SKETCH_BITS numbers, whatever the input's size. Tasks write slices of their counts next to the
    rows; a slice is added up row by row, so that memory is that of one slice.
    """
    cells = 1 << SKETCH_BITS
    shape = "doc_id long, content long, n long, cls long, bits array<long>, slice int, counts binary"
    names = [f.split()[0] for f in shape.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(cells, dtype=np.int64), set()
        for batch in short_batches(batches):
            ns, cls, bits, lows = [], [], [], []
            for raw in raw_texts(batch.column(2)):
                s = shingle_set(word_hashes(raw), WORDS)
                ns.append(len(s))
                c = _class_of(s) if len(s) else None
                cls.append(c)
                if c is None or c in seen:
                    bits.append(None)
                    continue
                seen.add(c)
                bits.append(bitmap(s))
                lows.append((s & np.uint64(cells - 1)).astype(np.int64))
            if len(seen) > MAX_SEEN:
                seen.clear()
            if lows:
                total += np.bincount(np.concatenate(lows), minlength=cells)
            nothing = [None] * len(ns)
            columns = (batch.column(0), batch.column(1), ns, cls, bits, nothing, nothing)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        nothing = [None] * SKETCH_SLICES
        columns = (*[nothing] * 5, range(SKETCH_SLICES), sketch_slices(total))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).cast("string").alias("text"))
    both = materialize(rows.mapInArrow(run, shape), "classes")
    return both.filter("slice IS NULL").select("doc_id", "content", "n", "cls", "bits"), sketch_of(both.filter("slice IS NOT NULL").select("slice", "counts"))


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for what does not stand out from the sketch's noise (six deviations of a Poisson count), else the doublings above it."""
    mean = float(counts.mean())
    noise = 6.0 * max(1.0, mean**0.5)
    return np.clip(np.floor(np.log2(np.maximum(counts - mean, 1e-9) / noise)) + 1, 0, 60).astype(np.uint8)


def fragment_pivots(counts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places in the order (class, plus the hash as a share of its range) that cut it into fragments of about equal counts."""
    mass = np.bincount(ranks, weights=counts.astype(np.float64))
    ends = np.cumsum(mass)
    wanted = ends[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
    at = np.searchsorted(ends, wanted)
    return at + (wanted - (ends[at] - mass[at])) / np.maximum(mass[at], 1.0)


def prefix_length(n: int) -> int:
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def prefixes(docs: DataFrame, ranks: np.ndarray, text: str) -> DataFrame:
    """token, cls and packed (n, place) of every class's prefix; copies within a task come once."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, mask = shared.value, np.uint64(len(shared.value) - 1)
        seen: set[int] = set()
        for batch in short_batches(batches):
            tokens, owners, packed = [], [], []
            for raw in raw_texts(batch.column(0)):
                s = shingle_set(word_hashes(raw), WORDS)
                if not len(s) or (cls := _class_of(s)) in seen:
                    continue
                seen.add(cls)
                m = prefix_length(len(s))
                order = np.argsort(rank[(s & mask).astype(np.int64)], kind="stable")[:m]
                tokens.append(s[order].view(np.int64))
                owners.append(np.full(m, cls, dtype=np.int64))
                packed.append((len(s) << _PLACE_BITS) | np.arange(m, dtype=np.int64))
            if len(seen) > MAX_SEEN:
                seen.clear()
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, owners, packed)], names=["token", "cls", "packed"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token long, cls long, packed long")


def shared_members(rows: DataFrame) -> DataFrame:
    """The prefix rows of shingles that two classes or more have, once per class."""
    ordered = Window.partitionBy("token").orderBy("cls", "packed")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same order, so that rows are sorted once
    marked = rows.withColumns({"__least": F.min("cls").over(whole), "__most": F.max("cls").over(whole), "__before": F.lag("cls").over(ordered)})
    return marked.filter("__least <> __most AND (__before IS NULL OR __before <> cls)").select("token", "cls", "packed")


def _possible() -> Column:
    """Whether sets a and b, that share the shingle at these places, can overlap enough from there on."""
    size = lambda side: F.shiftright(f"{side}_packed", _PLACE_BITS)
    left = lambda side: size(side) - F.col(f"{side}_packed").bitwiseAND((1 << _PLACE_BITS) - 1)
    rest = F.least(left("a"), left("b"))
    sizes = DENOMINATOR * F.least(size("a"), size("b")) >= NUMERATOR * F.greatest(size("a"), size("b"))
    return sizes & ((NUMERATOR + DENOMINATOR) * rest >= NUMERATOR * (size("a") + size("b")))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct pairs of classes of different components that meet at a shingle."""
    named = lambda rows, side: rows.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("cls", "packed", "comp")))
    met = named(a, "a").join(named(b, "b"), "token").filter(F.col("a_comp") != F.col("b_comp")).filter(_possible())
    return met.select(F.least("a_cls", "b_cls").alias("u"), F.greatest("a_cls", "b_cls").alias("v")).distinct()


def _promising(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs whose bitmaps leave room for the overlap they need: overlap <= (u_n + v_n - differing cells) / 2."""
    ids = pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls"))).distinct()
    wanted = bitmaps.join(ids, "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    side = lambda x: wanted.select(F.col("cls").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    sizes = F.col("u_n") + F.col("v_n")
    return both.filter((NUMERATOR + DENOMINATOR) * (sizes - F.expr(_differ())) >= 2 * NUMERATOR * sizes).select("u", "v")


def _leaders(members: DataFrame) -> DataFrame:
    """Per shingle the member of highest degree of each component, for the first few components."""
    best = F.row_number().over(Window.partitionBy("token", "comp").orderBy(F.desc("degree"), "cls"))
    few = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("degree"), "cls"))
    return members.withColumn("__k", best).filter("__k = 1").withColumn("__k", few).filter(F.col("__k") <= LEADERS).drop("__k")


def _fragments(docs: DataFrame, wanted: DataFrame, text: str, ranks: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """cls, fragment and the shingles there, for the classes in ``wanted`` (cls, content)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, mask, seen = shared.value, np.uint64(len(shared.value) - 1), set()
        for batch in short_batches(batches):
            cls_out, fragment, arrays = [], [], []
            for raw, cls in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if cls in seen:
                    continue
                seen.add(cls)
                s = shingle_set(word_hashes(raw), WORDS)
                place = rank[(s & mask).astype(np.int64)] + s.astype(np.float64) / 2.0**64
                of = np.searchsorted(pivots, place, side="right")
                for f in np.unique(of).tolist():
                    cls_out.append(cls)
                    fragment.append(f)
                    arrays.append(s[of == f].view(np.int64))
            if len(seen) > MAX_SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls_out, pa.int64()), pa.array(fragment, pa.int32()), pa.array(arrays, pa.list_(pa.int64()))], names=["cls", "fragment", "shingles"]
            )

    few = wanted.count() <= MAX_BROADCAST_CLASSES
    rows = docs.select(F.xxhash64(F.col(text)).alias("content"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, "content").select("text", "cls")
    out = rows.mapInArrow(run, "cls long, fragment int, shingles array<long>")
    return out.groupBy("cls", "fragment").agg(F.first("shingles").alias("shingles"))


def _linked(met: DataFrame, bitmaps: DataFrame, known: DataFrame, fragments) -> DataFrame:
    """The pairs (u, v) whose Jaccard similarity reaches the threshold; ``known`` has cls, n and content. Pairs are written where
    they are read in several places, as each of these would hold the whole plan that finds them."""
    pairs = materialize(_promising(met, bitmaps), "pairs-promising")
    ids = pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls"))).distinct()
    parts = materialize(fragments(known.join(ids, "cls", "left_semi").select("content", "cls")), "fragments")
    side = lambda x: parts.select(F.col("cls").alias(x), "fragment", F.col("shingles").alias(f"{x}_shingles"))
    partial = pairs.join(side("u"), "u").join(side("v"), ["v", "fragment"]).select("u", "v", F.size(F.array_intersect("u_shingles", "v_shingles")).cast("long").alias("c"))
    overlap = partial.groupBy("u", "v").agg(F.sum("c").alias("c"))
    size = lambda x: known.select(F.col("cls").alias(x), F.col("n").alias(f"{x}_n"))
    sized = overlap.join(size("u"), "u").join(size("v"), "v")
    out = materialize(sized.filter(DENOMINATOR * F.col("c") >= NUMERATOR * (F.col("u_n") + F.col("v_n") - F.col("c"))).select("u", "v"), "links")
    discard(parts)
    discard(pairs)
    return out


def link_classes(shared: DataFrame, candidates, linked) -> DataFrame:
    """(node, component) of classes over links, from ``shared`` (token, cls, packed): prefix rows of shingles that several classes have.

    ``candidates(a, b, tested)`` gives pairs (u, v) of rows of a (leaders, or b itself) and b of different components that meet, without those in ``tested``;
    ``linked(pairs)`` those that are links. Members meet the leaders of components first, then all that are still apart.
    """
    spark = shared.sparkSession
    found = materialize(shared, "members")
    degree = found.groupBy("cls").agg(F.count("*").alias("degree"))
    members = materialize(found.join(degree, "cls"), "members-by-degree")
    discard(found)
    tested = spark.createDataFrame([], "u long, v long")
    now = members.withColumn("comp", F.col("cls"))
    comps = spark.createDataFrame([], "node long, component long")
    spent = [members]
    for step in range(LEADER_ROUNDS + 1):
        pairs = candidates(_leaders(now.repartition("token")) if step < LEADER_ROUNDS else now, now, tested)
        pairs = materialize(pairs, f"pairs-{step}")
        if pairs.isEmpty():
            if step < LEADER_ROUNDS:
                continue
            break
        tested = tested.union(pairs)
        comps = components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(linked(pairs)))  # what was found before is stars by now
        if step < LEADER_ROUNDS:
            labelled = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
            token = Window.partitionBy("token")
            open_ = labelled.withColumns({"__least": F.min("comp").over(token), "__most": F.max("comp").over(token)}).filter("__least <> __most")
            now = materialize(open_.select("token", "cls", "packed", "degree", "comp"), f"open-{step}")
            spent.append(now)
            if now.isEmpty():  # all that meet are in one component already
                break
    for df in spent:
        discard(df)
    return comps


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links), content (hash of
    the text) and component (a key that the texts of one component share; null for an empty set)."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with small_batches(docs.sparkSession), exchanged_joins(docs.sparkSession):
        every, counts = read_once(docs, "text", "doc_id")
        known = every.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("content").alias("content"), F.max("n").alias("n"), F.min("doc_id").alias("least"))
        known = materialize(known, "known-classes")
        bitmaps = every.filter("bits IS NOT NULL").select("cls", "n", "bits")
        ranks = frequency_classes(counts)
        pivots = fragment_pivots(counts, ranks)
        fragments = lambda wanted: _fragments(docs, wanted, "text", ranks, pivots)
        pairs = lambda a, b, tested: _pairs(a, b).join(tested, ["u", "v"], "left_anti")
        comps = link_classes(shared_members(prefixes(docs, ranks, "text")), pairs, lambda met: _linked(met, bitmaps, known, fragments))
        placed = known.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp"), "least")
        least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
        by_class = materialize(placed.join(least, "comp").select("cls", "component_id", F.col("comp").alias("component")), "class-components")
    out = every.join(by_class, "cls", "left")
    component_id = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), "content", "component")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, among equals the one of the least text hash.

    Rows with an empty set stay. What goes is named by doc_id and text hash; the list is sent to all tasks where it
    is counted and small, and joined otherwise.
    """
    with exchanged_joins(docs.sparkSession):
        found = materialize(near_duplicates(docs, doc_id, text).select("doc_id", "content", "component"), "near-duplicates")
        members = found.filter("component IS NOT NULL")
        best = members.groupBy("component").agg(F.min(F.struct("doc_id", "content")).alias("best"))
        gone = members.join(best, "component").filter(~F.struct("doc_id", "content").eqNullSafe(F.col("best")))
        gone = materialize(gone.select(F.col("doc_id").alias("__gone_id"), F.col("content").alias("__gone_content")).distinct(), "near-gone")
        repeated = members.groupBy("doc_id", "content").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("doc_id").alias("__gone_id"), F.col("content").alias("__gone_content"))
        repeated = materialize(repeated, "near-repeated")
    keyed = docs.select(packed(docs), F.col(f"`{doc_id}`").cast("long").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__content"))
    named = lambda small: F.broadcast(small) if small.count() <= MAX_BROADCAST_CLASSES else small
    same = F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__content") == F.col("__gone_content"))
    left = keyed.join(named(gone), same, "left_anti")
    if not repeated.isEmpty():
        twice = left.join(named(repeated), same, "left_semi").dropDuplicates(["__id", "__content"])
        left = left.join(named(repeated), same, "left_anti").select("__row").union(twice.select("__row"))
    return left.select(*unpacked(docs))
