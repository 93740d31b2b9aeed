"""SpotSigs fingerprints: chains of content words that follow common words.

A text's words (A-Z in lower case, outer punctuation off) are common words or content words; a separator
that stands alone counts as a common word. At each common word, the anchor, the next ``CHAIN`` content
words, common words skipped, form a signature with it; a fingerprint is the set of signatures, 32 bits each, written as sorted hex. A text
without any signature has its whole word sequence as one; a text without words has none.

Likeness is the Jaccard similarity of two fingerprints. ``near_classes`` finds the documents whose fingerprints
are at least 0.75 alike: fingerprints belong to partitions of set length, so that only sets whose lengths
can reach the threshold meet; there they meet under the rarest of their signatures (a count sketch tells which), and
the Jaccard similarity of those that meet is pruned by length and by bitmaps before it is counted. Equal fingerprints are one class;
classes are compared with the leaders of components first, so a large group never meets all against all.

The successor of each document in descending doc_id comes with one exchange of the texts by ranges of
doc_id, in order within a range; the first document of each range is also sent to the range before it.
The ranges' bounds and first documents are all that the driver sees: one of each for every ``ROWS_PER_RANGE`` documents.

Defined cases: null text counts as empty and has an empty fingerprint, which is near no other; null doc_id comes last and
takes no part in the least doc_id; equal doc_ids are in order of a hash of their texts; texts of any length count whole;
a lone document is its own successor; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from wayfield.llm import shingle_join, suffix_levels
from wayfield.llm.tokens64 import MULTIPLIER, mixed
from wayfield.llm.word_ids import _Bounded, raw_texts, short_batches
from wayfield.session import discard, materialize, small_batches

CHAIN = 2
#: Common words of English, German, French and Spanish.
COMMON = frozenset(
    "the of and to in is that for a an it on as at by be this are was with from or he they not "
    "der die und das den von zu ist ein eine nicht mit sich auf dem des er es im auch "
    "le la les de et un est une du dans qui pour sur pas par au il elle que "
    "el los en y por del se las con no su para al lo como".split()
)
PUNCTUATION = b".,;:!?()[]{}\"'*#$%&|<>"
ROWS_PER_RANGE = 2_000
MIN_RANGES = 24
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cls long"
MAX_BROADCAST_CLASSES = 2_000_000

_COMMON_BYTES = frozenset(w.encode() for w in COMMON)


def _code(word: bytes) -> int:
    """A hash whose low bit says that the word is an anchor."""
    bare = word.strip(PUNCTUATION)
    anchor = not bare or bare in _COMMON_BYTES
    return xxhash.xxh3_64_intdigest(bare or word) & ~1 | anchor


_CODES = _Bounded(_code, 400_000)


def signatures(raw: bytes) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text."""
    codes = _CODES
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint32)
    every = np.fromiter([codes[w] for w in words], dtype=np.uint64, count=len(words))
    anchor = (every & np.uint64(1)).astype(bool)
    at_content, at_anchor = np.flatnonzero(~anchor), np.flatnonzero(anchor)
    following = np.searchsorted(at_content, at_anchor)
    whole = following + CHAIN <= len(at_content)
    h = every[at_anchor[whole]]
    for i in range(CHAIN):
        h = h * MULTIPLIER + every[at_content[following[whole] + i]]
    if not len(h):
        h = np.array([xxhash.xxh3_64_intdigest(every.tobytes())], dtype=np.uint64)
    return np.unique((mixed(h) >> np.uint64(32)).astype(np.uint32))


def written(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where their lengths keep it under ``floor``. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    short, long_ = sorted((len(a), len(b)))
    if not short or short < floor * long_:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) by bucket in descending doc_id; each bucket ends with the first row of the next (tail = 1)."""
    spark = rows.sparkSession
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "tie": F.xxhash64("text")})
    n = rows.count()
    ranges = int(max(MIN_RANGES, n // ROWS_PER_RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    splits = keyed.agg(F.percentile_approx("key", shares, 20 * ranges)).first()[0] or []
    bounds = np.unique(np.array(splits, dtype=np.int64))

    @F.pandas_udf(IntegerType())
    def bucket(key):
        import pandas as pd

        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(), side="right")).astype("int32")

    tops = keyed.select("key", "tie").withColumn("bucket", bucket("key")).groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("top")).orderBy("bucket").collect()
    heads = [(r["top"]["key"], r["top"]["tie"], tops[i - 1]["bucket"]) for i, r in enumerate(tops)]
    sent = spark.createDataFrame(heads, "key long, tie long, before int")
    placed = keyed.withColumn("bucket", bucket("key")).join(F.broadcast(sent), ["key", "tie"], "left")
    own, again = F.struct(F.col("bucket"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    both = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, again))
    dealt = placed.select("doc_id", "text", "key", "tie", F.explode(both).alias("to")).select("to.bucket", "to.tail", "key", "tie", "doc_id", "text")
    return dealt.repartitionByRange(ranges, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.desc("tie")).select("bucket", "tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by the first as many of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def class_of(s: np.ndarray) -> int | None:
    """A hash that equal fingerprints share; none for an empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document as SCHEMA says, with component_id, the least doc_id among documents near it, in the place of cls."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    with small_batches(rows.sparkSession):
        near = near_classes(rows)
    few = near.count() <= MAX_BROADCAST_CLASSES
    out = _with_successors(rows).join(F.broadcast(near) if few else near, "cls", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id")).drop("cls")


def _with_successors(rows: DataFrame) -> DataFrame:
    """One row per document (doc_id, text) as SCHEMA says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, signatures)
        for batch in batches:
            rows = []
            for bucket, tail, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), raw_texts(batch.column(3)), strict=True):
                sigs = signatures(raw)
                if held is not None and held[0] == bucket:
                    mine = held[2].decode("utf-8")
                    other = edited(mine, raw.decode("utf-8")).encode("utf-8")
                    changed = signatures(other)
                    rows.append((held[1], len(mine), hashlib.sha256(other).hexdigest(), written(held[3]), written(changed), likeness(held[3], changed), likeness(held[3], sigs), class_of(held[3])))
                held = None if tail else (bucket, doc, raw, sigs)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return _in_order(rows).mapInArrow(run, SCHEMA)


def _prints(rows: DataFrame) -> DataFrame:
    """doc_id, cls and the fingerprint's bytes (once per class and task) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int | None] = {None}
        for batch in short_batches(batches):
            classes, prints = [], []
            for raw in raw_texts(batch.column(1)):
                s = signatures(raw)
                c = class_of(s)
                classes.append(c)
                prints.append(None if c in seen else s.tobytes())
                seen.add(c)
            if len(seen) > 100_000:
                seen = {None}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "cls", "print"])

    return rows.mapInArrow(run, "doc_id long, cls long, print binary")


def _sketch(prints: DataFrame) -> np.ndarray:
    """Counts of signatures by their low bits."""
    cells = 1 << shingle_join.SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint32)
            total += np.bincount(every & np.uint32(cells - 1), minlength=cells)
        parts = shingle_join.sketch_slices(total)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["slice", "counts"])

    return shingle_join.sketch_of(prints.select("print").mapInArrow(run, "slice int, counts binary"))


def _prefixes(prints: DataFrame, ranks: np.ndarray) -> DataFrame:
    """token, cls and packed (n, place) of the rarest n - ceil(0.75 n) + 1 signatures of each class."""
    shared = prints.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, mask = shared.value, np.uint32(len(shared.value) - 1)
        for batch in short_batches(batches):
            tokens, owners, packed = [], [], []
            for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw, dtype=np.uint32)
                m = shingle_join.prefix_length(len(s))
                tokens.append(s[np.argsort(rank[s & mask], kind="stable")[:m]].astype(np.int64))
                owners.append(np.full(m, cls, dtype=np.int64))
                packed.append((len(s) << 32) | np.arange(m, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, owners, packed)], names=["token", "cls", "packed"])

    return prints.select("cls", "print").mapInArrow(run, "token long, cls long, packed long")


def _length_part() -> Column:
    """The partition of a set's length: floor(log(n) / log(4 / 3)); lengths that can reach 0.75 are in the same or in neighbours."""
    return F.floor(F.log(F.shiftright("packed", 32).cast("double")) / float(np.log(shingle_join.DENOMINATOR / shingle_join.NUMERATOR)) + 1e-9).cast("int")


def _pairs(a: DataFrame, b: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of classes that meet under a signature in the same or neighbouring partitions of set length. A signature's leaders, few by
    count, meet all there; where a is b, a class visits its neighbours, and a partition of a signature is a group of its own."""
    named = lambda rows, side, part: rows.select("token", part, *(F.col(c).alias(f"{side}_{c}") for c in ("cls", "packed", "comp")))
    if a is b:
        near = F.explode(F.array(_length_part() - 1, _length_part(), _length_part() + 1)).alias("part")
        met = named(a, "a", near).join(named(b, "b", _length_part().alias("part")), ["token", "part"])
    else:
        met = named(a, "a", _length_part().alias("a_part")).join(named(b, "b", _length_part().alias("b_part")), "token")
        met = met.filter(F.abs(F.col("a_part") - F.col("b_part")) <= 1)
    met = met.filter(F.col("a_comp") != F.col("b_comp")).filter(shingle_join._possible())
    return met.select(F.least("a_cls", "b_cls").alias("u"), F.greatest("a_cls", "b_cls").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")


def _classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls"))).distinct()


def _bitmaps(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls, n and the bitmap (a fifth of a fingerprint's bytes) of the classes in ``pairs``, and few others."""
    shared = prints.sparkSession.sparkContext.broadcast(suffix_levels.bloom(_classes_of(pairs), "cls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches):
            batch = batch.filter(pa.array(suffix_levels.hits(shared.value, batch.column(0).to_numpy())))
            sets = [np.frombuffer(x, dtype=np.uint32).astype(np.uint64) for x in batch.column(1).to_pylist()]
            bits = pa.array([shingle_join.bitmap(mixed(s)) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), bits], names=["cls", "n", "bits"])

    return prints.select("cls", "print").mapInArrow(run, "cls long, n long, bits array<long>")


def _linked(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs whose pruned Jaccard similarity is at least 0.75; only those whose bitmaps leave room for it meet as fingerprints."""
    pairs = materialize(shingle_join._promising(pairs, _bitmaps(prints, pairs)), "spot-promising")
    wanted = prints.filter(suffix_levels.maybe_in(_classes_of(pairs), "cls")).groupBy("cls").agg(F.first("print").alias("print"))
    side = lambda x: wanted.select(F.col("cls").alias(x), F.col("print").alias(f"{x}_print"))
    up, down = shingle_join.NUMERATOR, shingle_join.DENOMINATOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                if down * min(len(a), len(b)) >= up * max(len(a), len(b)):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if down * common >= up * (len(a) + len(b) - common):
                        kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(["u", "v"])

    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_print", "v_print")
    links = materialize(both.mapInArrow(run, "u long, v long"), "spot-links")
    discard(pairs)
    return links


def near_classes(rows: DataFrame) -> DataFrame:
    """(cls, component_id) of the classes of fingerprints of documents (doc_id, text) whose component has several documents:
    component_id is the least doc_id reachable over fingerprints at least 0.75 alike. All other documents are alone."""
    own = materialize(_prints(rows), "spot-prints")
    prints = own.filter("print IS NOT NULL").select("cls", "print")
    ranks = shingle_join.frequency_classes(_sketch(prints))
    comps = shingle_join.link_classes(shingle_join.shared_members(_prefixes(prints, ranks)), _pairs, lambda pairs: _linked(pairs, prints))
    known = own.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    placed = known.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = materialize(placed.select("cls", "component", "least", "n"), "spot-placed")
    several = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).filter("n > 1")
    out = materialize(placed.select("cls", "component").join(several.select("component", "component_id"), "component").select("cls", "component_id"), "spot-components")
    for df in (own, placed):
        discard(df)
    return out
