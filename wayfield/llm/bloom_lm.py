"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token per document.
Counts of unigrams and bigrams over all training documents go into the filter as levels
1 + floor(log_b c): an n-gram of level q is stored under the levels 1 to q, and a lookup probes 1,
2, ... until one is missing. All bigrams are stored, those seen once too. With the level's middle as
count, p(w|h) = L * c(hw) / c(h) + (1 - L) * (c(w) + 1) / (N + V + 1), where 1 - L is Witten and
Bell's t / (n + t) over the contexts of h's level, with n training tokens in t distinct bigrams. Probabilities over the
known words and one unknown word add up to at most 1, up to the quantisation.

Exact unigram counts, for the base score, come by request: a chunk of documents asks once for each
of its distinct words. Chunks (about ``CHUNK_BYTES`` of text) are written once, as local word
numbers and sorted word hashes; requests, and counts of bigrams, are dealt by hash to shards, each
chunk naming an n-gram once, so no word is hot and a shard's size is set by the number of shards.

Each shard builds its own segment of the filter, of bits in proportion to what it holds. Unigrams are probed in the
shard that is asked for them. The bigrams' segments are broadcast while they are at most ``BROADCAST_BYTES`` together;
a larger filter stays where it is, and each chunk's distinct bigrams are dealt to the shards once, to be probed there.
Either way the same bits answer, so the scores are the same.

Defined cases: null or empty text is the end token alone; a text of any length is whole in one chunk; null doc_id counts
as training; repeated rows count and are scored each; an empty table gives no rows; extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.tokens64 import MULTIPLIER, mixed
from wayfield.llm.word_ids import raw_texts
from wayfield.session import discard, materialize

CHUNK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
MIN_SHARD_BITS = 6
BASE = 1.5
BITS_PER_EVENT = 12
HASHES = 6
#: Bytes of a bigram's hash that are kept besides its shard.
LOW_BYTES = 5
BROADCAST_BYTES = 128 << 20
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line feed
CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, keys binary, counts binary, n_train long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed, after how many there are."""
    wide = np.ascontiguousarray(numbers)
    planes = wide.view(np.uint8).reshape(-1, wide.itemsize).T.tobytes()
    return len(wide).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def spread_out(packed: bytes, kind: str) -> np.ndarray:
    n, item = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(packed[8:], n * item, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(item, n).T).view(kind).ravel()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_b c) for c of 1 or more, else 0."""
    c = counts.astype(np.float64)
    return np.where(c >= 1, 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9), 0).astype(np.uint8)


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The middle of each level's range of counts; 0 for level 0."""
    q = levels.astype(np.float64)
    low, high = np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def encode(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Chunks of documents as CHUNKS says; words are numbered from the most frequent on."""

    def pack(chunk: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        number: dict[bytes, int] = {b"\n": 0}
        stream, lengths, held = [], [], [held_out(d) for d in ids]
        for raw in texts:
            words = raw.lower().split()
            stream += [number.setdefault(w, len(number)) for w in words]
            stream.append(0)
            lengths.append(len(words) + 1)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, number), dtype=np.uint64, count=len(number))
        first = np.array(stream, dtype=np.int64)
        order = np.argsort(-np.bincount(first, minlength=len(keys)), kind="stable")
        place = np.empty(len(order), dtype="<u4")
        place[order] = np.arange(len(order), dtype="<u4")
        local = place[first]
        train = np.repeat(~np.array(held, dtype=bool), lengths)
        counts = np.bincount(local[train], minlength=len(keys)).astype("<u8")
        cells = [[chunk], [ids], [held], [lengths], [squeezed(local)], [keys[order].astype("<u8").tobytes()], [squeezed(counts)], [int(train.sum())]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=[f.split()[0] for f in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                ids.append(doc)
                texts.append(raw)
                size += len(raw) + 1
                if size >= CHUNK_BYTES:
                    yield pack(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield pack(chunk, ids, texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, CHUNKS)


def _cells(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The shards (the top bits) that sorted keys have, each with its part of them."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], shard[1:] != shard[:-1]]))
    return zip(shard[first].tolist(), map(slice, first.tolist(), [*first[1:].tolist(), len(keys)]), strict=True)


def _positions(keys: np.ndarray, level: int, cells: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of (key, level) in a segment of so many bits."""
    one = mixed(keys + np.uint64(level * int(MULTIPLIER) % (1 << 64)))
    two = mixed(one ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    size = np.asarray(cells, dtype=np.uint64)
    for i in range(HASHES):
        yield ((one + np.uint64(i) * two) % size).astype(np.int64)


def build_segment(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """A Bloom filter of the keys under all their levels."""
    bits = max(64, int(levels.sum(dtype=np.int64)) * BITS_PER_EVENT // 64 * 64 + 64)
    cells = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(keys[levels >= level], level, bits):
            cells[at] = True
    return np.packbits(cells, bitorder="little").tobytes()


class Segments:
    """Some segments of a filter, one after the other in one array."""

    spread = staticmethod(lambda keys: keys)

    def __init__(self, lengths: list[tuple[int, int]], data: bytes, bits: int):
        """``lengths``: shard and bytes of each segment, in the order in which ``data`` holds them."""
        self.bits = bits
        self.start, self.size = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.uint64)
        at = 0
        for shard, length in lengths:
            self.start[shard], self.size[shard] = at, length * 8
            at += length * 8
        self.data = np.frombuffer(data, dtype=np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key: probes until one is missing; 0 for keys of shards that are not here."""
        out = np.zeros(len(keys), dtype=np.uint8)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        alive, level, inner = np.flatnonzero(self.size[shard] > 0), 0, self.spread(keys)
        while len(alive) and level < 200:
            level += 1
            start, size, now = self.start[shard[alive]], self.size[shard[alive]], inner[alive]
            ok = np.ones(len(alive), dtype=bool)
            for at in _positions(now, level, size):
                at += start
                ok &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive = alive[ok]
            out[alive] = level
        return out


def _unigrams(chunks: DataFrame, bits: int) -> DataFrame:
    """Per chunk and shard the total counts asked for, and the filter's levels (rows of chunk -1: the shard's vocabulary size)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = np.frombuffer(k, "<u8")
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], spread_out(c, "<u8")[order]
                cells = [(shard, chunk, keys[part].tobytes(), squeezed(counts[part])) for shard, part in _cells(keys, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*cells, strict=True)], names=["shard", "chunk", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        asked = np.concatenate([spread_out(x, "<u8") for x in table.column("counts").to_pylist()])
        total = np.bincount(back, weights=asked.astype(np.float64), minlength=len(every)).astype("<u8")
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        known = total > 0
        segment = build_segment(every[known], levels_of(total[known]))
        level = Segments([(shard, len(segment))], segment, bits).levels(every)
        parts = lambda x: [squeezed(part) for part in np.split(x[back], cuts)]
        rows = [*zip(table.column("chunk").to_pylist(), parts(total), parts(level), [0] * len(keys), strict=True)]
        rows.append((-1, b"", b"", int(known.sum())))
        return pa.table([pa.array([shard] * len(rows), pa.int64()), *(pa.array(x) for x in zip(*rows, strict=True))], names=["shard", "chunk", "body", "level", "words"])

    asked = chunks.select("chunk", "keys", "counts").mapInArrow(ask, "shard long, chunk long, keys binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "shard long, chunk long, body binary, level binary, words long")


def _in_order(keys: np.ndarray, parts: list[bytes], kind: str) -> np.ndarray:
    """Values that came shard by shard, in the order of sorted keys, one per key."""
    out = np.empty(len(keys), dtype=kind)
    out[np.argsort(keys, kind="stable")] = np.concatenate([spread_out(t, kind) for t in parts])
    return out


def _stream(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hash and bigram key at each token; a document's first token follows an end."""
    now = keys[ids]
    before = np.concatenate([[np.uint64(END)], now[:-1]])
    return now, mixed(mixed(before) * MULTIPLIER + now)


def _bigrams(chunks: DataFrame, bits: int) -> DataFrame:
    """Per shard its segment, and per context level the training tokens and their distinct bigrams."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, lengths, i, k, t in zip(*(batch.column(n).to_pylist() for n in ("held", "lengths", "ids", "keys", "totals")), strict=True):
                ids, keys = spread_out(i, "<u4").astype(np.int64), np.frombuffer(k, "<u8")
                level = levels_of(_in_order(keys, t, "<u8"))
                _, pair = _stream(keys, ids)
                end = int(np.flatnonzero(keys == np.uint64(END))[0])
                context = level[np.concatenate([[end], ids[:-1]])]
                train = np.repeat(~np.array(held, dtype=bool), lengths)
                every, first, counts = np.unique(pair[train], return_index=True, return_counts=True)
                context = context[train][first]
                cells = []
                for shard, part in _cells(every, bits):
                    small, many = np.minimum(counts[part], 255).astype(np.uint8), np.flatnonzero(counts[part] >= 255)
                    cells.append((shard, _cut(every[part]), squeezed(small), squeezed(context[part]), many.astype("<u4").tobytes(), counts[part][many].astype("<u8").tobytes()))
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*cells, strict=True)], names=["shard", "low", "small", "context", "many", "large"])

    def gather(table: pa.Table) -> pa.Table:
        shard, lows, counts, contexts = table.column("shard")[0].as_py(), [], [], []
        for low, small, context, many, large in zip(*(table.column(n).to_pylist() for n in ("low", "small", "context", "many", "large")), strict=True):
            n = spread_out(small, "u1").astype(np.int64)
            n[np.frombuffer(many, "<u4").astype(np.int64)] = np.frombuffer(large, "<u8")
            lows.append(_uncut(low))
            counts.append(n)
            contexts.append(spread_out(context, "u1"))
        every, first, back = np.unique(np.concatenate(lows), return_index=True, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(counts).astype(np.float64)).astype(np.int64)
        context = np.concatenate(contexts)[first].astype(np.int64)
        tokens = np.bincount(context, weights=total.astype(np.float64), minlength=256).astype(np.int64)
        kinds = np.bincount(context, minlength=256).astype(np.int64)
        segment = build_segment(_low(every), levels_of(total))
        return pa.table([pa.array([shard], pa.int64()), pa.array([segment]), pa.array([tokens.tolist()], pa.list_(pa.int64())), pa.array([kinds.tolist()], pa.list_(pa.int64()))], names=["shard", "body", "tokens", "kinds"])

    sent = chunks.select("held", "lengths", "ids", "keys", "totals").mapInArrow(send, "shard long, low binary, small binary, context binary, many binary, large binary")
    return sent.groupBy("shard").applyInArrow(gather, "shard long, body binary, tokens array<long>, kinds array<long>")


def _cut(keys: np.ndarray) -> bytes:
    """The low bytes of keys, one after the other."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES].tobytes()


def _uncut(low: bytes) -> np.ndarray:
    wide = np.zeros((len(low) // LOW_BYTES, 8), dtype=np.uint8)
    wide[:, :LOW_BYTES] = np.frombuffer(low, np.uint8).reshape(-1, LOW_BYTES)
    return wide.view("<u8").ravel()


def _low(keys: np.ndarray) -> np.ndarray:
    """What is left of a bigram key within its shard: its low bytes, spread again."""
    return mixed(keys & np.uint64((1 << 8 * LOW_BYTES) - 1))


class PairSegments(Segments):
    """Segments of bigrams: the shard is that of the whole key, the bits those of its low part."""

    spread = staticmethod(_low)


def _shard_bits(total_bytes: int) -> int:
    return max(MIN_SHARD_BITS, math.ceil(math.log2(max(1, total_bytes / SHARD_BYTES))))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document as SCORES says."""
    spark = docs.sparkSession
    encoded = materialize(encode(docs, doc_id, text), "lm-encoded")
    n_train, key_bytes, id_bytes = encoded.agg(F.sum("n_train"), F.sum(F.length("keys")), F.sum(F.length("ids"))).first()
    n_train, bits = n_train or 0, _shard_bits(2 * (key_bytes or 0))
    answers = materialize(_unigrams(encoded, bits), "lm-unigrams")
    n_words = answers.filter("chunk = -1").agg(F.sum("words")).first()[0] or 0
    by_chunk = answers.filter("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "body", "level"))).alias("parts"))
    chunks = encoded.drop("counts", "n_train").join(by_chunk.select("chunk", F.col("parts.body").alias("totals"), F.col("parts.level").alias("levels")), "chunk")
    chunks = materialize(chunks, "lm-chunks")
    discard(encoded)
    discard(answers)
    pair_bits = _shard_bits(4 * (id_bytes or 0))
    pairs = materialize(_bigrams(chunks, pair_bits), "lm-bigrams")
    size = pairs.agg(F.sum(F.length("body"))).first()[0] or 0
    shares = pairs.select(F.posexplode_outer(F.arrays_zip("tokens", "kinds")).alias("level", "x")).groupBy("level").agg(F.sum("x.tokens").alias("t"), F.sum("x.kinds").alias("k")).filter("t > 0").collect()
    backoff = np.full(256, 1.0)
    for row in shares:
        backoff[row["level"]] = row["k"] / (row["t"] + row["k"])
    floor = float(n_train + n_words + 1)

    def scored(row: dict, ids: np.ndarray, keys: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        """Scores of a chunk's documents, from the level of each token's bigram."""
        totals, one = _in_order(keys, row["totals"], "<u8"), _in_order(keys, row["levels"], "u1")
        lengths = np.array(row["lengths"], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        base = np.log10((totals.astype(np.float64) + 1) / floor)[ids]
        end = int(np.flatnonzero(keys == np.uint64(END))[0])
        before = np.concatenate([[end], ids[:-1]])
        uni = ((counts_of(one) + 1) / floor)[ids]
        context, back_off = counts_of(one)[before], backoff[one[before]]
        seen = np.where(context > 0, np.minimum(1.0, counts_of(two) / np.maximum(context, 1.0)), 0.0)
        p = np.log10((1 - back_off) * seen + np.where(context > 0, back_off, 1.0) * uni)
        known = (totals[ids] > 0).astype(np.int64)
        add = lambda x: np.add.reduceat(x, starts)
        columns = [
            pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(add(known)),
            pa.array(np.full(len(lengths), n_train)), pa.array(add(base)), pa.array(add(p)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCORES.split(", ")])

    filters = None
    if size <= BROADCAST_BYTES:
        held, data = [], bytearray()
        for row in pairs.select("shard", "body").toLocalIterator():  # a partition at a time, so that the driver holds the filter once
            held.append((row["shard"], len(row["body"])))
            data += row["body"]
        filters = spark.sparkContext.broadcast((held, data))
        del data
    else:
        chunks = chunks.join(_dealt_levels(chunks, pairs.select("shard", "body"), pair_bits), "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = filters and PairSegments(*filters.value, pair_bits)
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys = spread_out(row["ids"], "<u4").astype(np.int64), np.frombuffer(row["keys"], "<u8")
                every, back = np.unique(_stream(keys, ids)[1], return_inverse=True)
                level = model.levels(every) if model else np.concatenate([spread_out(x, "u1") for x in row["pair_levels"]])
                yield scored(row, ids, keys, level[back])

    return chunks.mapInArrow(run, SCORES)


def _dealt_levels(chunks: DataFrame, segments: DataFrame, bits: int) -> DataFrame:
    """chunk and pair_levels: the levels of its distinct bigrams in the order of their keys, shard by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, i, k in zip(*(batch.column(n).to_pylist() for n in ("chunk", "ids", "keys")), strict=True):
                every = np.unique(_stream(np.frombuffer(k, "<u8"), spread_out(i, "<u4").astype(np.int64))[1])
                cells = [(shard, chunk, _cut(every[part])) for shard, part in _cells(every, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*cells, strict=True)], names=["shard", "chunk", "low"])

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        held = [(s, len(b)) for s, b in zip(segment.column("shard").to_pylist(), segment.column("body").to_pylist(), strict=True)]
        model = PairSegments(held, b"".join(segment.column("body").to_pylist()), bits)
        shards, out = asked.column("shard").to_pylist(), []
        for shard, low in zip(shards, asked.column("low").to_pylist(), strict=True):
            out.append(squeezed(model.levels(_uncut(low) | np.uint64(shard) << np.uint64(64 - bits))))
        return pa.table([asked.column("chunk").combine_chunks(), pa.array(shards, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "shard", "level"])

    asked = chunks.select("chunk", "ids", "keys").mapInArrow(ask, "shard long, chunk long, low binary")
    got = asked.groupBy("shard").cogroup(segments.groupBy("shard")).applyInArrow(answer, "chunk long, shard long, level binary")
    listed = got.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "level"))).alias("parts"))
    return listed.select("chunk", F.col("parts.level").alias("pair_levels"))
