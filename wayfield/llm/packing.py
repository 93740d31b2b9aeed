"""Packing of token sequences by minimum bin slack.

Each document's ids (tokenizer output, then an end id) are cut into windows of ``capacity`` ids;
the rest of each document goes to a pool. Minimum bin slack empties the pool: the longest rest
opens a window, and a bitset subset-sum dynamic programme over the multiset of remaining lengths
finds the multiset that fills the window closest to capacity; the counts taken of each length come
from backtracking through the programme's bitsets. What is left when a partition ends is cut at
powers of two, where a sequence needs no padding.

A partition of the input is packed by the task that reads it: no shuffle, memory bounded by the
pool (``pool_rests`` rests of less than ``capacity`` ids each), and a lost executor repeats only
its own tasks.

Defined cases: null or empty text gives the end id alone; a text longer than a window fills as many as it
needs; repeated rows are packed each on their own, told apart by ``document_row``; null doc_id stays null;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.word_ids import raw_texts, worker_encoder

CAPACITY = 4096
POOL_RESTS = 256
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, document_row long"
MAX_VOCABULARY_BYTES = 64 << 20


def fill_window(counts: dict[int, int], space: int) -> dict[int, int]:
    """Counts by length of the sub-multiset whose sum is the largest that is at most ``space``.

    ``counts`` has how often each length is there. Bit ``s`` of a bitset says that sum ``s`` can
    be reached; a length that is there ``c`` times enters as binary bundles of 1, 2, 4, ... of it.
    """
    mask = (1 << (space + 1)) - 1
    bundles: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], space // length if length else 0), 1
        while left > 0:
            bundles.append((length, min(size, left)))
            left -= bundles[-1][1]
            size *= 2
    reach, steps = 1, []
    for length, n in bundles:
        steps.append(reach)
        reach |= (reach << (length * n)) & mask
        if reach >> space & 1:
            break
    total, taken = reach.bit_length() - 1, Counter()
    for (length, n), before in zip(reversed(bundles[: len(steps)]), reversed(steps), strict=True):
        if not before >> total & 1:
            taken[length] += n
            total -= length * n
    return dict(taken)


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs the rests of one partition. A rest is (doc, start, doc_tokens, ids as bytes); a doc is (doc_id, row)."""

    def __init__(self, partition: int, capacity: int = CAPACITY, pool_rests: int = POOL_RESTS):
        self.capacity, self.pool_rests = capacity, pool_rests
        self.next_sequence = partition << 33
        self.pool: dict[int, deque] = defaultdict(deque)
        self.waiting = 0
        self.out: list[tuple] = []

    def _sequence(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def _emit(self, doc, start: int, tokens: int, ids: bytes, sequence: int, offset: int, padded: int) -> None:
        doc_id, row = doc
        self.out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, padded, row))

    def add(self, doc, ids: bytes) -> None:
        tokens, step = len(ids) // 4, self.capacity
        full = tokens // step
        for i in range(full):
            self._emit(doc, i * step, tokens, ids[i * step * 4 : (i + 1) * step * 4], self._sequence(), 0, step)
        if tokens > full * step:
            rest = ids[full * step * 4 :]
            self.pool[len(rest) // 4].append((doc, full * step, tokens, rest))
            self.waiting += 1
            while self.waiting >= self.pool_rests:
                self._window()

    def _take(self, length: int):
        rest = self.pool[length].popleft()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        return rest

    def _window(self) -> None:
        longest = max(self.pool)
        chosen = [self._take(longest)]
        for length, n in fill_window({k: len(v) for k, v in self.pool.items()}, self.capacity - longest).items():
            chosen += [self._take(length) for _ in range(n)]
        used = sum(len(x[3]) for x in chosen) // 4
        if used == self.capacity or used & (used - 1) == 0:
            self._lay(chosen, [used])
        elif self.waiting >= self.pool_rests // 2:  # the pool is still rich: cut one more rest to close the slack
            self._close(chosen, self.capacity - used)
        else:
            self._lay(chosen, powers_of_two(used))

    def _close(self, chosen: list[tuple], slack: int) -> None:
        """Cut the shortest rest that is longer than the slack; its tail goes back to the pool."""
        longer = [k for k in self.pool if k > slack]
        if not longer:
            self._lay(chosen, powers_of_two(self.capacity - slack))
            return
        doc, start, tokens, ids = self._take(min(longer))
        chosen.append((doc, start, tokens, ids[: slack * 4]))
        tail = ids[slack * 4 :]
        self.pool[len(tail) // 4].append((doc, start + slack, tokens, tail))
        self.waiting += 1
        self._lay(chosen, [self.capacity])

    def _lay(self, chosen: list[tuple], sizes: list[int]) -> None:
        """Lay the rests end to end over sequences of these sizes, cutting where one ends."""
        sizes = deque(sizes)
        room, offset, sequence, size = sizes[0], 0, self._sequence(), sizes.popleft()
        for doc, start, tokens, ids in chosen:
            while ids:
                n = min(room, len(ids) // 4)
                self._emit(doc, start, tokens, ids[: n * 4], sequence, offset, size)
                ids, start, offset, room = ids[n * 4 :], start + n, offset + n, room - n
                if not room and sizes:
                    room, offset, sequence, size = sizes[0], 0, self._sequence(), sizes.popleft()

    def finish(self) -> None:
        while self.waiting:
            self._window()

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in columns], names=names)


def pack(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    pool_rests: int = POOL_RESTS,
) -> DataFrame:
    """One row per piece: where it starts in its document, and in which sequence at which offset it lies.

    ``vocabulary`` is the path of a word-level BPE file on the driver; its content (checked to be at
    most 64 MB, whatever the input's size) is what is sent to the workers.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file of {len(spec)} bytes is over {MAX_VOCABULARY_BYTES}")
    key = f"{vocabulary}:{zlib.crc32(spec.encode())}"
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, shared.value)
        packer, row = Packer(TaskContext.get().partitionId(), capacity, pool_rests), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                packer.add((doc, row), encoder.encode(raw) + end)
                row += 1
            yield _batch(packer.rows())
        packer.finish()
        yield _batch(packer.rows())

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
