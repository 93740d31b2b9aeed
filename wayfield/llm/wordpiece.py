"""Token counts by a linear longest-match automaton (greedy word pieces, no pieces built).

The vocabulary is a set of byte strings. A word is matched greedily from the left, each time by
the longest vocabulary entry. The automaton is the vocabulary's trie; a node that cannot go on
with the next byte follows its failure link to the node for what is left after greedily popping
pieces from its own string, and ``pops`` has how many pieces that pops. So a word costs one pass
over its bytes and the sum of ``pops`` along it; no piece and no back-up occurs. A word holding a
byte that no piece can cover counts as one unknown token.

Words are ``[^\\x20\\x09-\\x0D]+``; each is preceded by ``marker`` bytes where the vocabulary marks
starts of words so. Each worker keeps counts of words that it has seen in a bounded memo.

Counting happens in the task that reads the text: no shuffle. Defined cases: null or empty text
has 0 words and 0 tokens; repeated rows count each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.word_ids import _Bounded, raw_texts

MAX_VOCABULARY_BYTES = 64 << 20
SCHEMA = "doc_id long, n_words long, n_tokens long"


class LongestMatch:
    """Counts greedy longest-match pieces of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.goto: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                step = self.goto[node].get(byte)
                if step is None:
                    step = len(self.goto)
                    self.goto[node][byte] = step
                    self.goto.append({})
                    whole.append(False)
                node = step
            whole[node] = node > 0
        self.fail: list[int] = [-1] * len(self.goto)
        self.pops: list[int] = [0] * len(self.goto)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.goto[parent].items():
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                back, popped = self.fail[parent], self.pops[parent]
                while back >= 0 and byte not in self.goto[back]:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[node], self.pops[node] = self.goto[back][byte], popped

    def count(self, word: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        node = total = 0
        for byte in word:
            step = goto[node].get(byte)
            while step is None:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
                step = goto[node].get(byte)
            node = step
        while node:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total


def rank_file_pieces(path: str) -> list[bytes]:
    """Pieces of a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file is over {MAX_VOCABULARY_BYTES} bytes")
    return [base64.b64decode(line.split()[0]) for line in content.splitlines() if line.strip()]


_WORKER: dict[int, tuple] = {}


def count_tokens(docs: DataFrame, pieces: list[bytes], marker: bytes = b" ", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text. ``pieces`` is the vocabulary (size-checked when read)."""
    if sum(map(len, pieces)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary is over {MAX_VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash((len(pieces), marker, tuple(pieces[:64]), tuple(pieces[-64:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            automaton = LongestMatch(shared.value)
            _WORKER.clear()
            _WORKER[key] = (_Bounded(lambda w: automaton.count(marker + w), 400_000),)
        (memo,) = _WORKER[key]
        for batch in batches:
            words = [raw.split() for raw in raw_texts(batch.column(1))]
            tokens = [sum([memo[w] for w in one]) for one in words]
            columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
