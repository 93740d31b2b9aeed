"""Token ids of whole texts for a word-level BPE file, computed once per distinct word.

The vocabulary file normalises (NFC, white space, then lower case sign by sign), cuts the text into
runs of letters, single digits and runs of other signs, and applies BPE inside each run; so the ids of
a text are those of its white-space separated chunks, one after the other. A chunk's ids are
kept in a bounded cache as little-endian unsigned 32-bit bytes, and a text's ids are one join.

Chunks of ASCII letters, and of letters below ``PROVEN`` after NFC, go to the BPE model at once; every other
chunk goes through the whole tokenizer, and so does a whole text that holds a special token's name.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa

CACHE_ENTRIES = 400_000
#: Letters below this code point are letters in every version of the character tables.
PROVEN = 0x530
_TRAILING = b".,;:!?)"
_WORKER: dict[str, "WordIds"] = {}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [], 256
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


class _Bounded(dict):
    """A memo of at most two generations of ``limit`` entries: when the young one is full it becomes
    the old one, and what is asked for again comes back from there. Values never depend on it."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """``encode(text_bytes)`` gives the same ids as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, spec: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.bpe = self.whole.model.tokenize
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.tails = _Bounded(self._run, 4096)
        self.chunks = _Bounded(self._chunk, cache_entries)

    def _run(self, run: bytes) -> bytes:
        """Ids of one run: its bytes (lower case already, NFC) written as byte letters."""
        word = run.decode("ascii") if run.isascii() else "".join([self.letters[b] for b in run])
        return _packed([t.id for t in self.bpe(word)])

    def _whole(self, text: bytes) -> bytes:
        return _packed(self.whole.encode(text.decode("utf-8"), add_special_tokens=False).ids)

    def _chunk(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_TRAILING)
        tail = self.tails[chunk[len(core) :]] if len(core) < len(chunk) else b""
        if core.isalpha():
            return _packed([t.id for t in self.bpe(core.decode("ascii").lower())]) + tail
        if core and not core.isascii():
            # NFC comes first: a small letter may compose where its capital does not; and one letter's lower
            # case does not depend on the letters around it
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", core.decode("utf-8"))])
            if text.isalpha() and max(map(ord, text)) < PROVEN:
                return self._run(text.encode()) + tail
        return self._whole(chunk)

    def encode(self, text: bytes) -> bytes:
        if any(name in text for name in self.special):
            return self._whole(text)
        if text.isascii() and not any(name in (lowered := text.lower()) for name in self.special):
            text = lowered  # fewer different chunks to remember
        return b"".join([self.chunks[c] for c in text.split()])


def worker_encoder(key: str, spec: str) -> WordIds:
    """One encoder per Python worker and vocabulary, so that the cache outlives a task."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordIds(spec)
    return _WORKER[key]


def short_batches(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that are short enough for Python copies of their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    binary = column.cast(pa.large_binary())
    return [x or b"" for x in binary.to_pylist()]
