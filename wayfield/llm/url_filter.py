"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and all subdomains where the url's path starts
with the rule's path. Of the rules that fit, the one with most host labels wins, then the one with
the longest path; of two equal rules the later one stands.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in
lower case; its path goes on from there up to ``?``, ``#`` or the end.

Rules are broadcast in shards of at most ``RULE_BYTES`` bytes, and each worker builds a shard's trie once.
A list of one shard is judged in the task that reads the url, without a shuffle. A longer list takes
one pass per shard, in each of which a url keeps the longest match so far; the passes are written to the
shared folder and a shard's broadcast is destroyed after its pass, so no worker holds more than one
trie, however long the list is.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default
verdict, unless a rule with empty host and path is given; urls of any length are judged whole; repeated rows are
judged one by one; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.session import discard, materialize

RULE_BYTES = 32 << 20
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


class _Node:
    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.paths: _Paths | None = None


class _Paths:
    """Path segments below one host. ``ends`` has rules whose last segment may be cut short."""

    __slots__ = ("below", "ends", "lengths", "bare")

    def __init__(self):
        self.below: dict[str, _Paths] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.lengths: tuple[int, ...] = ()
        self.bare: tuple[str, str] | None = None


class UrlTrie:
    """Longest match of a (host, path) among (verdict, host, path) rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Node()
        for verdict, host, path in rules:
            self._add(verdict, host.lower(), path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, _Node())
        if node.paths is None:
            node.paths = _Paths()
        kept = (host + path, verdict)
        if not path:
            node.paths.bare = kept
            return
        *whole, last = path.removeprefix("/").split("/")
        spot = node.paths
        for segment in whole:
            spot = spot.below.setdefault(segment, _Paths())
        spot.ends[last] = kept
        spot.lengths = tuple(sorted({len(x) for x in spot.ends}, reverse=True))

    @staticmethod
    def _longest(paths: _Paths, path: str) -> tuple[int, tuple[str, str]] | None:
        """Length of the longest rule path that ``path`` starts with, and that rule."""
        best = (0, paths.bare) if paths.bare else None
        if not path:
            return best
        spot, done = paths, 1
        for segment in path[1:].split("/"):
            for n in spot.lengths:
                if n <= len(segment) and segment[:n] in spot.ends:
                    best = (done + n, spot.ends[segment[:n]])
                    break
            spot = spot.below.get(segment)
            if spot is None:
                break
            done += len(segment) + 1
        return best

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, rule, verdict) of the rule that wins, or None."""
        best, node, depth = None, self.root, 0
        labels = host.split(".") if host else []
        while True:
            if node.paths is not None and (found := self._longest(node.paths, path)):
                best = (depth, found[0], *found[1])
            if not labels or (node := node.below.get(labels.pop())) is None:
                return best
            depth += 1


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the module's docstring says."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for sign in "?#":
        rest = rest.partition(sign)[0]
    host, slash, path = rest.partition("/")
    lowered = host.lower() if host.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lowered, slash + path


def rule_shards(rules: Iterable[tuple[str, str, str]]) -> Iterator[list[tuple[str, str, str]]]:
    """Rules in their order, in lists of at most RULE_BYTES characters."""
    held, size = [], 0
    for rule in rules:
        if held and size + sum(map(len, rule)) > RULE_BYTES:
            yield held
            held, size = [], 0
        held.append(tuple(rule))
        size += sum(map(len, rule))
    yield held


_WORKER: dict[str, UrlTrie] = {}


def _trie(key: str, rules: list[tuple[str, str, str]]) -> UrlTrie:
    """One trie a worker, so that it outlives a task."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = UrlTrie(rules)
    return _WORKER[key]


STATE = "page_id long, url string, labels int, length int, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, else null) and verdict of every url."""
    context = pages.sparkSession.sparkContext
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.selectExpr("*", "cast(null as int) AS labels", "cast(null as int) AS length", "cast(null as string) AS rule", "cast(null as string) AS verdict")
    shards = list(rule_shards(rules))

    def matcher(shard: list[tuple[str, str, str]], last: bool):
        shared, key = context.broadcast(shard), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = _trie(key, shared.value)
            for batch in batches:
                out = []
                for page, one, *best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    host, path = split_url(one)
                    match = trie.match(host, path)
                    if match and (best[0] is None or match[:2] >= tuple(best[:2])):
                        best = match
                    out.append((page, host, path, best[2], best[3] or default) if last else (page, one, *best))
                shape = SCHEMA if last else STATE
                names = [f.split()[0] for f in shape.split(", ")]
                types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in shape.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)

        return run, shared

    for shard in shards[:-1]:
        run, shared = matcher(shard, last=False)
        before, rows = rows, materialize(rows.mapInArrow(run, STATE), "url-matches")
        discard(before)
        shared.destroy()
    return rows.mapInArrow(matcher(shards[-1], last=True)[0], SCHEMA)
