"""Secret scans with built-in functions only.

Base kinds are found by pattern: ``assign`` (a secret's name, then ``:`` or ``=``, then a value),
``access`` (AKIA...) and ``hex`` (long runs of lower-case hex digits). The method adds spans by entropy:
a candidate is a maximal run of one character class, and a window of ``WINDOW`` characters slides
over it. The counts of the characters in the window are kept incrementally: a step adds one
character, removes one, and changes the sum of c*log2(c) by two table differences; that sum gives
the window's Shannon entropy. Where a window's entropy reaches the class's threshold, it is hot, and
the candidate's span goes from its first hot window to the end of its last. Candidates on the
allow list are suppressed: UUIDs, dates and plain numbers, and those without a digit that are cased like
words (capitals are a quarter at most, or nearly all letters are capitals); base spans never are.

c*log2(c) is held in billionths as whole numbers, so that the sum is the same whatever the order.

Everything is computed within a row: no shuffle. Defined cases: null text counts as empty and has
no spans, and stays null when masked; null doc_id stays null; texts of any length are scanned whole; repeated
rows are scanned each; an empty table gives no rows; extra columns, whatever their names, are ignored by
``scan`` and kept as they are by ``redact``. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.llm.carry import packed, unpacked

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
WINDOW = 20
SCALE = 1_000_000_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern`` are candidates; a window of at least ``bits`` per character is hot."""

    kind: str
    pattern: str
    alphabet: str
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789ABCDEFabcdef", 2.9),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", LETTERS + "+/_=-", 3.7),
)
ALLOWED = (
    r"^[0-9/_=+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9A-Fa-f]+$",
)
#: Of a candidate without digits: capitals and small letters, as shares 1/4 and 1/8 of its length at most.
CAPITALS, SMALL = 4, 8
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_SPANS = "array<struct<start:int,rank:int,stop:int>>"


def hot_sum(bits: float) -> int:
    """The largest sum of c*log2(c) over a window whose entropy is at least ``bits``."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def weights() -> list[int]:
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1))]


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _located(text: str, matches: str, pattern: str, rank: int) -> str:
    """Spans of all matches: what lies between them comes from splitting at the same pattern."""
    step = (
        f"(a, x) -> named_struct('at', a.at + length(x.gap) + length(x.hit), 'out', concat(a.out, array(named_struct("
        f"'start', a.at + length(x.gap), 'rank', {rank}, 'stop', a.at + length(x.gap) + length(x.hit)))))"
    )
    zipped = f"zip_with(slice(split({text}, {_literal(pattern)}, -1), 1, size({matches})), {matches}, (g, h) -> named_struct('gap', g, 'hit', h))"
    return f"CASE WHEN size({matches}) = 0 THEN cast(array() as {_SPANS}) ELSE aggregate({zipped}, named_struct('at', 0, 'out', cast(array() as {_SPANS})), {step}, a -> a.out) END"


def _hot(candidate: str, cls: CharacterClass) -> str:
    """First and last+1 hot position inside a candidate as struct(first, stop); first is -1 where none is."""
    table = "array(" + ", ".join(f"{w}L" for w in weights()) + ")"
    alphabet = f"'{cls.alphabet}'"
    n = len(cls.alphabet)
    new, old = (f"instr({alphabet}, substring({candidate}, {i}, 1))" for i in ("i", f"i - {WINDOW}"))
    gone = f"if(i > {WINDOW}, {old}, 0)"
    # counts are 1-based by letter; element_at(table, c + 1) is the weight of count c
    step = f"""(a, i) -> aggregate(array(named_struct('n', {new}, 'o', {gone})), a, (b, q) ->
      named_struct(
        'counts', CASE WHEN q.n = q.o THEN b.counts ELSE transform(b.counts, (c, j) -> c + if(j + 1 = q.n, 1, 0) - if(j + 1 = q.o, 1, 0)) END,
        'sum', b.sum
          + CASE WHEN q.n = q.o THEN 0L ELSE element_at({table}, element_at(b.counts, q.n) + 2) - element_at({table}, element_at(b.counts, q.n) + 1)
          + CASE WHEN q.o = 0 THEN 0L ELSE element_at({table}, element_at(b.counts, q.o)) - element_at({table}, element_at(b.counts, q.o) + 1) END END,
        'first', b.first, 'stop', b.stop))"""
    marked = f"""(a, i) -> transform(array(({step.replace('(a, i) -> ', '', 1)})), s -> named_struct('counts', s.counts, 'sum', s.sum,
      'first', if(i >= {WINDOW} AND s.sum <= {hot_sum(cls.bits)}L AND s.first < 0, i - {WINDOW}, s.first),
      'stop', if(i >= {WINDOW} AND s.sum <= {hot_sum(cls.bits)}L, i, s.stop)))[0]"""
    zero = f"named_struct('counts', array_repeat(0, {n}), 'sum', 0L, 'first', -1, 'stop', -1)"
    return f"aggregate(sequence(1, length({candidate})), {zero}, {marked}, a -> named_struct('first', a.first, 'stop', a.stop))"


def allowed_for(cls: CharacterClass) -> tuple[str, ...]:
    """The patterns of the allow list that hold for a class: hex digits alone are a candidate of their own class."""
    return ALLOWED[:-1] if cls.kind == "entropy_hex" else ALLOWED


def _suppressed(candidate: str, cls: CharacterClass) -> str:
    count = lambda p: f"regexp_count({candidate}, {_literal(p)})"
    words = f"({count('[0-9]')} = 0 AND ({CAPITALS} * {count('[A-Z]')} <= length({candidate}) OR {SMALL} * {count('[a-z]')} <= length({candidate})))"
    return "(" + " OR ".join([words, *(f"{candidate} rlike {_literal(r)}" for r in allowed_for(cls))]) + ")"


def _entropy_spans(spans: str, matches: str, cls: CharacterClass, rank: int) -> str:
    judged = f"""zip_with({spans}, {matches}, (s, m) -> named_struct('start', s.start, 'hot',
      CASE WHEN {_suppressed("m", cls)} THEN named_struct('first', -1, 'stop', -1) ELSE {_hot("m", cls)} END))"""
    kept = f"filter({judged}, z -> z.hot.first >= 0)"
    return f"CASE WHEN size({matches}) = 0 THEN cast(array() as {_SPANS}) ELSE transform({kept}, z -> named_struct('start', z.start + z.hot.first, 'rank', {rank}, 'stop', z.start + z.hot.stop)) END"


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({names}, s.rank + 1), ':', s.start, ':', s.stop)), ',')")


def find_spans(docs: DataFrame, text: str, carried: Column) -> DataFrame:
    """``carried``, ``__text`` and the sorted arrays ``__base`` and ``__all`` of struct(start, rank, stop)."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **{c.kind: c.pattern for c in CLASSES}}
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = docs.select(carried, whole.alias("__text"))
    out = out.withColumns({f"__m_{k}": F.expr(f"regexp_extract_all(__text, {_literal(p)}, 0)") for k, p in patterns.items()})
    out = out.withColumn("__v_assign", F.expr(f"CASE WHEN size(__m_assign) = 0 THEN cast(array() as array<string>) ELSE regexp_extract_all(__text, {_literal(ASSIGN)}, 2) END"))
    out = out.withColumns({f"__s_{k}": F.expr(_located("__text", f"__m_{k}", p, KINDS.index(k))) for k, p in patterns.items()})
    out = out.withColumn("__s_assign", F.expr(f"filter(__s_assign, (s, i) -> length(__v_assign[i]) >= {MIN_ASSIGNED})"))
    out = out.withColumns({f"__e_{c.kind}": F.expr(_entropy_spans(f"__s_{c.kind}", f"__m_{c.kind}", c, KINDS.index(c.kind))) for c in CLASSES})
    base = "concat(__s_assign, __s_access, __s_hex)"
    extra = ", ".join(f"__e_{c.kind}" for c in CLASSES)
    return out.withColumns({"__base": F.expr(f"array_sort({base})"), "__all": F.expr(f"array_sort(concat({base}, {extra}))")})


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans, the hash of the base spans, and all spans as ``kind:start:end``."""
    return find_spans(docs, text, F.col(f"`{doc_id}`").cast("long").alias("doc_id")).select(
        "doc_id",
        *(F.size(f"__s_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined("__base").cast("binary"), 256).alias("base_sha256"),
        _joined("__all").alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask`` (overlapping spans by one); null text stays null."""
    out = find_spans(docs, text, packed(docs))
    clean = f"""aggregate(__all, named_struct('at', 0, 'parts', cast(array() as array<string>)), (a, s) ->
      CASE WHEN s.start >= a.at THEN named_struct('at', s.stop, 'parts', concat(a.parts, array(substring(__text, a.at + 1, s.start - a.at), '{mask}')))
           ELSE named_struct('at', greatest(a.at, s.stop), 'parts', a.parts) END,
      a -> concat(array_join(a.parts, ''), substring(__text, a.at + 1)))"""
    masked = F.expr(f"CASE WHEN __row.`{text}` IS NULL THEN NULL WHEN size(__all) = 0 THEN __text ELSE {clean} END")
    return out.select(*unpacked(docs, **{text: masked}))
