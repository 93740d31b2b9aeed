"""Quality rules: text statistics, and robust multivariate outliers per language and source.

Base statistics come from the words ``[^\\x20\\x09-\\x0D]+`` of the whole text. Each document's
statistic vector (word length, symbols per word, share of repeated lines, share of repeated words,
each transformed) is held in thousandths as whole numbers. Per group a minimum-covariance-determinant
estimate is made: from each of several starts (the coordinate-wise median with quartile ranges, the median with sampling
deviations alone, all documents' mean and covariance) the nearest share ``KEEP_SHARE`` of documents is kept, mean
and covariance of these give new distances, and so on until the determinant no longer falls; of all
starts and steps the one of least determinant wins. A document is rejected where its squared
Mahalanobis distance is over ``CUTOFF``, the chi-square quantile for the four statistics; the covariance is made
consistent for the share kept.

Groups are (language, source), inside languages, inside all; all three are estimated in the same passes. In the end a
group's estimate counts the one above it as ``PRIOR`` more documents, whatever its size: a group of a handful leans on
its language, one of a million stands alone.
A document's statistics vary by sampling besides: ``SAMPLING`` is the deviation in a document of ``MIN_WORDS`` words,
and its square adds to the variances (the estimate is the regularised one, and never singular: most
documents have no symbol and no repeated line). Each is small enough that its statistic alone can pass the
cutoff (words repeat in at most half of a document that the base rules leave).

Every step is a grouped sum over fixed-size partial results: quartiles come from counts of at most some thousand
values, and a cut at the h-th distance from a histogram of distances, so a group of any size is summed in parallel.

Defined cases: null text counts as empty and has no words; texts of any length count whole; null language or source
is a value of its own; documents failing the base rules are rejected and take no part in the estimates; repeated rows
count each; an empty table gives no rows; extra columns, whatever their names, stay as they are (``judge``
puts its own in the place of columns named as those).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.llm.carry import packed, unpacked
from wayfield.session import discard, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FEATURES = ("word_length", "symbols", "repeat_lines", "repeat_words")
SCALE = 1000
#: In a document of MIN_WORDS words: word lengths vary by 0.57 of their mean; a symbol every 32 words; shares of eleven lines
#: and of 25 windows.
SAMPLING = (0.08, 0.25, 0.15, 0.1)
KEEP_SHARE = 0.75
PRIOR = 200
#: Chi-square with 4 degrees of freedom: 0.999 is its distribution here.
CUTOFF = 18.4668
#: A determinant that falls by a smaller share than this has settled.
SETTLED = 1e-9
#: Chi-square with 4 degrees of freedom: 0.75 is its distribution at 5.3853; with 6, 0.5046 is.
CONSISTENCY = 0.75 / 0.504628
BINS_PER_OCTAVE = 32
MAX_BROADCAST_GROUPS = 20_000
MAX_BROADCAST_REJECTED = 2_000_000
WORD = r"[^\x20\x09-\x0D]+"
_POSITION_BITS = 22


def _repeated_words(words: str) -> str:
    """Words inside three-word windows that occur twice or more, from the sorted windows.

    A window is a hash above its position in one long, so the array sorts as primitives. Equal
    hashes are compared word by word; a text where two different windows share a hash (or with
    more words than positions have bits) goes the way of sorting the windows themselves.
    """
    mask = (1 << _POSITION_BITS) - 1
    packed = f"sort_array(transform(sequence(0, size({words}) - 3), i -> ((xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) & {~mask}L) | i)))"
    return f"CASE WHEN size({words}) < 3 OR size({words}) >= {mask} THEN cast(array() as array<bigint>) ELSE {packed} END"


def _same_words(words: str, a: str, b: str) -> str:
    mask = (1 << _POSITION_BITS) - 1
    pick = lambda x, k: f"{words}[cast(({x} & {mask}L) as int) + {k}]"
    return " AND ".join(f"{pick(a, k)} = {pick(b, k)}" for k in range(3))


def _covered(starts: str) -> str:
    """How many positions the windows starting at these sorted positions cover."""
    return f"aggregate({starts}, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', cast(p as bigint), 'n', a.n + least(3L, p - a.last)), a -> a.n)"


def statistics(docs: DataFrame, text: str, carried: list[Column], kept: list[str]) -> DataFrame:
    """The columns ``carried`` (named ``kept``), with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    out = docs.select(*carried, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    out = out.withColumn("__words", F.expr(f"regexp_extract_all(__text, r'{WORD}', 0)"))
    out = out.withColumn("__lines", F.expr(f"filter(split(__text, '\\n', -1), l -> l rlike r'{WORD}')"))
    out = out.withColumn("__windows", F.expr(_repeated_words("__words")))
    shift, words = _POSITION_BITS, "__words"
    same = lambda a, b: f"(shiftright({a}, {shift}) = shiftright({b}, {shift}))"
    out = out.withColumn("__twice", F.expr(f"filter(__windows, (w, i) -> (i > 0 AND {same('w', '__windows[i - 1]')}) OR (i + 1 < size(__windows) AND {same('w', '__windows[i + 1]')}))"))
    clash = f"exists(sequence(1, size(__twice) - 1), i -> {same('__twice[i]', '__twice[i - 1]')} AND NOT ({_same_words(words, '__twice[i]', '__twice[i - 1]')}))"
    out = out.withColumn("__exact", F.expr(f"size({words}) >= {(1 << shift) - 1} OR (size(__twice) > 1 AND {clash})"))
    slow = f"""array_sort(transform(sequence(0, size({words}) - 3), i -> named_struct('w', concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]), 'p', cast(i as bigint))))"""
    out = out.withColumn("__slow", F.expr(f"CASE WHEN __exact THEN {slow} END"))
    slow_starts = "array_sort(transform(filter(__slow, (x, i) -> (i > 0 AND x.w = __slow[i - 1].w) OR (i + 1 < size(__slow) AND x.w = __slow[i + 1].w)), x -> x.p))"
    starts = f"sort_array(transform(__twice, w -> w & {(1 << shift) - 1}L))"
    repeat = f"CASE WHEN __exact THEN {_covered(slow_starts)} WHEN size(__twice) = 0 THEN 0L ELSE {_covered(starts)} END"
    out = out.select(
        *(F.col(f"`{c}`") for c in kept),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(__text, r'[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(size(__lines) as bigint)").alias("__n_lines"),
        F.expr(repeat).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics in thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(10 * F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
    )
    return [F.round(SCALE * x).cast("long").alias(f"__x{k}") for k, x in enumerate(raw)]


def _attach(rows: DataFrame, small: DataFrame, keys: list[str], n_groups: int, how: str = "left") -> DataFrame:
    """Join one row per group; sent to every task only where the groups are counted and few."""
    return rows.join(F.broadcast(small) if n_groups <= MAX_BROADCAST_GROUPS else small, keys, how)


def _bin(distance: str) -> str:
    return f"cast(floor(log2({distance} + 1) * {BINS_PER_OCTAVE}) as int)"


#: A group: level (0 all, 1 a language, 2 a source of it), language and source, the last two empty where the level has none.
GROUP = ["__lv", "__a", "__b"]
RUN = [*GROUP, "__s"]


def _cut(rows: DataFrame) -> DataFrame:
    """Per group and start the smallest histogram bin that, with all below, holds the share to keep."""
    histogram = rows.groupBy(*RUN, "__bin").agg(F.count("*").alias("__c"))
    total = Window.partitionBy(*RUN)
    cumulated = histogram.select(*RUN, "__bin", F.sum("__c").over(total.orderBy("__bin")).alias("__below"), F.sum("__c").over(total).alias("__n"))
    return cumulated.filter(F.col("__below") >= F.ceil(F.lit(KEEP_SHARE) * F.col("__n"))).groupBy(*RUN).agg(F.min("__bin").alias("__cut"))


P = len(FEATURES)
X = [f"__x{k}" for k in range(P)]
MEANS = [f"__m{k}" for k in range(P)]
LOWER = [f"{k}_{j}" for k in range(P) for j in range(k + 1)]
SPREADS, FACTORS = [f"__b{kj}" for kj in LOWER], [f"__l{kj}" for kj in LOWER]


#: Whole-number sums, so that their order does not matter.
SUMS = [
    "cast(count(*) as double) AS __h",
    *(f"cast(sum(cast({x} as decimal(19,0))) as double) AS __s{k}" for k, x in enumerate(X)),
    *(f"cast(sum(cast(__x{k} * __x{j} as decimal(19,0))) as double) AS __s{k}_{j}" for k in range(P) for j in range(k + 1)),
]


def _let(name: str, value: str, then: str) -> str:
    """``then``, in which ``name`` is a value that is computed once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _factored(means: dict[str, str], spreads: dict[str, str]) -> str:
    """Struct of the estimate: means, spreads, the lower Cholesky factor of spreads plus sampling variance, its determinant."""
    factors = {f"__l{k}_{j}": f"f{j}.__l{k}_{j}" for k in range(P) for j in range(k + 1)}
    det = " * ".join(f"f{k}.__l{k}_{k}" for k in range(P))
    out = _struct({c: f"v.{c}" for c in (*MEANS, *SPREADS)} | factors | {"__det": det})
    for j in reversed(range(P)):
        left = lambda k: f"v.__b{k}_{j}" + (f" + {(SAMPLING[k] * SCALE) ** 2!r}D" if k == j else "") + "".join(f" - f{c}.__l{k}_{c} * f{c}.__l{j}_{c}" for c in range(j))  # noqa: B023, E731
        column = _struct({f"__l{j}_{j}": f"d{j}"} | {f"__l{k}_{j}": f"({left(k)}) / d{j}" for k in range(j + 1, P)})
        out = _let(f"d{j}", f"sqrt(greatest({left(j)}, 1e-9D))", _let(f"f{j}", column, out))
    return _let("v", _struct(means | spreads), out)


def _estimated(consistency: float = CONSISTENCY) -> str:
    """The estimate's struct from SUMS."""
    own = _struct({f"o{k}": f"__s{k} / __h" for k in range(P)})
    spread = {f"__b{kj}": f"{consistency!r}D * (__s{kj} / __h - o.o{kj[0]} * o.o{kj[2]})" for kj in LOWER}
    return _let("o", own, _factored({f"__m{k}": f"o.o{k}" for k in range(P)}, spread))


def _pooled() -> str:
    """The struct of the estimate in __e over __h documents with the one above, in __up, as PRIOR documents more."""
    w = f"({float(PRIOR)!r}D / (__h + {float(PRIOR)!r}D))"
    apart = lambda k: f"(__e.__m{k} - __up.__m{k})"
    means = {c: f"(1 - {w}) * __e.{c} + {w} * __up.{c}" for c in MEANS}
    return _factored(means, {f"__b{kj}": f"(1 - {w}) * __e.__b{kj} + {w} * __up.__b{kj} + {w} * (1 - {w}) * {apart(kj[0])} * {apart(kj[2])}" for kj in LOWER})


def _distance() -> str:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[str] = []
    for k in range(P):
        z.append(f"((__x{k} - __m{k}" + "".join(f" - __l{k}_{j} * {z[j]}" for j in range(k)) + f") / __l{k}_{k})")
    return "(" + " + ".join(f"{v} * {v}" for v in z) + ")"


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates (GROUP, __s, __e) that concentration begins from."""
    quartiles = [f"percentile({x}, array(0.25D, 0.5D, 0.75D)) AS __q{k}" for k, x in enumerate(X)]
    each = materialize(rows.groupBy(*GROUP).agg(*map(F.expr, [*quartiles, *SUMS])), "quality-groups")
    spread = lambda k: f"pow(greatest((__q{k}[2] - __q{k}[0]) / 1.349D, {SAMPLING[k] * SCALE!r}D), 2.0D) - {(SAMPLING[k] * SCALE) ** 2!r}D"
    median = {f"__m{k}": f"__q{k}[1]" for k in range(P)}
    diagonal = lambda f: {f"__b{k}_{j}": f(k) if k == j else "0.0D" for k in range(P) for j in range(k + 1)}
    starts = [_factored(median, diagonal(spread)), _factored(median, diagonal(lambda k: "0.0D")), _estimated(1.0)]
    one = "explode(array(" + ", ".join(f"struct({i} AS __s, {e} AS __e)" for i, e in enumerate(starts)) + ")) AS x"
    return materialize(each.selectExpr(*GROUP, one).select(*GROUP, "x.*"), "quality-starts")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _named(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("~"))


def _concentrate(rows: DataFrame) -> DataFrame:
    """Per group (GROUP) the estimate of least determinant, as __e, over how many documents, as __h."""
    starts = _starts(rows)
    moving = starts.select(*RUN, "__e.*").withColumn("__det", F.lit(float("inf")))
    n_groups, found, written = starts.count(), [], [starts]
    while not moving.isEmpty():  # each round lowers the determinant of all that stay in it, so there is a last one
        binned = _attach(rows, moving, GROUP, n_groups, "inner").selectExpr(*RUN, *X, "__det AS __before", _bin(_distance()) + " AS __bin")
        near = _attach(binned, _cut(binned), RUN, n_groups).filter(F.col("__bin") <= F.col("__cut"))
        sums = near.groupBy(*RUN, "__before").agg(*map(F.expr, SUMS))
        after = materialize(sums.selectExpr(*RUN, "__before", "__h", _estimated() + " AS __e"), "quality-estimate")
        fell = after.filter(F.col("__e.__det") < (1 - SETTLED) * F.col("__before"))
        moving = fell.select(*RUN, "__e.*")
        written.append(after)
        found.append(fell.select(*RUN, "__h", "__e"))
    if not found:
        return starts.select(*GROUP, F.lit(0.0).alias("__h"), "__e")
    best = F.min_by(F.struct("__h", "__e"), F.struct("__e.__det", "__s")).alias("x")
    out = materialize(reduce(DataFrame.unionByName, found).groupBy(*GROUP).agg(best).select(*GROUP, "x.*"), "quality-estimates")
    for df in written:
        discard(df)
    return out


def _fit(stats: DataFrame) -> DataFrame:
    """The estimate (MEANS, FACTORS) of each __lang, __source that has sound documents, those above counted in."""
    sound = stats.filter(~F.col("base_failed"))
    none = F.lit("")
    levels = F.array(*(F.struct(F.lit(i).alias("__lv"), a.alias("__a"), b.alias("__b")) for i, (a, b) in enumerate(((none, none), (F.col("__lang"), none), (F.col("__lang"), F.col("__source"))))))
    every = _concentrate(sound.select(F.explode(levels).alias("__k"), *X).select("__k.*", *X))
    level = lambda i: every.filter(F.col("__lv") == i)
    langs = level(1).crossJoin(F.broadcast(level(0).select(F.col("__e").alias("__up"))))  # one row for all documents
    langs = materialize(langs.selectExpr("__a", _pooled() + " AS __up"), "quality-languages")
    out = level(2).join(langs, "__a").selectExpr("__a AS __lang", "__b AS __source", _pooled() + " AS __e")
    out = materialize(out, "quality-fitted")
    discard(every)
    return out.select("__lang", "__source", *(f"__e.{c}" for c in (*MEANS, *FACTORS)))


def measured(docs: DataFrame, text: str, lang: str, source: str, carried: Column) -> DataFrame:
    """``carried`` (one column), __lang, __source, the statistics and the vector, written once."""
    name = docs.select(carried).columns[0]
    columns = [carried, _named(lang).alias("__lang"), _named(source).alias("__source")]
    return materialize(statistics(docs, text, columns, [name, "__lang", "__source"]).select("*", *vector()), "quality-statistics")


def _verdicts(stats: DataFrame) -> DataFrame:
    """``stats`` with ``distance`` (squared) and ``kept``."""
    estimate = _fit(stats)
    judged = _attach(stats, estimate, ["__lang", "__source"], estimate.count())
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.expr(_distance())))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the text, with the base statistics, ``distance`` (squared) and ``kept``."""
    others = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    judged = _verdicts(measured(docs, text, lang, source, packed(others)))
    out = (*STATISTICS, "distance", "kept")
    return judged.select(*unpacked(others, but=out), *out)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept.

    A verdict depends on text, language and source alone, so what is rejected is named by a hash of these; the list is
    sent to all tasks where it is counted and small, and joined otherwise.
    """
    of = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _named(lang), _named(source)).alias("__of")
    judged = _verdicts(measured(docs, text, lang, source, of))
    rejected = materialize(judged.filter(~F.col("kept")).select("__of").distinct(), "quality-rejected")
    few = rejected.count() <= MAX_BROADCAST_REJECTED
    return docs.select(packed(docs), of).join(F.broadcast(rejected) if few else rejected, "__of", "left_anti").select(*unpacked(docs))
