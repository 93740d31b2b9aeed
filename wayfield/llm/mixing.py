"""Mixing sources to target weights: hierarchical token budgets, with built-in functions only.

Leaves are (domain, language, source). A leaf can give ``max_epochs`` times its tokens; a node can
give what its leaves can. The budget goes down the tree: a node's share is split among its children
by weight, each at most what it can give, and what one cannot give goes to its siblings by weight.
As a child's limit counts all below it, a shortage is made up among siblings first and reaches
an ancestor's siblings only when a whole subtree is exhausted. Splitting is exact: with children in the
order of limit over weight, the exhausted ones are a prefix, found by running sums.

A leaf's share is whole epochs of all its documents, then a token-prefix of one more epoch: the
documents in a seeded order of that epoch while their running token count stays within the
rest. The running count never needs a leaf in one task: tokens are summed per slice of the
order, slices are added up, and only the one slice in which the prefix ends is put in order. A leaf of n
rows has about sqrt(n) slices of sqrt(n) rows, so neither step holds more than that in one task.

A token is a word ``[^\\x20\\x09-\\x0D]+``. Defined cases: null text has no tokens; null domain,
language or source is a leaf of its own; rows that repeat whole are chosen together; a leaf
without tokens gives nothing; weights that are not listed count 1, weight 0 gives nothing; an empty
table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.llm.carry import packed, unpacked
from wayfield.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
MAX_BROADCAST_LEAVES = 50_000
MAX_LISTED_WEIGHTS = 2_000
LEVELS = ("__domain", "__lang", "__source")


@dataclass(frozen=True)
class MixPlan:
    """Weights by level, budget as a share of the tokens there are, epochs and seed."""

    domain_weights: Mapping[str, float] = field(default_factory=dict)
    lang_weights: Mapping[str, float] = field(default_factory=dict)
    source_weights: Mapping[str, float] = field(default_factory=dict)
    budget_share: float = 0.8
    max_epochs: int = 2
    seed: int = 17


def _named(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    if len(weights) > MAX_LISTED_WEIGHTS:
        raise ValueError(f"at most {MAX_LISTED_WEIGHTS} weights can be listed for {level}")
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(F.col(level) == f"={name}", F.lit(float(weight))).otherwise(out)
    return out


def _split(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (with __cap, __weight and the parent's __given) with their own __share."""
    ratio = F.when(F.col("__weight") > 0, F.col("__cap") / F.col("__weight"))
    ordered = Window.partitionBy(*parent).orderBy(F.col("__ratio").asc_nulls_last(), F.col("__node"))
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    out = nodes.withColumn("__ratio", ratio)
    out = out.withColumns({"__spent": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)), "__open": F.sum("__weight").over(after)})
    out = out.withColumn("__full", F.coalesce(F.col("__given") - F.col("__spent") >= F.col("__ratio") * F.col("__open"), F.lit(False)))
    out = out.withColumns(
        {
            "__taken": F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(whole), F.lit(0.0)),
            "__weights": F.coalesce(F.sum(F.when(~F.col("__full"), F.col("__weight"))).over(whole), F.lit(0.0)),
        }
    )
    open_share = F.when(F.col("__weights") > 0, (F.col("__given") - F.col("__taken")) * F.col("__weight") / F.col("__weights")).otherwise(0.0)
    share = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(F.col("__cap"), open_share))
    return out.withColumn("__share", share).drop("__ratio", "__spent", "__open", "__full", "__taken", "__weights")


def budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """``leaves`` (one row each, with __tokens) with ``__budget``, the tokens that each is to give."""
    listed = {"__domain": plan.domain_weights, "__lang": plan.lang_weights, "__source": plan.source_weights}
    total = leaves.agg(
        F.coalesce(F.sum("__tokens"), F.lit(0)).cast("double").alias("__all"),
    )
    given = total.select((F.least(F.lit(plan.budget_share), F.lit(float(plan.max_epochs))) * F.col("__all")).alias("__given"), F.lit(1).alias("__root"))
    above: list[str] = ["__root"]
    parents = given
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg((F.sum("__tokens") * plan.max_epochs).cast("double").alias("__cap")).withColumn("__root", F.lit(1))
        nodes = nodes.join(parents, above).withColumns({"__weight": _weight(level, listed[level]), "__node": F.col(level)})
        shares = _split(nodes, above)
        parents = shares.select(*keys, F.col("__share").alias("__given"))
        above = keys
    return leaves.join(parents.withColumnRenamed("__given", "__budget"), list(LEVELS))


def _order(plan: MixPlan, epoch: Column, doc_id: Column, digest: Column) -> Column:
    """Place in the seeded order of an epoch, as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(plan.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("~")), digest).cast("binary"))


def _slice(order: Column, slices: Column) -> Column:
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * slices).cast("long")


def _chosen(docs: DataFrame, plan: MixPlan, domain: Column, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """The chosen rows as ``__row``, once per epoch that has them, with ``__n`` tokens and ``__epoch``."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(
        packed(docs),
        _named(domain).alias("__domain"),
        _named(F.col(f"`{lang}`")).alias("__lang"),
        _named(F.col(f"`{source}`")).alias("__source"),
        F.expr(f"cast(regexp_count(coalesce(cast(`{text}` as string), ''), r'{WORD}') as bigint)").alias("__n"),
        F.md5(content.cast("binary")).alias("__digest"),
        F.col(f"`{doc_id}`").alias("__id"),
    )
    narrow = materialize(keyed.select(*LEVELS, "__id", "__n", "__digest"), "mix-tokens")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("__n").alias("__tokens"), F.count("*").alias("__rows"))
    leaves = materialize(leaves, "mix-leaves")
    planned = budgets(leaves, plan).filter(F.col("__tokens") > 0)
    planned = planned.withColumn("__budget", F.floor("__budget").cast("long"))
    planned = planned.withColumns({"__epochs": F.floor(F.col("__budget") / F.col("__tokens")).cast("long")})
    planned = planned.withColumns(
        {"__rest": F.col("__budget") - F.col("__epochs") * F.col("__tokens"), "__slices": F.ceil(F.sqrt(F.col("__rows"))).cast("long")}
    )
    planned = materialize(planned.select(*LEVELS, "__epochs", "__rest", "__slices"), "mix-plan")
    few = planned.count() <= MAX_BROADCAST_LEAVES
    attach = lambda rows, small: rows.join(F.broadcast(small) if few else small, list(LEVELS))
    placed = attach(narrow, planned).withColumn("__order", _order(plan, F.col("__epochs"), F.col("__id"), F.col("__digest")))
    placed = placed.withColumn("__slice", _slice(F.col("__order"), F.col("__slices")))
    sums = placed.groupBy(*LEVELS, "__slice", "__rest").agg(F.sum("__n").alias("__n"))
    running = sums.withColumn("__end", F.sum("__n").over(Window.partitionBy(*LEVELS).orderBy("__slice")))
    ends = running.groupBy(*LEVELS).agg(
        F.min(F.when(F.col("__end") > F.col("__rest"), F.col("__slice"))).alias("__last"),
        F.coalesce(F.max(F.when(F.col("__end") <= F.col("__rest"), F.col("__end"))), F.lit(0)).alias("__base"),
    )
    ends = materialize(ends, "mix-ends")
    inside = attach(placed, ends).filter(F.col("__slice") == F.col("__last"))
    within = inside.withColumn("__end", F.col("__base") + F.sum("__n").over(Window.partitionBy(*LEVELS).orderBy("__order").rangeBetween(Window.unboundedPreceding, 0)))
    cuts = within.filter(F.col("__end") <= F.col("__rest")).groupBy(*LEVELS).agg(F.max("__order").alias("__cut"))
    final = planned.join(ends, list(LEVELS)).join(cuts, list(LEVELS), "left").select(*LEVELS, "__epochs", "__slices", "__last", "__cut")
    final = materialize(final, "mix-cuts")
    chosen = attach(keyed, final).withColumn("__order", _order(plan, F.col("__epochs"), F.col("__id"), F.col("__digest")))
    at = _slice(F.col("__order"), F.col("__slices"))
    in_prefix = F.when(F.col("__last").isNull() | (at < F.col("__last")), True).otherwise((at == F.col("__last")) & (F.col("__order") <= F.coalesce("__cut", F.lit(""))))
    chosen = chosen.withColumn("__copies", F.col("__epochs") + F.when(in_prefix, 1).otherwise(0)).filter(F.col("__copies") > 0)
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__epoch")
    return chosen.select("__row", "__n", epochs)


def mix(docs: DataFrame, plan: MixPlan, domain: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The chosen rows of ``docs``, once per epoch that has them, with ``epoch`` and ``n_tokens``."""
    rows = _chosen(docs, plan, domain, doc_id, text, lang, source)
    return rows.select(*unpacked(docs, but=("n_tokens", "epoch")), F.col("__n").alias("n_tokens"), F.col("__epoch").alias("epoch"))


def choose(docs: DataFrame, plan: MixPlan, domain: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The same rows with the columns of ``docs`` alone."""
    return _chosen(docs, plan, domain, doc_id, text, lang, source).select(*unpacked(docs))
