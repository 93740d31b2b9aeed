"""Census-like wide tables: key columns, ratios and densities, outer joins of sources, weighted resampling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.operators.hexcells import parents


def pick_geoid(columns: Sequence[str]) -> str | None:
    """GEOID, then GEOID20, GEOID10, GEOID with two digits, with any digits, then any name that holds GEOID."""
    for pattern in (r"GEOID", r"GEOID20", r"GEOID10", r"GEOID\d\d", r"GEOID\d+", r".*GEOID.*"):
        for c in columns:
            if re.fullmatch(pattern, c):
                return c
    return None


def field_name(column: str) -> str:
    """The field behind a derived column: trailing _ratio, _log and _density fall off."""
    while (bare := re.sub(r"_(ratio|log|density)$", "", column)) != column:
        column = bare
    return column


EVERYTHING = (None, "all", [], ())


def select_fields(catalogue: Mapping[str, Mapping], selection) -> dict[str, dict]:
    """The part of a catalogue (category to fields, fields_universe, ...) that is selected.

    ``selection`` is everything, a name, a list of names (``category`` or ``category_field``, with suffixes of derived
    columns or without), or a mapping of category to fields.
    """
    wanted: dict[str, list[str] | None] = {}
    if isinstance(selection, Mapping):
        for category, names in selection.items():
            if names is not None and not isinstance(names, (str, list, tuple)):
                raise ValueError(f"fields of {category} are given as {names!r}")
            wanted[category] = None if names in EVERYTHING else [names] if isinstance(names, str) else list(names)
    elif selection in EVERYTHING:
        wanted = dict.fromkeys(catalogue)
    elif isinstance(selection, (str, list, tuple)):
        for name in [selection] if isinstance(selection, str) else selection:
            category, _, one = field_name(name).partition("_")
            if not one:
                wanted[category] = None
            elif wanted.get(category, []) is not None:
                wanted.setdefault(category, []).append(one)
    else:
        raise ValueError(f"no selection: {selection!r}")
    out = {}
    for category, names in wanted.items():
        if category in catalogue:
            known = catalogue[category].get("fields", {})
            kept = dict(known) if names is None else {k: known[k] for k in dict.fromkeys(map(field_name, names)) if k in known}
            universe = catalogue[category].get("fields_universe", {})
            out[category] = {**catalogue[category], "fields": kept, "fields_universe": {k: universe.get(k, "default") for k in kept}}
    return out


def plain_catalogue(catalogue: Mapping[str, Mapping], sources: Mapping[str, str], year: int) -> dict[str, dict]:
    """A catalogue with sources by their full names, years filled in, columns named ``<year>_<category>_<field>``, and universes and
    weights that name such columns.

    ``sources`` maps short names of sources to full ones. A universe "default" is the category's own (NO_DENSITY_OR_RATIO without one).
    """
    out = {}
    for category, entry in catalogue.items():
        years = entry.get("years") or [year]
        column = lambda y, f: f"{y}_{category}_{f}"  # noqa: B023, E731
        special = ("NO_DENSITY_OR_RATIO", "DENSITY_ONLY")
        fallback = entry.get("universe", "NO_DENSITY_OR_RATIO")
        universe, fields_, weights = {}, {}, {}
        for y in years:
            for name, codes in entry.get("fields", {}).items():
                fields_[column(y, name)] = [codes] if isinstance(codes, str) else list(codes)
                base = entry.get("fields_universe", {}).get(name, "default")
                base = fallback if base == "default" else base
                universe[column(y, name)] = base if base in special else column(y, base)
                if name in entry.get("agg_weights", {}):
                    weights[column(y, name)] = column(y, entry["agg_weights"][name])
        out[category] = {"source": sources.get(entry["source"], entry["source"]), "years": list(years), "fields": fields_, "fields_universe": universe, "agg_weights": weights}
    return out


def plain_filter(filters: Mapping[str, object] | None) -> dict[str, list[str]]:
    """Filter values as lists of texts; keys without values go."""
    as_list = lambda v: [str(x) for x in v] if isinstance(v, (list, tuple, set)) else [str(v)]
    return {k: as_list(v) for k, v in (filters or {}).items() if v is not None and v != [] and v != "all"}


def filtered(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    for column, values in plain_filter(filters).items():
        df = df.filter(F.col(column).cast("string").isin(values))
    return df


def fields(df: DataFrame, codes: Mapping[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """One column per field: the sum of its code columns, null counted 0."""
    return df.select(*keys, *(sum((F.coalesce(F.col(c), F.lit(0)) for c in cs[1:]), F.coalesce(F.col(cs[0]), F.lit(0))).alias(name) for name, cs in codes.items()))


def outer_join(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def join_shapes(shapes: DataFrame, table: DataFrame) -> DataFrame:
    """Inner join on the key column each side has (as whole numbers), and on NAME where both have it."""
    key = lambda df: df.withColumn("GEOID", F.expr(f"try_cast(`{pick_geoid(df.columns)}` AS bigint)")).filter("GEOID IS NOT NULL")
    return key(shapes).join(key(table), ["GEOID", *(["NAME"] if "NAME" in shapes.columns and "NAME" in table.columns else [])])


def ratios(df: DataFrame, universe: Mapping[str, str], area_km2: str | None = None) -> DataFrame:
    """``<field>_ratio`` to its universe; NO_DENSITY_OR_RATIO and DENSITY_ONLY as universe mean what they say."""
    out = df
    for name, base in universe.items():
        if base not in ("NO_DENSITY_OR_RATIO", "DENSITY_ONLY"):
            out = out.withColumn(f"{name}_ratio", F.try_divide(F.col(name).cast("double"), F.col(base)))
        if area_km2 and base != "NO_DENSITY_OR_RATIO":
            out = out.withColumn(f"{name}_density", F.try_divide(F.col(name).cast("double"), F.col(area_km2)))
    return out


def resample(df: DataFrame, key: str, sums: Sequence[str], means: Mapping[str, str]) -> DataFrame:
    """Sums of counts, and means of rates weighted by a column, per ``key``."""
    weighted = [F.try_divide(F.sum(F.col(v) * F.col(w)), F.sum(w).cast("double")).alias(v) for v, w in means.items()]
    return df.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), *weighted)


def roll_up_blocks(df: DataFrame, code: str, digits: int, values: Sequence[str]) -> DataFrame:
    """Block rows summed under the first digits of their code."""
    return df.groupBy(F.substring(code, 1, digits).alias("GEOID")).agg(*(F.sum(v).alias(v) for v in values))


def resample_to(areas: DataFrame, targets: DataFrame, block: float, sums: Sequence[str], means: Mapping[str, str]) -> DataFrame:
    """Areas (sid, ``shape`` or closed ``ring``, values) into the targets (tid, ring) that hold their centroids: sums of counts, weighted means of rates.
    Targets without an area have nulls."""
    rows = parents(areas, targets, block).drop("n_children").join(areas.drop("ring", "shape"), "sid")
    return targets.select("tid").join(resample(rows, "tid", sums, means), "tid", "left")


def statistics(df: DataFrame, label: str, value: str, total: str = "total population") -> DataFrame:
    """``value`` summed by ``label``, a row for the total, and percents of it (two places)."""
    sums = df.rollup(label).agg(F.sum(value).alias(value), F.grouping(label).alias("__g"))
    whole = F.max(F.when(F.col("__g") == 1, F.col(value))).over(Window.partitionBy(F.lit(0)))  # a row per label
    return sums.select(F.when(F.col("__g") == 1, total).otherwise(F.col(label)).alias(label), value, F.round(100.0 * F.col(value) / whole, 2).alias("percent"))
