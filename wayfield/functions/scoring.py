"""Scores as Column-building functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elasticity_score(value: Column, reference: float, elasticity: float | Callable[[Column], Column] | Sequence[tuple[float | None, float]], steps: int = 200) -> Column:
    """(value / reference) ** e, and 1 at the reference.

    ``elasticity`` is e; or (lower bound, e) pairs, of which the piece that holds the value gives e (a bound of None is the
    lowest); or a function of x as a Column, then the score is exp of the integral of e(x) / x from reference to value, by
    trapezoids over ``steps`` points.
    """
    ref = F.lit(float(reference))
    if callable(elasticity):
        at = lambda i: ref + (value - ref) * i / F.lit(float(steps - 1))
        f = lambda x: elasticity(x) / x
        ends = (f(at(F.lit(0))) + f(at(F.lit(steps - 1)))) / 2
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 2)), F.lit(0.0), lambda acc, i: acc + f(at(i)))
        out = F.exp((ends + inner) * (value - ref) / F.lit(float(steps - 1)))
    elif isinstance(elasticity, (int, float)):
        out = F.pow(value / ref, F.lit(float(elasticity)))
    else:
        pieces = sorted(((float("-inf") if low is None else float(low)), float(e)) for low, e in elasticity)
        exponent = F.lit(pieces[0][1])
        for low, e in pieces[1:]:
            exponent = F.when(value >= F.lit(low), F.lit(e)).otherwise(exponent)
        out = F.pow(value / ref, exponent)
    return F.when(value == ref, F.lit(1.0)).otherwise(out)


def calibrated(score: Callable[..., Column], low: tuple, high: tuple, least: float = 0.0, most: float = 1.0) -> Callable[..., Column]:
    """An affine rescaling of ``score`` that is ``least`` at the arguments ``low`` and ``most`` at ``high``; not clamped."""
    at = lambda args: score(*(F.lit(a) for a in args))
    return lambda *args: F.lit(least) + (score(*args) - at(low)) * (most - least) / (at(high) - at(low))


def elasticity_from_linear_decay(decay: float, point: float) -> float:
    return -abs(decay) * point / (1 - abs(decay) * point)


def by_values(value: Column, ordered: Sequence[str]) -> Column:
    """First listed 1.0, then in equal steps down; null where not listed."""
    out = F.lit(None).cast("double")
    for i, name in enumerate(ordered):
        out = F.when(value == name, F.lit(round((len(ordered) - i) / len(ordered), 3))).otherwise(out)
    return out


def thresholds_exceeded(value: Column, steps: Sequence[float]) -> Column:
    return sum((F.when(value > F.lit(float(s)), 1).otherwise(0) for s in steps[1:]), F.when(value > F.lit(float(steps[0])), 1).otherwise(0))


def grid_ceiling(value: Column, grid: Sequence[float]) -> Column:
    """The least grid value that is at least ``value``; null beyond the grid."""
    return F.array_min(F.filter(F.array(*(F.lit(float(g)) for g in sorted(grid))), lambda g: g >= value))


def grid_ceiling_clipped(value: Column, grid: Sequence[float]) -> Column:
    """The same, and the largest grid value beyond the grid."""
    return F.coalesce(grid_ceiling(value, grid), F.when(value.isNotNull(), F.lit(float(max(grid)))))


def adaptive_grid(score: Callable[[float], float], low: float, high: float, delta: float, max_rounds: int = 60) -> list[float]:
    """Grid values between which ``score`` changes by at most ``delta``: midpoints are added where it changes by more.

    Raises where ``max_rounds`` halvings do not reach delta (a jump).
    """
    grid = [float(low), float(high)]
    for _ in range(max_rounds):
        wide = [i for i in range(len(grid) - 1) if abs(score(grid[i + 1]) - score(grid[i])) > delta]
        if not wide:
            return grid
        grid = sorted(grid + [(grid[i] + grid[i + 1]) / 2 for i in wide])
    raise ValueError(f"the score changes by more than {delta} within {(high - low) / 2**max_rounds}")


def adaptive_grids(score: Callable[..., float], bounds: Mapping[str, tuple[float, float] | Sequence], delta: float, max_rounds: int = 30) -> dict[str, list]:
    """A grid per variable such that a step along any of them changes the score by at most ``delta``, wherever on their grids the others are.

    Two numbers in a tuple are the ends of a continuous variable; any other sequence is a discrete one, whose values are its grid. Axes are refined in
    turns, against the largest change over the whole grids of the others. Raises where ``max_rounds`` rounds do not reach delta.
    """
    continuous = {k for k, b in bounds.items() if isinstance(b, tuple) and len(b) == 2 and all(isinstance(v, int | float) for v in b)}
    grids = {k: [float(v) for v in b] if k in continuous else list(b) for k, b in bounds.items()}

    def worst(name: str) -> list[float]:
        """The largest change over each interval of an axis."""
        others = [k for k in grids if k != name]
        out = [0.0] * (len(grids[name]) - 1)
        for values in product(*(grids[k] for k in others)):
            along = [score(**dict(zip(others, values, strict=True)), **{name: v}) for v in grids[name]]
            out = [max(w, abs(b - a)) for w, a, b in zip(out, along, along[1:], strict=False)]
        return out

    for _ in range(max_rounds):
        changed = False
        for name in continuous:
            grid = grids[name]
            middles = [(grid[i] + grid[i + 1]) / 2 for i, w in enumerate(worst(name)) if w > delta]
            grids[name] = sorted(grid + middles)
            changed |= bool(middles)
        if not changed:
            return grids
    raise ValueError(f"the score changes by more than {delta} between neighbours after {max_rounds} rounds")


#: The transit score's elasticities, mode factors, references and anchors.
TRANSIT = {
    "elasticity": {"headway": -0.35, "distance": -0.25, "speed": 0.2},
    "reference": {"headway": 5.0, "distance": 100.0, "speed": 150.0},
    "mode_factor": {"bus": 0.85, "tram": 0.92, "rail": 1.0},
    "best": {"headway": 5.0, "mode": "rail", "speed": 30.0, "distance": 100.0},
    "worst": {"headway": 720.0, "mode": "bus", "speed": 10.0, "distance": 2000.0},
    "least": 0.1,
}


class TransitScore:
    """Stop and access scores from headway, mode, speed and walking distance; all its state is ``parameters`` (JSON)."""

    def __init__(self, parameters: Mapping | None = None):
        self.parameters = dict(parameters or TRANSIT)

    def _part(self, name: str, value: Column) -> Column:
        return elasticity_score(value, self.parameters["reference"][name], self.parameters["elasticity"][name])

    def _mode(self, mode: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, factor in self.parameters["mode_factor"].items():
            out = F.when(mode == name, F.lit(float(factor))).otherwise(out)
        return out

    def _anchor(self, which: str, *names: str) -> tuple:
        return tuple(self.parameters[which][n] for n in names)

    def stop(self) -> Callable[..., Column]:
        """Of (headway, mode, speed); the least at the worst anchor, 1 at the best, not clamped."""
        raw = lambda h, m, v: self._part("headway", h) * self._mode(m) * self._part("speed", v)
        names = ("headway", "mode", "speed")
        return calibrated(raw, self._anchor("worst", *names), self._anchor("best", *names), self.parameters["least"], 1.0)

    def access(self) -> Callable[..., Column]:
        """Of (headway, mode, speed, distance), calibrated again."""
        stop = self.stop()
        raw = lambda h, m, v, d: stop(h, m, v) * self._part("distance", d)
        names = ("headway", "mode", "speed", "distance")
        return calibrated(raw, self._anchor("worst", *names), self._anchor("best", *names), self.parameters["least"], 1.0)

    def walk(self, stop_score: Column, distance: Column) -> Column:
        """Access score of a stop's score at a distance, calibrated between the worst stop far off and the best near by."""
        worst, best = self.parameters["worst"]["distance"], self.parameters["best"]["distance"]
        raw = lambda s, d: s * self._part("distance", d)
        return calibrated(raw, (self.parameters["least"], worst), (1.0, best), self.parameters["least"], 1.0)(stop_score, distance)


def score_matrix(stops: DataFrame, score: str, distances: Sequence[float], model: Callable[[Column, Column], Column], grid: Sequence[float]) -> DataFrame:
    """(score, distance, value): each distinct stop score at each distance, snapped up to ``grid``; both lists are given, so the product is small."""
    each = stops.select(F.col(score).alias("score")).filter("score IS NOT NULL").distinct()
    rows = each.withColumn("distance", F.explode(F.array(*(F.lit(float(d)) for d in distances))))
    return rows.withColumn("value", grid_ceiling_clipped(model(F.col("score"), F.col("distance")), grid))


def pivoted(matrix: DataFrame, distances: Sequence[float]) -> DataFrame:
    """One row per score, one column per distance."""
    wide = matrix.groupBy("score").pivot("distance", [float(d) for d in distances]).agg(F.first("value"))
    return wide.select("score", *(F.col(f"`{float(d)}`").alias(f"d{d:g}") for d in distances))
