"""Vector costs and soft edit distance as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    floor = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(NORM_FLOOR))
    return dot(a, b) / (floor(a) * floor(b))


def scorer_cost(cos: Column) -> Column:
    """In [0, 1]."""
    return F.least(F.greatest(1 - cos, F.lit(0.0)), F.lit(1.0))


def evaluator_cost(cos: Column) -> Column:
    """In [0, 2]."""
    return 1 - F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))


def judge_cost(score: Column) -> Column:
    return F.coalesce(1 - score / 9.0, F.lit(1.0))


def soft_edit_distance(costs: Column, width: Column) -> Column:
    """Edit distance over a matrix of substitution costs, row by row; insertions and deletions cost 1."""
    first = F.transform(F.sequence(F.lit(0), width), lambda j: j.cast("double"))

    def row(acc: Column, r: Column) -> Column:
        start = F.array(F.get(acc, F.lit(0)) + 1)
        return F.aggregate(
            F.sequence(F.lit(1), width),
            start,
            lambda cur, j: F.concat(cur, F.array(F.least(F.get(acc, j) + 1, F.get(cur, j - 1) + 1, F.get(acc, j - 1) + F.get(r, j - 1)))),
        )

    distance = F.element_at(F.aggregate(costs, first, row), -1)
    return F.when(width == 0, F.size(costs).cast("double")).otherwise(distance)


def sed_score(distance: Column, left: Column, right: Column) -> Column:
    longest = F.greatest(left, right)
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / F.when(longest == 0, F.lit(1)).otherwise(longest))


def normalised(raw: Column, baseline: Column) -> Column:
    """Share of the way from the random baseline to 1; null without a usable baseline."""
    usable = baseline.isNotNull() & (baseline < 1)
    return F.when(usable, F.round(F.greatest(F.lit(0.0), F.try_divide(raw - baseline, 1 - baseline)), 4))
