"""Scalar formulas of the detectors, as Columns.

Names ending in ``_of`` are the same formula over Python or numpy numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards against empty masses and ratios.
TINY = 1e-12
EPSILON = float(np.finfo(np.float64).eps)


# Random cut trees: score of a node by its depth and mass.


def seen(depth: Column, mass: Column) -> Column:
    return 1 / (depth + F.log2(1 + mass))


def unseen(depth: Column) -> Column:
    return 1 / (depth + F.lit(1.0))


def normalised(score: Column, tree_mass: Column) -> Column:
    return score * F.log2(1 + tree_mass)


def damp(mass: Column, tree_mass: Column) -> Column:
    return F.when(tree_mass == 0, F.lit(1.0)).otherwise(1 - mass / (2 * tree_mass))


def displacement_seen(mass: Column) -> Column:
    return 1 / (F.lit(1.0) + mass)


def displacement_unseen(mass: Column) -> Column:
    return mass.cast("double")


def displacement_normalised(score: Column, tree_mass: Column) -> Column:
    return score / (F.lit(1.0) + tree_mass)


def cut_probability(low: Column, high: Column, point: Column) -> Column:
    """That a random cut of the box grown by the point parts the two; arrays of equal length."""
    excess = F.aggregate(
        F.arrays_zip(low.alias("l"), high.alias("h"), point.alias("p")),
        F.lit(0.0),
        lambda s, x: s + F.greatest(F.lit(0.0), x["l"] - x["p"]) + F.greatest(F.lit(0.0), x["p"] - x["h"]),
    )
    width = F.aggregate(F.zip_with(low, high, lambda a, b: b - a), F.lit(0.0), lambda s, x: s + x)
    return F.when(excess <= 0, F.lit(0.0)).when(width <= 0, F.lit(1.0)).otherwise(excess / (width + excess))


def blend(probability: Column, child: Column, fallback: Column) -> Column:
    return (1 - probability) * child + probability * fallback


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def l1_where_known(a: Column, b: Column) -> Column:
    """Distance over the dimensions that are not null in a."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def reservoir_weight(u: Column, decay: float, entries_seen: Column) -> Column:
    """Rows with the smallest weights stay; later rows get smaller ones."""
    held = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), u))
    return F.ln(-F.ln(held)) - F.lit(decay) * entries_seen


# Attributions: structs of below and above.


def attribution_total(a: Column) -> Column:
    return a["below"] + a["above"]


def attribution_scaled(a: Column, by: Column) -> Column:
    return F.struct((a["below"] * by).alias("below"), (a["above"] * by).alias("above"))


def attribution_sum(a: Column, b: Column) -> Column:
    return F.struct((a["below"] + b["below"]).alias("below"), (a["above"] + b["above"]).alias("above"))


# Mixed streams: how far a current count is from the mean of the past ticks.


def chi_square(current: Column, total: Column, tick: Column) -> Column:
    mean = total / tick
    off = current - mean
    later = F.greatest(tick - 1, F.lit(1))
    return F.when(mean <= EPSILON, F.lit(0.0)).otherwise(off * off / mean + off * off / (mean * later))


def chi_square_preview(current: Column, total: Column, decay: Column, tick: Column) -> Column:
    """The score that a row would get, from the counts before it."""
    return chi_square(current * decay + 1, total + 1, tick)


def chi_square_of(current: float, total: float, tick: int) -> float:
    mean = total / tick
    off = current - mean
    return 0.0 if mean <= EPSILON else off * off / mean + off * off / (mean * max(tick - 1, 1))


# Sparse sketches.


def surprise(count: Column, mass: Column, ratio: Column) -> Column:
    dense = count / F.greatest(mass, F.lit(TINY)) / F.greatest(ratio, F.lit(TINY))
    return -F.ln(F.least(F.lit(1.0), F.greatest(F.lit(TINY), dense)))


def surprise_of(count: float, mass: float, ratio: float) -> float:
    return float(-np.log(np.clip(count / max(mass, TINY) / max(ratio, TINY), TINY, 1.0)))


# Isolation trees.


def split_threshold(leaf: int, depth: Column) -> Column:
    return F.lit(leaf) * F.pow(F.lit(2.0), depth)


def residual_depth(height: Column, leaf: int) -> Column:
    return F.when(height < leaf, F.lit(0.0)).otherwise(F.log2(height / F.lit(leaf)))


def isolation_score(mean_depth: Column, normaliser: float) -> Column:
    return F.pow(F.lit(2.0), -mean_depth / F.lit(normaliser))
