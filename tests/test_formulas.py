import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayline.functions import hashing, scoring, vectors
from strayline.operators.cut_forest import build_tree
from strayline.operators.sparse_sketch import layout
from strayline.params import ForestParams, IsolationParams, MixedParams, SketchParams


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


lit = lambda *v: F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize("current,total,tick,score", [(5, 10, 2, 0), (0, 10, 2, 10), (10, 10, 2, 10), (0, 0, 1, 0), (1, 1, 1, 0)])
def test_chi_square(spark, current, total, tick, score):
    assert value(spark, scoring.chi_square(F.lit(float(current)), F.lit(float(total)), F.lit(tick))) == pytest.approx(score)
    assert scoring.chi_square_of(current, total, tick) == pytest.approx(score)


def test_preview_is_the_score_of_the_counts_with_the_row(spark):
    a = value(spark, scoring.chi_square_preview(F.lit(2.0), F.lit(3.0), F.lit(0.5), F.lit(4)))
    assert a == pytest.approx(scoring.chi_square_of(2, 4, 4))


@pytest.mark.parametrize("count,mass,ratio,expected", [(25, 100, 0.25, 0.0), (0, 100, 0.25, -math.log(1e-12)), (0, 0, 1, -math.log(1e-12))])
def test_surprise(spark, count, mass, ratio, expected):
    assert value(spark, scoring.surprise(F.lit(float(count)), F.lit(float(mass)), F.lit(ratio))) == pytest.approx(expected)
    assert scoring.surprise_of(count, mass, ratio) == pytest.approx(expected)


@pytest.mark.parametrize("point,expected", [((0.5, 0.5), 0.0), ((5, 0.5), 4 / 6)])
def test_cut_probability(spark, point, expected):
    assert value(spark, scoring.cut_probability(lit(0, 0), lit(1, 1), lit(*point))) == pytest.approx(expected)


def test_cut_probability_of_a_point_box(spark):
    assert value(spark, scoring.cut_probability(lit(1, 1), lit(1, 1), lit(2, 1))) == 1.0


def test_distances(spark):
    a, b = lit(1, -1, 3.5, 0), lit(0, 2, 1.5, -2)
    assert value(spark, scoring.l1(a, b)) == 8
    half = F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.5), F.lit(None).cast("double"))
    assert value(spark, scoring.l1_where_known(half, b)) == 3


@pytest.mark.parametrize("height,depth", [(3, 0), (4, 0), (8, 1), (16, 2)])
def test_residual_depth(spark, height, depth):
    assert value(spark, scoring.residual_depth(F.lit(height), 4)) == depth


def test_column_and_python_draws_agree(spark):
    for parts in [(7, "a", 3), (1, "cut", 0, "0101")]:
        assert value(spark, hashing.uniform(*parts)) == hashing.uniform_of(*parts)
        assert value(spark, hashing.bucket(97, *parts)) == hashing.bucket_of(97, *parts)


def test_missing_places(spark):
    assert value(spark, vectors.missing(F.array(F.lit(1.0), F.lit(None), F.lit(None)))) == [1, 2]


def test_chain_widths_halve():
    for x in layout(SketchParams(seed=1)):
        assert 0 <= x.offset < x.width
        assert x.ratio == 2.0**-x.level
        assert x.width in (4 * x.ratio, 2 * x.ratio)


def test_built_trees_are_full_and_keep_mass():
    points = np.random.default_rng(3).normal(size=(40, 3)).round(1)
    points[5:9] = points[4]
    nodes = build_tree(points, 1, 0)
    leaves = [n for n in nodes if n[8]]
    assert len(nodes) == 2 * len(leaves) - 1
    assert sum(n[7] for n in leaves) == 40
    assert len(leaves) == len(np.unique(points, axis=0))
    for n in nodes:
        if not n[8]:
            assert n[5][n[3]] <= n[4] < n[6][n[3]]


@pytest.mark.parametrize(
    "make",
    [
        lambda: ForestParams(0), lambda: ForestParams(1, shingle_size=0), lambda: ForestParams(1, time_decay=-1), lambda: ForestParams(1, time_decay=math.nan),
        lambda: ForestParams(1, initial_accept_fraction=1.5), lambda: IsolationParams(1, window_size=32, max_leaf_samples=32), lambda: IsolationParams(1, num_trees=0),
        lambda: MixedParams(0, 0), lambda: MixedParams(1, 0, alpha=1.0), lambda: MixedParams(1, 0, num_buckets=1), lambda: SketchParams(sketch_buckets=1),
        lambda: SketchParams(chain_depth=2000), lambda: SketchParams(decay_half_life=0), lambda: ForestParams(1, seed=-1),
    ],
)
def test_bad_parameters_are_value_errors(make):
    with pytest.raises(ValueError):
        make()


def test_defaults():
    p = ForestParams(2)
    assert (p.dim, p.decay, p.ready_after) == (2, 0.1 / 256, 65)
    assert MixedParams(1, 1, num_buckets=1024).planes == 10
    assert ForestParams.from_dict(p.to_dict() | {"unknown": 1}) == p
    assert p.with_(capacity=8).capacity == 8
