import copy
import math
import pickle
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strayline.detectors import FeatureSketch, Forest, MStream, OnlineIForest
from strayline.errors import NotReadyError, OutOfBoundsError
from strayline.operators.cut_forest import Tree
from strayline.operators.replay import CutTree, Draws, ForestEngine, SketchEngine
from strayline.params import ForestParams, SketchParams


def cluster(n=250, seed=5):
    r = random.Random(seed)
    return [[0.5 + r.uniform(-0.15, 0.15), 0.5 + r.uniform(-0.15, 0.15)] for _ in range(n)]


def diagonal():
    forest = Forest(2, num_trees=10, capacity=50, output_after=10, seed=4)
    for i in range(80):
        forest.update([(i % 5) * 0.1] * 2)
    return forest


def models():
    yield diagonal(), lambda m: m.update_and_score([0.3, 0.1])
    iso = OnlineIForest(2, num_trees=8, window_size=64, max_leaf_samples=8, seed=3)
    for x in cluster(100):
        iso.update(x)
    yield iso, lambda m: m.update_and_score([0.3, 0.1])
    mixed = MStream(2, 1, num_buckets=64, seed=2)
    for i in range(40):
        mixed.update([i * 0.1, 1.0], [i % 3], 1 + i // 8)
    yield mixed, lambda m: m.update_and_score([9.0, 2.0], [7], 9)
    sketch = FeatureSketch(value_projection_dims=4, presence_projection_dims=4, chains_per_ensemble=3, chain_depth=3, sketch_buckets=64, decay_half_life=32, seed=1)
    for i in range(40):
        sketch.update({"a": i % 4, "b": 1.0})
    yield sketch, lambda m: m.update_and_score({"c": 3.0})


@pytest.mark.parametrize("model,step", list(models()), ids=lambda m: type(m).__name__)
def test_copies_go_on_alike(model, step, tmp_path):
    model.save_json(tmp_path / "m.json")
    others = [type(model).load_json(tmp_path / "m.json"), pickle.loads(pickle.dumps(model)), copy.deepcopy(model), model.copy(), type(model).from_json(model.to_json().encode())]
    expected = [step(model) for _ in range(5)]
    for other in others:
        assert [step(other) for _ in range(5)] == pytest.approx(expected)
    assert "seed" in repr(model)


@pytest.mark.parametrize("model,step", list(models()), ids=lambda m: type(m).__name__)
def test_scoring_changes_nothing(model, step):
    before = model.to_json()
    {"Forest": lambda: model.score([0.3, 0.1]), "OnlineIForest": lambda: model.score([0.3, 0.1]), "MStream": lambda: model.score([9.0, 2.0], [7], 9), "FeatureSketch": lambda: model.score({"c": 3.0})}[type(model).__name__]()
    assert model.to_json() == before


def test_preview_is_what_a_commit_gives():
    _, _, (mixed, _), (sketch, _) = models()
    preview = mixed.score_detailed([9.0, 2.0], [7], 9)
    assert mixed.update_and_score_detailed([9.0, 2.0], [7], 9) == preview
    assert preview["total"] == pytest.approx(preview["record"] + sum(preview["numeric_features"]) + sum(preview["categorical_features"]))
    preview = sketch.score({"c": 3.0})
    assert sketch.update_and_score({"c": 3.0}) == preview


def test_far_points_score_more():
    forest = diagonal()
    assert forest.is_ready
    for far in (5.0, 25.0, -9.0):
        assert forest.score([far, far]) > forest.score([0.2, 0.2])
        assert forest.displacement_score([far, far]) > forest.displacement_score([0.2, 0.2])
    assert forest.density([50.0, 50.0]) > forest.density([0.2, 0.2]) >= 0


def test_attribution_names_the_dimension_and_side():
    forest = diagonal()
    found = forest.attribution([9.0, 0.2])
    total = [a["below"] + a["above"] for a in found]
    assert total[0] > total[1]
    assert found[0]["below"] > found[0]["above"]
    assert 0.05 <= sum(total) / forest.score([9.0, 0.2]) <= 1.01


def test_shingles_score_an_anomaly():
    forest = Forest(2, shingle_size=4, num_trees=50, capacity=128, output_after=50, seed=1)
    for x in cluster():
        forest.update(x)
    for bad in ([10.0, 10.0], [-8.0, -8.0], [0.5, 15.0]):
        assert forest.score(bad) > 1.5 * forest.score([0.5, 0.5])


def test_scored_vector_skips_the_row_before():
    engine = ForestEngine(ForestParams(1, shingle_size=3, seed=1))
    engine.update([1])
    engine.update([2])
    assert engine.query([9]).tolist() == [0, 1, 9]


def test_neighbours_are_sorted_and_real():
    grid = [[0.5 + a * 0.02 - 0.09, 0.5 + b * 0.02 - 0.09] for a in range(10) for b in range(10)]
    forest = Forest(2, num_trees=20, capacity=128, seed=3, initial_accept_fraction=1.0)
    for x in grid:
        forest.update(x)
    found = forest.near_neighbors([0.8, 0.8], 5, 0)
    distances = [n["distance"] for n in found]
    assert found and distances == sorted(distances)
    for n in found:
        assert n["distance"] == pytest.approx(sum(abs(a - b) for a, b in zip(n["point"], [0.8, 0.8])))
        assert n["point"] in grid


def test_impute_stays_in_the_range_seen():
    forest = Forest(3, num_trees=10, capacity=128, seed=8)
    rows = [[x, 2 * x + 1, -x + 0.5] for x in (0.25 * i - 4 for i in range(64))]
    for x in rows:
        forest.update(x)
    out = forest.impute([1.0, 0.0, -0.5], [1])
    assert out[0] == 1.0 and out[2] == -0.5
    assert min(r[1] for r in rows) <= out[1] <= max(r[1] for r in rows)
    assert len(forest.impute([1.0, math.nan, -0.5], [1], centrality=0.5)) == 3
    with pytest.raises(OutOfBoundsError):
        forest.impute([1, 2, 3], [3])
    with pytest.raises(ValueError):
        forest.impute([1, 2, 3], [])


def test_extrapolation_and_its_errors():
    forest = Forest(1, shingle_size=4, num_trees=10, capacity=64, seed=2)
    with pytest.raises(NotReadyError):
        forest.extrapolate(1)
    for i in range(200):
        forest.update([math.sin(0.1 * i)])
    assert len(forest.extrapolate(4)) == 4
    assert forest.extrapolate(0) == []
    assert all(abs(v) <= 1 for v in forest.extrapolate(2))
    for bad in (lambda: forest.extrapolate(5), lambda: Forest(1, seed=1).extrapolate(1), lambda: Forest(1, shingle_size=2, internal_shingling=False).extrapolate(1)):
        with pytest.raises(ValueError):
            bad()


def test_invalid_rows_raise_and_change_nothing():
    mixed = MStream(1, 1, seed=1)
    mixed.update([1.0], [1], 5)
    before = mixed.to_json()
    for bad in (([math.nan], [1], 6), ([1.0], [1], 4), ([1.0], [1], 0), ([1.0, 2.0], [1], 6), ([1.0], [], 6)):
        with pytest.raises(ValueError):
            mixed.update(*bad)
    assert mixed.to_json() == before
    with pytest.raises(ValueError):
        OnlineIForest(2).update([1.0, math.inf])
    with pytest.raises(ValueError):
        FeatureSketch().update({"a": math.nan})
    with pytest.raises(ValueError):
        FeatureSketch.from_json('{"format_version": 9}')
    with pytest.raises(ValueError):
        Forest.from_json("{}")


def test_tick_offsets_don_t_matter():
    a, b = MStream(1, 1, seed=3), MStream(1, 1, seed=3)
    for i in range(30):
        row = ([float(i % 7)], [i % 4])
        assert a.update_and_score(*row, 1 + i // 5) == pytest.approx(b.update_and_score(*row, 1000 + i // 5))
    assert a.current_time == b.current_time == 6


def test_duplicate_names_are_summed():
    a = FeatureSketch(seed=5, chain_depth=3, chains_per_ensemble=4)
    a.update([("x", 1.0), ("y", 2.0)])
    assert a.score([("x", 1.0), ("y", 2.0)]) == pytest.approx(a.score([("y", 2.0), ("x", 0.25), ("x", 0.75)]))


def test_half_life():
    engine = SketchEngine(SketchParams(decay_half_life=2, seed=1, chain_depth=1, chains_per_ensemble=1))
    cells = [[(0, 0, 0)]]
    engine.cells[0, 0, 0] = [8.0, 0]
    engine.entries_seen = 1
    engine._count(cells)
    assert engine.cells[0, 0, 0] == [5.0, 2]


def test_empty_isolation_forest_scores_one():
    assert OnlineIForest(2, seed=1).score([0, 0]) == 1.0


def test_root_height_is_the_window():
    iso = OnlineIForest(2, num_trees=3, window_size=50, max_leaf_samples=4, seed=1)
    for x in cluster(130):
        iso.update(x)
    assert {t.root.height for t in iso.engine.trees.values()} == {50}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=40), st.integers(0, 1000))
def test_trees_keep_mass_and_boxes(points, seed):
    tree, inside = CutTree(Draws(seed, 1)), []
    for i, p in enumerate(points):
        x = np.array(p, float)
        tree.insert(x)
        inside.append(x)
        if i % 3 == 2:
            tree.delete(inside.pop(0))
    nodes = tree.nodes()
    assert tree.mass == len(inside)
    assert sum(n[6] for n in nodes if n[7]) == len(inside)
    if inside:
        assert nodes[0][4] == np.min(inside, axis=0).tolist() and nodes[0][5] == np.max(inside, axis=0).tolist()
    again = CutTree.from_list(tree.to_list(), Draws(seed, 1))
    assert again.nodes() == nodes


def test_vectorised_trees_answer_as_sequential_ones():
    import pandas as pd

    tree, r = CutTree(Draws(3, 1)), np.random.default_rng(1)
    for x in r.normal(size=(60, 3)).round(1):
        tree.insert(x)
    rows = pd.DataFrame(tree.nodes(), columns=["path", "depth", "cut_dim", "cut_val", "low", "high", "mass", "is_leaf"])
    fast = Tree.of(rows)
    asked = np.vstack([r.normal(size=(40, 3)) * 2, [n[4] for n in tree.nodes() if n[7]][:10]])
    assert np.allclose(fast.score(asked), [tree.score(x) for x in asked])
    assert np.allclose(fast.score(asked, True), [tree.score(x, True) for x in asked])
    assert np.allclose(fast.density(asked), [tree.density(x) for x in asked])
    out = np.zeros((len(asked), 3, 2))
    fast.attribute(asked, out)
    for x, own in zip(asked, out):
        one = np.zeros((3, 2))
        tree.attribute(x, one)
        assert np.allclose(own, one)
    row, leaf = fast.neighbours(asked, 0.2)
    for i, x in enumerate(asked):
        mine = sorted(tuple(p) for _, p, _ in tree.neighbours(x, 0.2))
        assert sorted(tuple(fast.low[n]) for n in leaf[row == i]) == mine
    holes = asked.copy()
    holes[np.arange(len(asked)), np.arange(len(asked)) % 3] = np.nan
    for i, x in enumerate(holes):
        gone = np.isnan(x)
        assert fast.low[fast.closest(x[None])[0]].tolist() == tree.closest(np.nan_to_num(x), gone, 1.0, Draws(0, 0)).tolist()


# Simulations: what an attack looks like to each detector.


@pytest.mark.parametrize("seed", range(4))
def test_login_attacks(seed):
    mixed = MStream(2, 2, num_buckets=512, seed=seed)
    normal = 0.0
    for tick in range(1, 13):
        for i in range(8):
            s = mixed.update_and_score([i % 2, 3.0 + (i % 6) * 0.1], [1 + i % 2, 10], tick)
            normal = max(normal, s)
    attack = [mixed.update_and_score_detailed([12.0, 0.3], [99, 10], 13) for _ in range(8)]
    assert max(a["total"] for a in attack) > normal
    assert attack[-1]["categorical_features"][0] > 0 and attack[-1]["numeric_features"][0] > 0


@pytest.mark.parametrize("seed", range(3))
def test_probes_surprise_the_sketch_until_they_repeat(seed):
    sketch = FeatureSketch(value_projection_dims=16, presence_projection_dims=16, chains_per_ensemble=12, chain_depth=6, sketch_buckets=512, decay_half_life=512, seed=seed)
    normal = []
    for i in range(300):
        event = {f"endpoint:{i % 3}": 1, f"method:{i % 2}": 1, "status:200": 1, "service": 1, "latency": 38 + i % 24, "bytes": 1.8 + (i % 24) / 10}
        normal.append(sketch.update_and_score(event))
    probe = {"endpoint:admin": 1, "method:DELETE": 1, "status:403": 1, "service": 1, "latency": 900, "bytes": 90, "failed": 9}
    first = sketch.score(probe)
    assert first > sorted(normal[100:])[int(0.95 * 200)]
    for _ in range(200):
        sketch.update(probe)
    assert sketch.score(probe) < first


@pytest.mark.parametrize("seed", range(3))
def test_takeovers_stand_out_of_the_window(seed):
    iso = OnlineIForest(3, num_trees=64, window_size=256, max_leaf_samples=8, seed=seed)
    for i in range(512):
        iso.update([90 + i % 26, 40 + i % 18, (i % 5) / 10000])
    normal = [iso.score([90 + i % 26, 40 + i % 18, 0.0001]) for i in range(20)]
    attack = [iso.score([2000 + 50 * (i % 3), 1000 + 25 * (i % 4), 0.95 + 0.02 * (i % 2)]) for i in range(8)]
    assert np.mean(attack) > np.mean(normal)
