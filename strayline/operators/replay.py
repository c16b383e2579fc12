"""The four detectors as sequential engines, one row at a time.

They hold their state in plain Python and numpy, so that one engine is the state of one
entity in a stream, of one tree in a replay, or of one handle in a driver. Draws come
from a counter and a seed: an engine restored from its state goes on as if never stopped.
The window forms in the other modules give the same scores for whole tables at once.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np

from ..errors import NotReadyError, OutOfBoundsError
from ..functions import hashing, scoring
from ..params import ForestParams, IsolationParams, MixedParams, SketchParams

_MASK = (1 << 64) - 1


class Draws:
    """Uniform numbers in [0, 1) by number, from a 64-bit mix of a seed and a counter."""

    def __init__(self, seed: int, stream: int, count: int = 0) -> None:
        self.base = self._mix((seed & _MASK) * 0x9E3779B97F4A7C15 + stream * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7)
        self.count = count

    @staticmethod
    def _mix(x: int) -> int:
        x &= _MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        return x ^ (x >> 31)

    def next(self) -> float:
        self.count += 1
        return (self._mix(self.base + self.count * 0x9E3779B97F4A7C15) >> 11) * 2.0**-53

    def many(self, n: int) -> np.ndarray:
        """The next n of them."""
        k = np.arange(self.count + 1, self.count + n + 1, dtype=np.uint64)
        self.count += n
        with np.errstate(over="ignore"):
            x = np.uint64(self.base) + k * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def as_point(values: Iterable[float], dim: int, finite: bool = False) -> np.ndarray:
    point = np.asarray(list(values) if not isinstance(values, np.ndarray) else values, np.float64)
    if point.shape != (dim,):
        raise ValueError(f"a point has {dim} numbers, not {point.size}")
    if finite and not np.isfinite(point).all():
        raise ValueError("a point's numbers must be finite")
    return point


# --- Random cut forest -------------------------------------------------------


class Node:
    """A leaf (point and mass), or a cut with two children and the box of all below."""

    __slots__ = ("point", "mass", "dim", "cut", "left", "right", "low", "high")

    def __init__(self, point: np.ndarray | None, mass: int) -> None:
        self.point, self.mass = point, mass
        self.dim, self.cut, self.left, self.right = -1, 0.0, None, None
        self.low = self.high = point

    def is_leaf(self) -> bool:
        return self.left is None

    def refresh(self) -> None:
        self.mass = self.left.mass + self.right.mass
        self.low, self.high = np.minimum(self.left.low, self.right.low), np.maximum(self.left.high, self.right.high)

    def side(self, point: np.ndarray) -> Node:
        return self.left if point[self.dim] <= self.cut else self.right

    def probability(self, point: np.ndarray) -> float:
        excess = float((np.maximum(0, self.low - point) + np.maximum(0, point - self.high)).sum())
        if excess <= 0:
            return 0.0
        width = float((self.high - self.low).sum())
        return 1.0 if width <= 0 else excess / (width + excess)


class CutTree:
    """A random cut tree that rows enter and leave."""

    def __init__(self, draws: Draws) -> None:
        self.draws, self.root = draws, None

    @property
    def mass(self) -> int:
        return self.root.mass if self.root else 0

    def insert(self, point: np.ndarray) -> None:
        """A row goes down to a leaf. From there up, each box draws a cut of itself and the row; the first that parts them takes the row in."""
        if self.root is None:
            self.root = Node(point, 1)
            return
        path, leaf = [], self.root
        while not leaf.is_leaf():
            path.append(leaf)
            leaf = leaf.side(point)
        if np.array_equal(leaf.point, point):
            leaf.mass += 1
            self._refresh(path)
            return
        box, found = leaf, None
        for up in range(len(path) + 1):
            found = self._cut(box.low, box.high, point)
            if found:
                break
            if up < len(path):
                box = path[len(path) - 1 - up]
        else:
            up = 0
            dim = int(np.flatnonzero(leaf.point != point)[0])
            found, box = (dim, float(min(leaf.point[dim], point[dim]))), leaf
        node = Node(None, 0)
        node.dim, node.cut = found
        new = Node(point, 1)
        node.left, node.right = (new, box) if point[node.dim] <= node.cut else (box, new)
        node.refresh()
        above = path[: len(path) - up]
        if above:
            parent = above[-1]
            if parent.left is box:
                parent.left = node
            else:
                parent.right = node
        else:
            self.root = node
        self._refresh(above)

    def _cut(self, low: np.ndarray, high: np.ndarray, point: np.ndarray) -> tuple[int, float] | None:
        lo, hi = np.minimum(low, point), np.maximum(high, point)
        ranges = hi - lo
        total = ranges.sum()
        at = self.draws.next() * total
        if total <= 0:
            return None
        ends = np.cumsum(ranges)
        dim = int(np.searchsorted(ends, at, "right"))
        if dim == len(ranges):
            dim = int(np.flatnonzero(ranges > 0)[-1])
        value = min(max(lo[dim] + at - (ends[dim] - ranges[dim]), lo[dim]), max(np.nextafter(hi[dim], -np.inf), lo[dim]))
        parts = point[dim] <= value < low[dim] or high[dim] <= value < point[dim]
        return (dim, float(value)) if parts else None

    def delete(self, point: np.ndarray) -> None:
        """A row that went in leaves the leaf that it leads to."""
        path, leaf = [], self.root
        while not leaf.is_leaf():
            path.append(leaf)
            leaf = leaf.side(point)
        if leaf.mass > 1:
            leaf.mass -= 1
        elif not path:
            self.root = None
        else:
            parent = path.pop()
            sibling = parent.right if parent.left is leaf else parent.left
            if path:
                if path[-1].left is parent:
                    path[-1].left = sibling
                else:
                    path[-1].right = sibling
            else:
                self.root = sibling
        self._refresh(path)

    @staticmethod
    def _refresh(path: list[Node]) -> None:
        for node in reversed(path):
            node.refresh()

    def score(self, point: np.ndarray, displacement: bool = False) -> float:
        if self.root is None:
            return 0.0
        weight, total, depth, node = 1.0, 0.0, 0, self.root
        while not node.is_leaf():
            p = node.probability(point)
            total += weight * p * (node.mass if displacement else 1 / (depth + 1))
            weight *= 1 - p
            node, depth = node.side(point), depth + 1
        if np.array_equal(node.point, point):
            own = 1 - node.mass / (2 * self.mass)
            own *= 1 / (1 + node.mass) if displacement else 1 / (depth + math.log2(1 + node.mass))
        else:
            own = node.mass if displacement else 1 / (depth + 1)
        total += weight * own
        return total / (1 + self.mass) if displacement else total * math.log2(1 + self.mass)

    def attribute(self, point: np.ndarray, out: np.ndarray) -> None:
        """Adds to out (dims x below, above)."""
        weight, depth, node, norm = 1.0, 0, self.root, math.log2(1 + self.mass)
        while node is not None and not node.is_leaf():
            p = node.probability(point)
            out[node.dim, int(point[node.dim] <= node.cut)] += weight * p * norm / (depth + 1)
            weight *= 1 - p
            node, depth = node.side(point), depth + 1

    def density(self, point: np.ndarray) -> float:
        weight, total, node = 1.0, 0.0, self.root
        while node is not None and not node.is_leaf():
            p = node.probability(point)
            total += weight * p * node.mass
            weight *= 1 - p
            node = node.side(point)
        return total + (weight * node.mass if node is not None and np.array_equal(node.point, point) else 0.0)

    def neighbours(self, point: np.ndarray, threshold: float) -> list[tuple[float, np.ndarray, float]]:
        out, going = [], [(self.root, 0)] if self.root else []
        while going:
            node, depth = going.pop()
            if node.is_leaf():
                out.append((math.log2(1 + self.mass) / (depth + 1), node.point, float(np.abs(node.point - point).sum())))
                continue
            p = node.probability(point)
            if p > threshold or depth == 0:
                near = node.side(point)
                if p > 0.5:
                    going.append((node.right if near is node.left else node.left, depth + 1))
                going.append((near, depth + 1))
        return out

    def closest(self, point: np.ndarray, missing: np.ndarray, centrality: float, draws: Draws) -> np.ndarray | None:
        """The leaf nearest over known dimensions; both sides of a cut in a missing one are seen, the left first."""
        best, distance, going = None, math.inf, [self.root] if self.root else []
        while going:
            node = going.pop()
            if not node.is_leaf():
                going += [node.right, node.left] if missing[node.dim] else [node.side(point)]
                continue
            d = float(np.abs(node.point - point)[~missing].sum())
            if best is None or d < distance or (centrality < 1 and draws.next() < 1 - centrality):
                best, distance = node.point, d
        return best

    def nodes(self) -> list[tuple]:
        """(path, depth, dim, cut, low, high, mass, leaf) of all nodes, parents first."""
        out, going = [], [(self.root, "")] if self.root else []
        while going:
            node, path = going.pop()
            out.append((path, len(path), node.dim, node.cut, node.low.tolist(), node.high.tolist(), node.mass, node.is_leaf()))
            if not node.is_leaf():
                going += [(node.right, path + "1"), (node.left, path + "0")]
        return out

    def to_list(self) -> list:
        """Parents before children, as nested lists that JSON takes."""
        flat, going = [], [self.root] if self.root else []
        while going:
            node = going.pop()
            if node.is_leaf():
                flat.append([node.point.tolist(), node.mass])
            else:
                flat.append([node.dim, node.cut])
                going += [node.right, node.left]
        return flat

    @classmethod
    def from_list(cls, flat: list, draws: Draws) -> CutTree:
        tree, rest = cls(draws), iter(flat)

        # Children follow their parent: the left one's whole subtree, then the right one's.
        root, open_ = None, []
        for a, b in rest:
            leaf = isinstance(a, list)
            node = Node(np.array(a, np.float64), b) if leaf else Node(None, 0)
            if not leaf:
                node.dim, node.cut = a, b
            if open_:
                parent = open_[-1]
                if parent.left is None:
                    parent.left = node
                else:
                    parent.right = node
            else:
                root = node
            if not leaf:
                open_.append(node)
            while open_ and open_[-1].right is not None:
                open_.pop().refresh()
        tree.root = root
        return tree


class ForestEngine:
    """Random cut forest: scores rows, then samples them into its trees."""

    def __init__(self, params: ForestParams, trees: Sequence[int] | None = None) -> None:
        self.params = params.seeded()
        self.ids = list(range(self.params.num_trees) if trees is None else trees)
        self.draws = {t: Draws(self.params.seed, 2 * t) for t in self.ids}
        self.trees = {t: CutTree(Draws(self.params.seed, 2 * t + 1)) for t in self.ids}
        # Each tree's sample: a heap of (minus weight, number of the row, point), so that the largest weight leaves first.
        self.samples: dict[int, list[tuple[float, int, np.ndarray]]] = {t: [] for t in self.ids}
        self.buffer = np.zeros((self.params.shingle_size, self.params.input_dim))
        self.entries_seen = 0

    @property
    def _internal(self) -> bool:
        return self.params.internal_shingling and self.params.shingle_size > 1

    @property
    def is_ready(self) -> bool:
        more = self.params.shingle_size - 1 if self._internal else 0
        return self.entries_seen > self.params.ready_after + more

    def query(self, point: Iterable[float]) -> np.ndarray:
        """What is scored: a whole point, or one row over the newest place of the buffer as it stands."""
        if not self._internal:
            return as_point(point, self.params.dim)
        x = np.asarray(list(point) if not isinstance(point, np.ndarray) else point, np.float64)
        if x.shape == (self.params.dim,):
            return x
        return np.concatenate([self.buffer[:-1].ravel(), as_point(x, self.params.input_dim)])

    def update(self, point: Iterable[float]) -> None:
        p = self.params
        x = as_point(point, p.input_dim if self._internal else p.dim)
        if self._internal:
            self.buffer = np.vstack([self.buffer[1:], x])
            x = self.buffer.ravel().copy()
        self.entries_seen += 1
        if self._internal and self.entries_seen < p.shingle_size:
            return
        for t in self.ids:
            draws, sample = self.draws[t], self.samples[t]
            u = min(max(draws.next(), scoring.EPSILON), 1 - scoring.EPSILON)
            weight = math.log(-math.log(u)) - p.decay * (self.entries_seen - 1)
            if len(sample) < p.capacity:
                fill, first = len(sample) / p.capacity, p.initial_accept_fraction
                chance = 1.0 if fill < first else 0.0 if first >= 1 else 1 - (fill - first) / (1 - first)
                if draws.next() >= chance:
                    continue
            else:
                if weight >= -sample[0][0]:
                    continue
                self.trees[t].delete(heapq.heappop(sample)[2])
            heapq.heappush(sample, (-weight, self.entries_seen, x))
            self.trees[t].insert(x)

    def _mean(self, f) -> float:
        return float(sum(f(self.trees[t]) for t in self.ids) / len(self.ids))

    def score(self, point: Iterable[float]) -> float:
        q = self.query(point)
        return self._mean(lambda t: t.score(q))

    def update_and_score(self, point: Iterable[float]) -> float:
        x = list(point)
        found = self.score(x)
        self.update(x)
        return found

    def displacement_score(self, point: Iterable[float]) -> float:
        q = self.query(point)
        return self._mean(lambda t: t.score(q, displacement=True))

    def density(self, point: Iterable[float]) -> float:
        q = self.query(point)
        return self._mean(lambda t: t.density(q))

    def attribution(self, point: Iterable[float]) -> list[dict[str, float]]:
        q, out = self.query(point), np.zeros((self.params.dim, 2))
        for t in self.ids:
            self.trees[t].attribute(q, out)
        return [{"below": float(b), "above": float(a)} for b, a in out / len(self.ids)]

    def near_neighbors(self, point: Iterable[float], top_k: int = 10, percentile: int = 50) -> list[dict[str, Any]]:
        """Leaves that the trees come to, nearest first; a leaf's score is its sum over trees by their number."""
        q = self.query(point)
        found: dict[bytes, list] = {}
        for t in self.ids:
            for score, leaf, distance in self.trees[t].neighbours(q, percentile / 100):
                own = found.setdefault(leaf.tobytes(), [0.0, leaf, distance])
                own[0] += score
                own[2] = min(own[2], distance)
        rows = sorted(found.values(), key=lambda r: (math.isnan(r[2]), r[2], r[1].tolist()))
        return [{"score": s / len(self.ids), "point": leaf.tolist(), "distance": d} for s, leaf, d in rows[:top_k]]

    def _missing(self, missing: Iterable[int]) -> np.ndarray:
        flags = np.zeros(self.params.dim, bool)
        for i in missing:
            if not 0 <= i < self.params.dim:
                raise OutOfBoundsError(f"{i} is no dimension of {self.params.dim}")
            flags[i] = True
        return flags

    def _filled(self, query: np.ndarray, flags: np.ndarray, centrality: float, round_: int) -> np.ndarray:
        leaves = []
        for t in self.ids:
            leaf = self.trees[t].closest(query, flags, centrality, Draws(self.params.seed, 1_000_003 + 7919 * t + round_, self.entries_seen))
            if leaf is not None:
                leaves.append(leaf[flags])
        if not leaves:
            raise NotReadyError("no tree has a row yet")
        out = query.copy()
        out[flags] = np.median(np.array(leaves), axis=0)
        return out

    def impute(self, point: Iterable[float], missing: Iterable[int], centrality: float = 1.0) -> list[float]:
        missing = list(missing)
        if not missing:
            raise ValueError("no dimension is missing")
        return self._filled(as_point(point, self.params.dim), self._missing(missing), centrality, 0).tolist()

    def extrapolate(self, look_ahead: int) -> list[float]:
        """Fills the newest place of the buffer from the others, then the one before it, and so on; the buffer isn't moved."""
        p = self.params
        if not p.internal_shingling:
            raise ValueError("extrapolation needs internal shingling")
        if p.shingle_size <= 1:
            raise ValueError("extrapolation needs a shingle_size above 1")
        if look_ahead < 0 or look_ahead > p.shingle_size:
            raise ValueError("look_ahead must be from 0 to shingle_size")
        now, out = self.buffer.ravel().copy(), []
        for step in range(look_ahead):
            a = p.dim - (step + 1) * p.input_dim
            flags = np.zeros(p.dim, bool)
            flags[a : a + p.input_dim] = True
            now = self._filled(now, flags, 1.0, step)
            out += now[a : a + p.input_dim].tolist()
        return out

    def state(self) -> dict[str, Any]:
        return {
            "params": self.params.to_dict(),
            "ids": self.ids,
            "entries_seen": self.entries_seen,
            "buffer": self.buffer.tolist(),
            "trees": [
                {"draws": self.draws[t].count, "cuts": self.trees[t].draws.count, "nodes": self.trees[t].to_list(), "sample": [[w, n, x.tolist()] for w, n, x in self.samples[t]]}
                for t in self.ids
            ],
        }

    @classmethod
    def restored(cls, state: Mapping[str, Any]) -> ForestEngine:
        out = cls(ForestParams.from_dict(state["params"]), state["ids"])
        out.entries_seen, out.buffer = state["entries_seen"], np.array(state["buffer"], np.float64)
        for t, own in zip(out.ids, state["trees"]):
            out.draws[t].count = own["draws"]
            out.trees[t] = CutTree.from_list(own["nodes"], Draws(out.params.seed, 2 * t + 1, own["cuts"]))
            out.samples[t] = [(w, n, np.array(x, np.float64)) for w, n, x in own["sample"]]
        return out


# --- Online isolation forest -------------------------------------------------


class Region:
    """A node: about how many rows of the window are in it, their box, and its split."""

    __slots__ = ("height", "low", "high", "dim", "value", "left", "right")

    def __init__(self, height: int, low: np.ndarray, high: np.ndarray) -> None:
        self.height, self.low, self.high = height, low.copy(), high.copy()
        self.dim, self.value, self.left, self.right = -1, 0.0, None, None

    def side(self, point: np.ndarray) -> Region:
        return self.left if point[self.dim] < self.value else self.right

    def to_list(self) -> list:
        own = [self.height, self.low.tolist(), self.high.tolist()]
        return own if self.left is None else [*own, self.dim, self.value, self.left.to_list(), self.right.to_list()]

    @classmethod
    def from_list(cls, data: list) -> Region:
        out = cls(data[0], np.array(data[1]), np.array(data[2]))
        if len(data) > 3:
            out.dim, out.value, out.left, out.right = data[3], data[4], cls.from_list(data[5]), cls.from_list(data[6])
        return out


class IsolationTree:
    def __init__(self, params: IsolationParams, draws: Draws) -> None:
        self.params, self.draws, self.root = params, draws, None

    def learn(self, point: np.ndarray) -> None:
        leaf, limit = self.params.max_leaf_samples, self.params.normaliser
        if self.root is None:
            self.root = Region(1, point, point)
            return
        node, depth = self.root, 0
        while True:
            node.height += 1
            np.minimum(node.low, point, out=node.low)
            np.maximum(node.high, point, out=node.high)
            if node.left is None:
                break
            node, depth = node.side(point), depth + 1
        if node.height >= leaf << depth and depth < limit:
            self._split(node)

    def _split(self, node: Region) -> None:
        """Children start from as many made-up rows as the leaf had, uniform in its box."""
        wide = np.flatnonzero(node.low < node.high)
        if not len(wide):
            return
        dim = int(wide[min(len(wide) - 1, int(self.draws.next() * len(wide)))])
        span = node.high - node.low
        value = float(node.low[dim] + self.draws.next() * span[dim])
        rows = node.low + self.draws.many(node.height * len(span)).reshape(node.height, -1) * span
        left = rows[:, dim] < value
        node.dim, node.value = dim, value
        sides = []
        for own, corner in ((rows[left], node.high), (rows[~left], node.low)):
            if len(own):
                sides.append(Region(len(own), own.min(axis=0), own.max(axis=0)))
            else:
                half = Region(0, node.low, node.high)
                (half.high if corner is node.high else half.low)[dim] = value
                sides.append(half)
        node.left, node.right = sides

    def forget(self, point: np.ndarray) -> None:
        node, depth = self.root, 0
        while node is not None:
            node.height = max(0, node.height - 1)
            if node.left is None:
                break
            if node.height < self.params.max_leaf_samples << depth:
                node.low = np.minimum(node.left.low, node.right.low)
                node.high = np.maximum(node.left.high, node.right.high)
                node.left = node.right = None
                break
            node, depth = node.side(point), depth + 1
        if self.root is not None and self.root.height == 0:
            self.root = None

    def depth(self, point: np.ndarray) -> float:
        node, depth = self.root, 0
        if node is None:
            return 0.0
        while node.left is not None:
            node, depth = node.side(point), depth + 1
        leaf = self.params.max_leaf_samples
        return depth + (0.0 if node.height < leaf else math.log2(node.height / leaf))


class IsolationEngine:
    """Online isolation forest: takes a row in, forgets the oldest, then scores."""

    def __init__(self, params: IsolationParams, trees: Sequence[int] | None = None) -> None:
        self.params = params.seeded()
        self.ids = list(range(self.params.num_trees) if trees is None else trees)
        self.trees = {t: IsolationTree(self.params, Draws(self.params.seed, t)) for t in self.ids}
        self.window: deque[np.ndarray] = deque()
        self.entries_seen = 0

    @property
    def is_ready(self) -> bool:
        return self.entries_seen > 0

    def update(self, point: Iterable[float]) -> None:
        x = as_point(point, self.params.input_dim, finite=True)
        self.window.append(x)
        for tree in self.trees.values():
            tree.learn(x)
        if len(self.window) > self.params.window_size:
            old = self.window.popleft()
            for tree in self.trees.values():
                tree.forget(old)
        self.entries_seen += 1

    def mean_depth(self, point: Iterable[float]) -> float:
        x = as_point(point, self.params.input_dim, finite=True)
        return sum(t.depth(x) for t in self.trees.values()) / len(self.ids)

    def score(self, point: Iterable[float]) -> float:
        return float(2 ** (-self.mean_depth(point) / self.params.normaliser))

    def update_and_score(self, point: Iterable[float]) -> float:
        x = list(point)
        self.update(x)
        return self.score(x)

    def state(self) -> dict[str, Any]:
        return {
            "params": self.params.to_dict(), "ids": self.ids, "entries_seen": self.entries_seen, "window": [x.tolist() for x in self.window],
            "trees": [[t.draws.count, t.root.to_list() if t.root else None] for t in self.trees.values()],
        }

    @classmethod
    def restored(cls, state: Mapping[str, Any]) -> IsolationEngine:
        out = cls(IsolationParams.from_dict(state["params"]), state["ids"])
        out.entries_seen, out.window = state["entries_seen"], deque(np.array(x, np.float64) for x in state["window"])
        for t, (count, root) in zip(out.ids, state["trees"]):
            out.trees[t].draws.count, out.trees[t].root = count, Region.from_list(root) if root else None
        return out


# --- Mixed stream ------------------------------------------------------------


@dataclass
class MixedScore:
    total: float
    record: float
    numeric_features: list[float]
    categorical_features: list[float]

    def to_dict(self) -> dict[str, Any]:
        return dict(vars(self))


class MixedEngine:
    """Mixed stream: counts a record and scores it by its own counts. Nothing changes when a record is invalid."""

    def __init__(self, params: MixedParams) -> None:
        self.params = params.seeded()
        # (feature, hash row, bucket) -> [total, current, tick of current]
        self.cells: dict[tuple[str, int, int], list[float]] = {}
        self.low, self.high = [math.inf] * params.numeric_dim, [-math.inf] * params.numeric_dim
        self.first = self.last = None
        self.entries_seen = 0
        p = self.params
        self._planes = [np.array([[hashing.gaussian_of(p.seed, "plane", r, k, d) for d in range(p.numeric_dim)] for k in range(p.planes)]).reshape(p.planes, -1) for r in range(p.num_rows)]

    @property
    def is_ready(self) -> bool:
        return self.entries_seen > 0

    @property
    def current_time(self) -> int:
        """The logical tick; 1 before the first record."""
        return 1 if self.first is None else self.last - self.first + 1

    def _check(self, numeric: Sequence[float], categorical: Sequence[int], tick: int) -> None:
        if len(numeric) != self.params.numeric_dim or len(categorical) != self.params.categorical_dim:
            raise ValueError(f"a record has {self.params.numeric_dim} numbers and {self.params.categorical_dim} categories")
        if not all(map(math.isfinite, numeric)):
            raise ValueError("a record's numbers must be finite")
        if tick <= 0 or (self.last is not None and tick < self.last):
            raise ValueError("ticks must be above 0 and must not fall")

    def _cells(self, numeric: Sequence[float], categorical: Sequence[int], low: list[float], high: list[float]) -> dict[str, list[tuple[str, int, int]]]:
        p, out = self.params, {}
        for i, x in enumerate(numeric):
            a, span = math.asinh(x), high[i] - low[i]
            norm = 0.0 if span <= scoring.EPSILON else (a - low[i]) / span
            out[f"n{i}"] = [(f"n{i}", 0, min(max(math.floor(norm * p.num_buckets), 0), p.num_buckets - 1))]
        out["r"] = []
        for r in range(p.num_rows):
            signs = 0
            if p.numeric_dim:
                for k, plane in enumerate(self._planes[r]):
                    total = 0.0
                    for x, w in zip(numeric, plane):
                        total += x * float(w)
                    signs += int(total > 0) << k
            own = sum(hashing.bucket_of(p.num_buckets, p.seed, "rec", j, r, c) for j, c in enumerate(categorical))
            out["r"].append(("r", r, (signs + own) % p.num_buckets))
        for j, c in enumerate(categorical):
            out[f"c{j}"] = [(f"c{j}", r, hashing.bucket_of(p.num_buckets, p.seed, "cat", j, r, c)) for r in range(p.num_rows)]
        return out

    def _score(self, numeric: Sequence[float], categorical: Sequence[int], tick: int, commit: bool) -> MixedScore:
        self._check(numeric, categorical, tick)
        first = tick if self.first is None else self.first
        low = [min(a, math.asinh(x)) for a, x in zip(self.low, numeric)]
        high = [max(a, math.asinh(x)) for a, x in zip(self.high, numeric)]
        now, scores = tick - first + 1, {}
        for feature, cells in self._cells(numeric, categorical, low, high).items():
            totals, currents = [], []
            for cell in cells:
                total, current, at = self.cells.get(cell, (0, 0.0, tick))
                total, current = total + 1, current * self.params.alpha ** (tick - at) + 1
                totals.append(total)
                currents.append(current)
                if commit:
                    self.cells[cell] = [total, current, tick]
            scores[feature] = scoring.chi_square_of(min(currents), min(totals), now)
        if commit:
            self.first, self.last, self.low, self.high = first, tick, low, high
            self.entries_seen += 1
        p = self.params
        return MixedScore(sum(scores.values()), scores["r"], [scores[f"n{i}"] for i in range(p.numeric_dim)], [scores[f"c{j}"] for j in range(p.categorical_dim)])

    def update_and_score_detailed(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> MixedScore:
        return self._score(numeric, categorical, timestamp, True)

    def update_and_score(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> float:
        return self._score(numeric, categorical, timestamp, True).total

    def update(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> None:
        self._score(numeric, categorical, timestamp, True)

    def score_detailed(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> MixedScore:
        return self._score(numeric, categorical, timestamp, False)

    def score(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> float:
        return self._score(numeric, categorical, timestamp, False).total

    def state(self) -> dict[str, Any]:
        return {
            "params": self.params.to_dict(), "entries_seen": self.entries_seen, "first": self.first, "last": self.last,
            "low": [x if math.isfinite(x) else None for x in self.low], "high": [x if math.isfinite(x) else None for x in self.high],
            "cells": [[*k, *v] for k, v in self.cells.items()],
        }

    @classmethod
    def restored(cls, state: Mapping[str, Any]) -> MixedEngine:
        out = cls(MixedParams.from_dict(state["params"]))
        out.entries_seen, out.first, out.last = state["entries_seen"], state["first"], state["last"]
        out.low = [math.inf if x is None else x for x in state["low"]]
        out.high = [-math.inf if x is None else x for x in state["high"]]
        out.cells = {(f, r, b): [t, c, at] for f, r, b, t, c, at in state["cells"]}
        return out


# --- Sparse sketch -----------------------------------------------------------


class SketchEngine:
    """Sparse feature sketch: scores an event at the epoch of the one before it, then counts it."""

    FORMAT = 1

    def __init__(self, params: SketchParams) -> None:
        from .sparse_sketch import layout

        self.params = params.seeded()
        self.levels = layout(self.params)
        # (level, hash row, bucket) -> [count, epoch]
        self.cells: dict[tuple[int, int, int], list[float]] = {}
        self.entries_seen = 0
        self._coefficients: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def is_ready(self) -> bool:
        return self.entries_seen > 0

    def _project(self, features: Mapping[str, float] | Iterable[tuple[str, float]]) -> dict[str, np.ndarray]:
        p, sums = self.params, {}
        for name, value in features.items() if isinstance(features, Mapping) else features:
            if not math.isfinite(value):
                raise ValueError("a feature's value must be finite")
            sums[name] = sums.get(name, 0.0) + float(value)
        value, presence = np.zeros(p.value_projection_dims), np.zeros(p.presence_projection_dims + 1)
        for name in sorted(sums):
            if name not in self._coefficients:
                if len(self._coefficients) > 100_000:
                    self._coefficients.clear()
                root = {0: math.sqrt(3), 1: -math.sqrt(3)}
                self._coefficients[name] = tuple(
                    np.array([root.get(hashing.bucket_of(6, p.seed, channel, d, name), 0.0) for d in range(dims)])
                    for channel, dims in (("value", p.value_projection_dims), ("presence", p.presence_projection_dims))
                )
            v, w = self._coefficients[name]
            value += math.asinh(sums[name]) * v
            presence[:-1] += w
        presence[-1] = math.log1p(len(sums))
        return {"value": value, "presence": presence}

    def _at(self, vectors: dict[str, np.ndarray]) -> list[list[tuple[int, int, int]]]:
        p, out = self.params, []
        for i, x in enumerate(self.levels):
            b = math.floor(round((vectors[x.ensemble][x.dim] + x.offset) / x.width, 9))
            out.append([(i, r, hashing.bucket_of(p.sketch_buckets, p.seed, "cell", x.ensemble, x.chain, x.level, r, b)) for r in range(p.sketch_rows)])
        return out

    def _score(self, cells: list[list[tuple[int, int, int]]]) -> float:
        p, n = self.params, self.entries_seen
        half = p.decay_half_life
        r = 0.5 ** (1 / half)
        mass = (1 - r**n) / (1 - r)
        chains: dict[tuple[str, int], float] = {}
        for x, own in zip(self.levels, cells):
            count = math.inf
            for cell in own:
                held, at = self.cells.get(cell, (0.0, n))
                count = min(count, held * 0.5 ** ((n - at) / half))
            k = (x.ensemble, x.chain)
            chains[k] = max(chains.get(k, 0.0), scoring.surprise_of(count, mass, x.ratio))
        return sum(chains.values()) / len(chains)

    def _count(self, cells: list[list[tuple[int, int, int]]]) -> None:
        self.entries_seen += 1
        n, half = self.entries_seen, self.params.decay_half_life
        for cell in (c for own in cells for c in own):
            held, at = self.cells.get(cell, (0.0, n))
            self.cells[cell] = [held * 0.5 ** ((n - at) / half) + 1, n]

    def score(self, features: Mapping[str, float] | Iterable[tuple[str, float]]) -> float:
        return self._score(self._at(self._project(features)))

    def update(self, features: Mapping[str, float] | Iterable[tuple[str, float]]) -> None:
        self._count(self._at(self._project(features)))

    def update_and_score(self, features: Mapping[str, float] | Iterable[tuple[str, float]]) -> float:
        cells = self._at(self._project(features))
        found = self._score(cells)
        self._count(cells)
        return found

    def state(self) -> dict[str, Any]:
        return {"format_version": self.FORMAT, "params": self.params.to_dict(), "entries_seen": self.entries_seen, "cells": [[*k, *v] for k, v in self.cells.items()]}

    @classmethod
    def restored(cls, state: Mapping[str, Any]) -> SketchEngine:
        if state.get("format_version") != cls.FORMAT:
            raise ValueError(f"format version {state.get('format_version')!r} isn't {cls.FORMAT}")
        out = cls(SketchParams.from_dict(state["params"]))
        out.entries_seen = state["entries_seen"]
        out.cells = {(i, r, b): [c, at] for i, r, b, c, at in state["cells"]}
        return out


ENGINES = {"forest": ForestEngine, "isolation": IsolationEngine, "mixed": MixedEngine, "sketch": SketchEngine}
