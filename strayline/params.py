"""Parameters of the four detectors, checked when made.

Each is a frozen dataclass with the defaults of the model; ``to_dict`` and
``from_dict`` carry it through JSON, and a missing field takes its default.
"""

from __future__ import annotations

import math
import secrets
from dataclasses import asdict, dataclass, fields, replace
from typing import Any, Self


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


#: Fixed value: halving a bin's width more often could make it 0.
MAX_DEPTH = 1024


@dataclass(frozen=True)
class Params:
    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Self:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    def with_(self, **changes: Any) -> Self:
        """A copy with some fields changed, checked again."""
        return replace(self, **changes)

    def seeded(self) -> Self:
        """With a seed drawn at random where none is given."""
        return self if self.seed is not None else replace(self, seed=secrets.randbits(32))  # type: ignore[attr-defined]

    def _counts(self, *names: str) -> None:
        for n in names:
            value = getattr(self, n)
            _check(_whole(value) and value > 0, f"{n} must be a whole number above 0, not {value!r}")

    def _seed(self) -> None:
        seed = self.seed  # type: ignore[attr-defined]
        _check(seed is None or (_whole(seed) and seed >= 0), f"seed must be None or a whole number from 0, not {seed!r}")


@dataclass(frozen=True)
class ForestParams(Params):
    """Random cut forest over points of input_dim * shingle_size numbers."""

    input_dim: int
    shingle_size: int = 1
    num_trees: int = 50
    capacity: int = 256
    time_decay: float = 0.0
    output_after: int = 0
    internal_shingling: bool = True
    initial_accept_fraction: float = 0.125
    seed: int | None = None

    def __post_init__(self) -> None:
        self._counts("input_dim", "shingle_size", "num_trees", "capacity")
        _check(math.isfinite(self.time_decay) and self.time_decay >= 0, f"time_decay must be 0 or more, not {self.time_decay!r}")
        _check(_whole(self.output_after) and self.output_after >= 0, f"output_after must be 0 or more, not {self.output_after!r}")
        _check(0 <= self.initial_accept_fraction <= 1, f"initial_accept_fraction must be from 0 to 1, not {self.initial_accept_fraction!r}")
        self._seed()

    @property
    def dim(self) -> int:
        return self.input_dim * self.shingle_size

    @property
    def decay(self) -> float:
        """0 stands for a tenth of a row's share of the sample."""
        return self.time_decay or 0.1 / self.capacity

    @property
    def ready_after(self) -> int:
        """0 stands for a quarter of the sample and one row more."""
        return self.output_after or 1 + self.capacity // 4


@dataclass(frozen=True)
class IsolationParams(Params):
    """Online isolation forest over a sliding window of rows."""

    input_dim: int
    num_trees: int = 32
    window_size: int = 2048
    max_leaf_samples: int = 32
    seed: int | None = None

    def __post_init__(self) -> None:
        self._counts("input_dim", "num_trees", "window_size", "max_leaf_samples")
        _check(self.window_size > self.max_leaf_samples, "window_size must be above max_leaf_samples")
        self._seed()

    @property
    def normaliser(self) -> float:
        return math.log2(self.window_size / self.max_leaf_samples)


@dataclass(frozen=True)
class MixedParams(Params):
    """Count sketches over records of numbers and categories at logical ticks."""

    numeric_dim: int
    categorical_dim: int
    num_rows: int = 2
    num_buckets: int = 1024
    alpha: float = 0.8
    seed: int | None = None

    def __post_init__(self) -> None:
        for n in ("numeric_dim", "categorical_dim"):
            value = getattr(self, n)
            _check(_whole(value) and value >= 0, f"{n} must be a whole number from 0, not {value!r}")
        _check(self.numeric_dim + self.categorical_dim > 0, "a record needs a number or a category")
        self._counts("num_rows", "num_buckets")
        _check(self.num_buckets >= 2, "num_buckets must be 2 or more")
        _check(0 < self.alpha < 1, f"alpha must be between 0 and 1, not {self.alpha!r}")
        self._seed()

    @property
    def planes(self) -> int:
        """Sign bits of the record hash."""
        return (self.num_buckets - 1).bit_length()


@dataclass(frozen=True)
class SketchParams(Params):
    """Sparse projections of named features into histogram chains."""

    value_projection_dims: int = 32
    presence_projection_dims: int = 32
    chains_per_ensemble: int = 16
    chain_depth: int = 8
    sketch_rows: int = 2
    sketch_buckets: int = 2048
    decay_half_life: int = 2048
    seed: int | None = None

    def __post_init__(self) -> None:
        self._counts(*[f.name for f in fields(self) if f.name != "seed"])
        _check(self.sketch_buckets >= 2, "sketch_buckets must be 2 or more")
        _check(self.chain_depth <= MAX_DEPTH, f"chain_depth must be {MAX_DEPTH} or less, so that widths stay above 0")
        self._seed()
