"""Quality rules as a learned decision list.

Sequential covering: each rule is a conjunction of threshold conditions on ratios
of a text's counts, grown on two thirds of the labelled rows by the information
it gains about low quality and pruned on the last third; rows that it covers leave,
and the next rule is learned from the rest. A rule that on the rows it was pruned
on covers too few rows, or too many clean ones, ends the list. The list is an ordered
Spark conditional expression; its default keeps.

Labels come from at most ``MAX_LABELLED`` rows, those with the smallest hash of
their id. Null and empty texts have no words and fail the base rule. An empty table
gives an empty result; without labels of both kinds the list is empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, sampled
from .text_stats import with_counts

MAX_LABELLED = 20_000
MIN_COVER = 5
MIN_PRECISION = 0.9
MAX_RULES = 24
MAX_CONDITIONS = 4
CUTS = 48

#: Features: numerator by denominator.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "symbol_words": ("n_symbol_words", "n_words"),
    "bar_words": ("n_bar_words", "n_words"),
    "upper_words": ("n_upper_words", "n_words"),
    "bang_words": ("n_bang_words", "n_words"),
    "twin_words": ("n_twin_words", "n_words"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "letters": ("n_letters", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "short_words": ("n_stop_words", "n_words"),
    "long_words": ("n_long_words", "n_words"),
    "line_length": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        a, b = RATIOS[self.feature]
        ratio = F.col(a) / F.greatest(F.col(b), F.lit(1))
        return ratio > F.lit(self.cut) if self.above else ratio <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [c.holds(x) for c in self.conditions])

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def ratios(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: x[a] / np.maximum(x[b], 1) for k, (a, b) in RATIOS.items()}


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Adds the condition of the greatest gain until no clean row is left, or none helps."""
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for name, v in x.items():
            own, label = v[inside], bad[inside]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 1)[:-1], method="lower"))
            order = np.argsort(own, kind="stable")
            up = np.r_[0, np.cumsum(label[order])]
            at = np.searchsorted(own[order], cuts, "right")
            for above in (True, False):
                pos = p - up[at] if above else up[at]
                all_ = len(own) - at if above else at
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / all_) - now), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = gain[k], Condition(name, above, float(cuts[k]))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= rule[-1].holds(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The beginning of the rule that does best on rows it was not grown on; of equals the shortest."""
    best = (-np.inf, rule)
    for k in range(1, len(rule) + 1):
        hit = Rule(tuple(rule[:k])).holds(x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        worth = (p + 1) / (p + n + 2)
        if worth > best[0]:
            best = worth, rule[:k]
    return best[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    rules: list[Rule] = []
    part = np.random.default_rng(seed).permutation(len(bad)) % 3
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & (part > 0), left & (part == 0)
        if (grow & bad).sum() < MIN_COVER or not (grow & ~bad).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        rule = Rule(tuple(_prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])))
        hit = rule.holds(x) & left
        tried = hit & prune
        if hit.sum() < MIN_COVER or (hit & bad).sum() < MIN_PRECISION * hit.sum() or (tried.any() and (tried & bad).sum() < MIN_PRECISION * tried.sum()):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def expression(rules: list[Rule]) -> Column:
    """The position from 1 of the first rule that holds; 0 for the default."""
    found = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        found = F.when(rule.column(), F.lit(i)).otherwise(found)
    return found


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """doc_id, text and label of at most so many labelled rows that are not held out, those with the smallest hash of their id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max(label).alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(sampled(known, "doc_id", most)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, most: int = MAX_LABELLED) -> list[Rule]:
    rows = with_counts(labelled(docs, labels, "quality", modulus, remainder, most), carry=("label",)).orderBy("doc_id").toPandas()
    if not len(rows):
        return []
    failed = (rows["n_words"] < 50) | (100 * rows["n_repeat_words"] > 50 * rows["n_words"])
    rows = rows[~failed]
    return learn(ratios({c: rows[c].to_numpy(float) for c in rows.columns if c not in ("doc_id",)}), rows["label"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, rule (0: none) and kept."""
    rows = with_counts(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", base).withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
