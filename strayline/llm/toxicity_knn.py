"""Toxicity by the nearest labelled examples.

A term is a word or the first four or five letters of one. The vocabulary is the
proven terms, those whose share of toxic texts among labelled texts with the term is above
``MIN_SHARE`` by the lower Wilson bound. Near copies of a text would prove any of its
words, so near copies among the toxic texts count once: those whose MinHash signatures
over all pairs of neighbouring words agree in a share of ``ALIKE``, and of texts with
fewer than ``SHORT`` pairs those that agree in all. A beginning of words is left out where
one word in the vocabulary stands for nearly all of it. All other words of the examples are
indexed too. Examples and texts are TF-IDF vectors over proven terms and words, where words
that aren't proven weigh less (``worth``) but never nothing, and the ``NEIGHBOURS`` nearest
by cosine are found exactly with an inverted index and bounds: terms of few examples have
lists of postings, which are summed, and of the other terms an example's norms by groups of
terms are known, whose products with a text's norms are the most these terms can give. The
examples whose bounds are as high as the highest maxima of blocks are compared first, and of
the rest those whose bound reaches the last of the best so far. Votes are the workers' work;
the driver holds the examples packed. Neighbours vote with their similarity, and isotonic regression over the
examples' own votes, each without itself, turns votes into calibrated scores. The ids of
the nearest ones are the evidence.

Texts without a proven term that equal examples but for case and spaces have these as their
neighbours; the score is the toxic share of these, with half a row of either label added.

Examples are at most ``MAX_LABELLED`` labelled rows that are not held out, those with
the smallest hash of their id. Texts with no word of an example, null and empty ones too, get
the share of toxic examples among those without a proven term. Without labels every score is 0.
Equal similarities go to the example that comes first by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, give_back, owners, small_batches, words
from .decision_list import labelled
from .packing import pack, unpack

MAX_LABELLED = 20_000
MIN_TEXTS = 4
MIN_SHARE = 0.6
NEIGHBOURS = 15
BLOCK = 8
#: Examples with bounds as high as the highest of so many blocks are compared first.
FIRST = 16
#: Terms with more postings than this have rows in a matrix, so many of them alone and the others together; texts are multiplied with it so many at once.
LONG = 512
MATRIX = 256
ALONE = 192
TOGETHER = 64
#: Bounds are sums in 32 bits.
ROUNDING = 1.0001
#: What a rare word without any toxic text counts beside a proven one.
NEUTRAL = 0.01
#: Similarity that the share of toxic examples without a proven term counts as in a vote.
PRIOR = 0.5
EVIDENCE = 3
#: Minima of a text's signature, and how many of them a band of it has.
SKETCH = 32
BAND = 4
ALIKE = 0.7
SHORT = 16
#: Share of a beginning's texts that one word may have.
SAME = 0.9
THRESHOLD = 0.7
EDGES = " .,;:!?'\"()[]{}*#$%&|<>-_/\\"


def terms_of(known: pa.Array) -> list[pa.Array]:
    """Of each word its three terms; null where it has none."""
    core = pc.utf8_trim(pc.utf8_lower(known), characters=EDGES)
    size = pc.utf8_length(core)
    no = pa.scalar(None, pa.string())
    mark = lambda m, x: pc.binary_join_element_wise(m, x, ":")
    word = pc.if_else(pc.greater(size, 0), mark("w", core), no)
    heads = [pc.if_else(pc.greater(size, k), mark("p", pc.utf8_slice_codeunits(core, 0, k)), no) for k in (4, 5)]
    return [word, *heads]


def text_key(text: str | None) -> int:
    """Equal for texts with the same words in any case, 0 for those without."""
    line = " ".join((text or "").lower().split())
    return xxhash.xxh64_intdigest(line) if line else 0


def wilson_low(p, n, sqrt=np.sqrt, z: float = 1.96):
    """The lower bound of a share p of n, of arrays or Columns."""
    return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def present_terms(rows: DataFrame) -> DataFrame:
    """term, toxic, clean: labelled texts that have it, from rows of text and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets, known = words(batch.column(0))
            text, label = owners(offsets), batch.column(1).to_numpy(zero_copy_only=False)
            of = pa.concat_arrays(terms_of(known)).dictionary_encode()
            place = pc.fill_null(of.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(3, -1)
            pairs = np.unique(np.concatenate([(text * (len(of.dictionary) + 1) + p[codes])[p[codes] >= 0] for p in place]))
            toxic = label[pairs // (len(of.dictionary) + 1)] == 1
            term = pairs % (len(of.dictionary) + 1)
            n = [np.bincount(term[m], minlength=len(of.dictionary)).astype(np.int64) for m in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([of.dictionary, pa.array(n[0]), pa.array(n[1])], ["term", "toxic", "clean"])

    return rows.select("text", "label").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def places(of: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The place of each in the vocabulary, or -1. The smaller side is hashed."""
    own = of.dictionary_encode()
    at = np.full(len(own.dictionary) + 1, -1, np.int64)
    if len(vocabulary) > len(own.dictionary):
        which = pc.index_in(vocabulary, value_set=own.dictionary)
        there = np.flatnonzero(which.is_valid())
        at[which.drop_null().to_numpy(zero_copy_only=False)] = there
    else:
        at[:-1] = pc.fill_null(pc.index_in(own.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return at[pc.fill_null(own.indices, -1).to_numpy(zero_copy_only=False)]


def vectors(texts: pa.Array, vocabulary: pa.Array, others: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the terms in each text, sorted by text and term: the vocabulary's, and behind them the other words."""
    codes, offsets, known = words(texts)
    text, width = owners(offsets), max(1, len(vocabulary) + len(others if others is not None else ()))
    found = []
    for i, t in enumerate(terms_of(known)):
        at = places(t, vocabulary)
        if i == 0 and others is not None:
            rest = places(t, others)
            at = np.where(at < 0, np.where(rest < 0, -1, rest + len(vocabulary)), at)
        at = at[codes]
        found.append((text * width + at)[at >= 0])
    keys, times = np.unique(np.concatenate(found), return_counts=True)
    return keys // width, keys % width, times


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(SKETCH minima of each text over hashes of its pairs of neighbouring words, or of its only word; the number of pairs)."""
    codes, offsets, known = words(texts, lower=True)
    base = np.array([xxhash.xxh64_intdigest(w) for w in known.to_pylist()], np.uint64)[codes]
    out = np.zeros((len(texts), SKETCH), np.uint64)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out, sizes
    with np.errstate(over="ignore"):
        # The last word of a text pairs with itself only where it is the only one.
        follows = np.r_[base[1:], base[:1]]
        pairs = (base * np.uint64(0x9E3779B97F4A7C15)) ^ (follows + (base >> np.uint64(29)))
        last = offsets[1:][full] - 1
        pairs[last] = np.where(sizes[full] == 1, base[last], pairs[np.maximum(last - 1, 0)])
        for j in range(SKETCH):
            mixed = (pairs ^ np.uint64(j * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            out[full, j] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), offsets[full])
    return out, np.maximum(sizes - 1, 0)


def near_copies(marks: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The group of each text: near copies share one. Texts that share a band are held against the first of them."""
    group = np.arange(len(marks))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for at in range(0, SKETCH, BAND):
        _, first, which = np.unique(marks[:, at : at + BAND], axis=0, return_index=True, return_inverse=True)
        one = first[which.reshape(-1)]
        agree = (marks == marks[one]).mean(axis=1)
        need = np.where(np.minimum(pairs, pairs[one]) < SHORT, 1.0, ALIKE)
        for i in np.flatnonzero((agree >= need) & (one != np.arange(len(marks)))):
            a, b = top(i), top(one[i])
            group[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(len(marks))], np.int64)


def proven(rows: DataFrame, terms: list[str], clean: np.ndarray) -> list[str]:
    """Those of the terms that enough different toxic texts have."""
    if not terms:
        return []
    small_batches(rows.sparkSession)
    spec = rows.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, term, _ = vectors(batch.column(0), spec.value)
            cut = np.searchsorted(text, np.arange(len(batch) + 1))
            at = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term))
            minima, pairs = sketch(batch.column(0))
            marks = pa.array(minima.view(np.int64).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([at, marks, pa.array(pairs)], ["terms", "marks", "pairs"])

    found = rows.filter("label = 1").select("text").mapInArrow(run, "terms array<long>, marks array<long>, pairs long").toPandas()
    texts: list[list[int]] = [[] for _ in terms]
    for i, own in enumerate(found["terms"]):
        for t in own:
            texts[t].append(i)
    marks = np.array(found["marks"].tolist(), np.int64).reshape(-1, SKETCH)
    group = near_copies(marks, found["pairs"].to_numpy())
    toxic = np.array([len(np.unique(group[own])) for own in texts], float)
    good = [t for t, low in enumerate(wilson_low(toxic / np.maximum(1, toxic + clean), np.maximum(1, toxic + clean))) if low >= MIN_SHARE]
    of_word = {}
    for t in good:
        if terms[t].startswith("w:"):
            for k in (4, 5):
                head = terms[t][2 : 2 + k]
                of_word[head] = max(of_word.get(head, 0), len(texts[t]))
    return [terms[t] for t in good if terms[t].startswith("w:") or of_word.get(terms[t][2:], 0) < SAME * len(texts[t])]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def worth(toxic: np.ndarray, clean: np.ndarray, idf: np.ndarray, base: float) -> np.ndarray:
    """What words count in a vector, up to 1 where the share of toxic texts is proven: how far its lower bound is above the base share. Never 0."""
    n = np.maximum(1, toxic + clean)
    lift = np.clip((wilson_low(toxic / n, n) - base) / (MIN_SHARE - base), 0, 1)
    return np.maximum(NEUTRAL * (idf / (1 + np.log(1e6))) ** 2, lift**3)


class Search:
    """Unit vectors of examples, and exact search for the nearest of them.

    Terms of few examples are lists of postings; each of the others belongs to a row of a
    matrix, which has for each example the norm of its weights in the row's terms. A vector's
    sum over the lists and the product of its norms with the rows bound its similarities;
    where an example is compared, the other terms' weights take the product's place.
    """

    def __init__(self, cut: np.ndarray, term: np.ndarray, weight: np.ndarray, width: int, ahead: int) -> None:
        """Vectors lie from a cut to the next, each sorted by term; of the terms those ahead of the others have rows of their own first."""
        n = len(cut) - 1
        # Weights have 32 bits; their sums have 64.
        weight = weight.astype(np.float32, copy=False)
        self.dense = np.zeros(width)
        held = np.bincount(term, minlength=width)
        example = np.repeat(np.arange(n, dtype=np.int32), np.diff(cut))
        long = np.flatnonzero(held > LONG)
        long = long[np.lexsort((-held[long], long >= ahead))]
        single, shared = min(len(long), ALONE, MATRIX - 1), max(1, MATRIX - ALONE)
        self.row = np.full(width, -1, np.int32)
        self.row[long[:single]] = np.arange(single)
        self.row[long[single:]] = single + np.arange(len(long) - single) % shared
        self.n_rows = int(self.row.max(initial=-1)) + 1
        row = self.row[term]
        at = np.flatnonzero(row >= 0)
        # By example what the rows bound.
        self.cut, self.term, self.weight = np.r_[0, np.cumsum(np.bincount(example[at], minlength=n))], term[at].astype(np.int32), weight[at]
        cells = np.bincount(row[at].astype(np.int64) * n + example[at], np.square(self.weight, dtype=float), minlength=self.n_rows * n)
        self.rows = np.sqrt(cells).astype(np.float32).reshape(self.n_rows, n)
        del cells
        at = np.flatnonzero(row < 0)
        at = at[np.argsort(term[at].astype(np.int64) * n + example[at])]
        self.begin = np.r_[0, np.cumsum(np.where(held > LONG, 0, held))]
        self.example, self.value = example[at], weight[at]

    def all_nearest(self, cut: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, own: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As Index.all_nearest; own: the number of the example that the first vector is of, or -1."""
        for low in range(0, len(cut) - 1, TOGETHER):
            high = min(low + TOGETHER, len(cut) - 1)
            of, part = np.repeat(np.arange(high - low), np.diff(cut[low : high + 1])), slice(cut[low], cut[high])
            row = self.row[term[part]]
            some = row >= 0
            asked = np.bincount(of[some] * self.n_rows + row[some], np.square(weight[part][some], dtype=float), minlength=(high - low) * self.n_rows)
            most = np.sqrt(asked).astype(np.float32).reshape(high - low, self.n_rows) @ self.rows
            for i in range(low, high):
                one = slice(cut[i], cut[i + 1])
                yield self._nearest(term[one], weight[one], row[cut[i] - cut[low] : cut[i + 1] - cut[low]] < 0, most[i - low], k, own + i if own >= 0 else -1)

    def _nearest(self, term: np.ndarray, weight: np.ndarray, short: np.ndarray, bound: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        # bound: the most that the rows' terms give.
        n, t = len(bound), term[short]
        size = self.begin[t + 1] - self.begin[t]
        at = spans(self.begin[t], size)
        sums = np.bincount(self.example[at], np.repeat(weight[short], size) * self.value[at], minlength=n)
        bound = (bound + sums) * ROUNDING
        if without >= 0:
            bound[without] = 0
        best_e, best_s, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        # The highest bounds first: few of the others can be among the best then.
        tops = bound[: n - n % BLOCK].reshape(BLOCK, -1).max(axis=0)
        enough = np.partition(tops, -FIRST)[-FIRST] if len(tops) > FIRST else 0.0
        first = np.flatnonzero((bound >= enough) & (bound > 0))
        rest, step = None, 2 * FIRST
        t = term[~short]
        self.dense[t] = weight[~short]
        while len(first):
            size = self.cut[first + 1] - self.cut[first]
            at = spans(self.cut[first], size)
            s = sums[first] + np.bincount(np.repeat(np.arange(len(first)), size), self.dense[self.term[at]] * self.weight[at], minlength=len(first))
            e = np.r_[best_e, first[s > 0]]
            s = np.r_[best_s, s[s > 0]]
            keep = np.lexsort((e, -np.round(s, 12)))[:k]
            best_e, best_s = e[keep], s[keep]
            least = best_s[-1] - 1e-11 if len(best_s) == k else 0.0
            if rest is None:
                rest = np.flatnonzero((bound >= least) & (bound > 0) & (bound < enough))
                rest = rest[np.argsort(-bound[rest])]
            first, rest, step = rest[:step], rest[step:], 2 * step
            first = first[bound[first] >= least]
        self.dense[t] = 0
        return best_e, best_s


@dataclass
class Index:
    """Examples' unit vectors, packed until they are searched.

    Terms are those of the vocabulary, and behind them the other words.
    """

    vocabulary: pa.Array
    others: pa.Array
    idf: np.ndarray
    worth: np.ndarray
    ids: list
    labels: np.ndarray
    bare: float
    #: Of the examples with none of the vocabulary's terms, by text_key: their ids and labels.
    copies: dict[int, list[tuple]]
    #: Of examples one after another: how many terms each has, the terms and how often they occur.
    pieces: list[bytes]
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def __post_init__(self) -> None:
        self._search: Search | None = None
        self._sent: dict[str, Broadcast] = {}

    @classmethod
    def of(cls, vocabulary: pa.Array, idf: np.ndarray, ids: list, labels: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray, bare: float, copies: dict[int, list[tuple]]) -> Index:
        """From postings sorted by example and term, with weights of their own."""
        found = cls(vocabulary, pa.array([], pa.string()), idf, np.ones(len(vocabulary)), ids, labels, bare, copies, [])
        found._search = Search(np.searchsorted(example, np.arange(len(ids) + 1)), term, weight, len(vocabulary), len(vocabulary))
        return found

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def sent(self, spark: SparkSession) -> Broadcast:
        """The index at the workers, sent once; what it learns later is not there."""
        app = spark.sparkContext.applicationId
        if app not in self._sent:
            self._sent[app] = spark.sparkContext.broadcast(self)
        return self._sent[app]

    def plain(self, piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cuts, terms, TF-IDF weights) of a piece's examples."""
        sizes, term, times = unpack(piece)
        tf = (1 + np.log(np.maximum(1, np.arange(times.max(initial=0) + 1)))).astype(np.float32)
        return np.r_[0, np.cumsum(sizes, dtype=np.int64)], term, tf[times] * self.idf.astype(np.float32)[term]

    @property
    def search(self) -> Search:
        if self._search is None:
            cuts, terms, weights, end = [np.zeros(1, np.int64)], [], [], 0
            worth = self.worth.astype(np.float32)
            for piece in self.pieces:
                cut, term, weight = self.plain(piece)
                weight *= worth[term]
                cuts.append(cut[1:] + end)
                terms.append(term)
                weights.append(unit(cut, weight))
                end += cut[-1]
            self._search = Search(np.concatenate(cuts), np.concatenate(terms), np.concatenate(weights), len(self.idf), len(self.vocabulary))
            give_back()
        return self._search

    def all_nearest(self, cut: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: bool = False, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each vector, from a cut to the next, (examples, similarities) of the k nearest with a similarity above 0; without: the vectors are the examples from the first on."""
        return self.search.all_nearest(cut, term, weight, k, first if without else -1)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k nearest with a similarity above 0."""
        return next(self.all_nearest(np.array([0, len(term)]), term, weight, k))

    def vote(self, example: np.ndarray, similarity: np.ndarray) -> float:
        return float(((similarity * self.labels[example]).sum() + PRIOR * self.bare) / (similarity.sum() + PRIOR))

    def calibrate(self, spark: SparkSession, if_clean: np.ndarray, if_toxic: np.ndarray, alone: np.ndarray) -> None:
        """Isotonic regression of the labels on each example's vote without itself.

        Its vector weighs terms as the other examples do: if_clean, if_toxic is what words
        count without a clean or toxic example, and alone says which examples have no near copy.
        """
        own, spec = self.sent(spark), spark.sparkContext.broadcast((if_clean, if_toxic, alone))
        begins = np.r_[0, np.cumsum([len(unpack(p)[0]) for p in self.pieces])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, (if_clean, if_toxic, alone) = own.value, spec.value
            worth = index.worth.astype(np.float32)
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    begin = int(begins[p])
                    cut, term, plain = index.plain(index.pieces[p])
                    example = begin + np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                    weight = if_clean[term]
                    bad = index.labels[example] == 1
                    weight[bad] = np.where(alone[example[bad]], if_toxic[term[bad]], worth[term[bad]])
                    weight = unit(cut, plain * weight) * weight / worth[term]
                    votes = [index.vote(*found) if len(found[0]) else None for found in index.all_nearest(cut, term, weight, without=True, first=begin)]
                    yield pa.RecordBatch.from_arrays([pa.array(begin + np.arange(len(votes))), pa.array(votes, pa.float64())], ["example", "vote"])

        n = len(self.pieces)
        found = spark.range(0, n, 1, n).mapInArrow(run, "example long, vote double").filter("vote IS NOT NULL").toArrow()
        spec.destroy()
        at = found["example"].to_numpy()
        self.knots = isotonic(found["vote"].to_numpy(), self.labels[at].astype(float))


def unit(cut: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Vectors, from a cut to the next, at length 1."""
    size = np.diff(cut)
    norm = np.ones(len(size), np.float32)
    if size.any():
        norm[size > 0] = np.sqrt(np.add.reduceat(np.square(weight, dtype=float), cut[:-1][size > 0]))
    return weight / np.repeat(norm, size)


def calibrated(knots: tuple[np.ndarray, np.ndarray], vote: float) -> float:
    return float(np.interp(vote, *knots)) if len(knots[0]) else vote


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling neighbours; each pool has half a row of either label added."""
    pools: list[list[float]] = []
    at, which, n = np.unique(x, return_inverse=True, return_counts=True)
    for v, total, size in zip(at.tolist(), np.bincount(which, y, minlength=len(at)).tolist(), n.tolist()):
        pools.append([v, v, total, size])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, high, s, n = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + s, pools[-1][3] + n]
    knots = [(at, (s + 0.5) / (n + 1)) for low, high, s, n in pools for at in ((low, high) if high > low else (low,))]
    level = np.maximum.accumulate([v for _, v in knots]) if knots else np.zeros(0)
    return np.array([k for k, _ in knots]), np.asarray(level)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, most: int = MAX_LABELLED) -> Index | None:
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", modulus, remainder, most).select("text", "label", "doc_id")
    n = F.col("toxic") + F.col("clean")
    likely = (F.col("toxic") >= MIN_TEXTS) & (wilson_low(F.col("toxic") / n, n, F.sqrt) >= MIN_SHARE)
    known = present_terms(rows).select("term", "clean", likely.alias("likely"), F.col("toxic")).filter(F.col("likely") | F.col("term").startswith("w:")).toArrow()
    found = known.filter(known["likely"]).sort_by([("toxic", "descending"), ("term", "ascending")])
    vocabulary = pa.array(proven(rows, found["term"].to_pylist(), found["clean"].to_numpy().astype(float)), pa.string())
    which = pc.index_in(vocabulary, value_set=found["term"])
    counts = [found.select(["toxic", "clean"]).take(which)]
    known = known.filter(pc.and_(pc.starts_with(known["term"], "w:"), pc.invert(pc.is_in(known["term"], value_set=vocabulary)))).select(["term", "toxic", "clean"])
    known = known.take(pc.sort_indices(known["term"]))
    counts.append(known.select(["toxic", "clean"]))
    others = pa.concat_arrays(known["term"].chunks) if known["term"].num_chunks else pa.array([], pa.string())
    # Of each term the toxic and the clean examples that have it.
    toxic, clean = (np.concatenate([t[c].to_numpy() for t in counts]).astype(float) for c in ("toxic", "clean"))
    held = toxic + clean
    del known, found, counts
    spec = docs.sparkSession.sparkContext.broadcast((vocabulary, others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, term, times = vectors(batch.column(0), *spec.value)
            # A batch's first row carries the piece of all.
            piece = pa.array([pack(np.bincount(text, minlength=len(batch)), term, times), *[None] * (len(batch) - 1)][: len(batch)], pa.binary())
            bare = np.bincount(text, term < len(spec.value[0]), len(batch)) == 0
            key = [(text_key(t.as_py()) if b else 0) - (1 << 63) for t, b in zip(batch.column(0), bare)]
            label, (minima, pairs) = batch.column(1).cast(pa.int32()), sketch(batch.column(0))
            marks = pa.array([m if y == 1 else [] for m, y in zip(minima.view(np.int64), label.to_pylist())], pa.list_(pa.int64()))
            own = [batch.column(2), label, piece, pa.array(key, pa.int64()), pa.array(bare), marks, pa.array(pairs, pa.int64())]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "label", "piece", "key", "bare", "marks", "pairs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    examples = rows.orderBy("doc_id").mapInArrow(run, f"doc_id {kind}, label int, piece binary, key long, bare boolean, marks array<long>, pairs long").toArrow()
    spec.destroy()
    if not len(examples):
        return None
    small = {c: pa.concat_arrays(examples[c].chunks) for c in ("doc_id", "label", "key", "bare", "marks", "pairs")}
    label, without, ids = small["label"].to_numpy().astype(np.int64), small["bare"].to_numpy(zero_copy_only=False), small["doc_id"].to_pylist()
    bare = float((label[without].sum() + 0.5) / (without.sum() + 1)) if without.any() else float(label.mean())
    copies: dict[int, list[tuple]] = {}
    for i in np.flatnonzero(without):
        copies.setdefault(small["key"][i].as_py() + (1 << 63), []).append((ids[i], int(label[i])))
    copies.pop(0, None)
    # The driver holds the examples packed, and the terms of the toxic ones.
    pieces, of_toxic, begin = examples["piece"].drop_null().to_pylist(), [], 0
    for piece in pieces:
        sizes, term, _ = unpack(piece)
        example = begin + np.repeat(np.arange(len(sizes)), sizes)
        bad = label[example] == 1
        of_toxic.append((example[bad], term[bad]))
        begin += len(sizes)
    del examples
    width, is_toxic = len(vocabulary) + len(others), label == 1
    # Near copies among the toxic texts count once.
    group = np.full(len(ids), -1)
    group[is_toxic] = near_copies(small["marks"].flatten().to_numpy().reshape(-1, SKETCH), small["pairs"].to_numpy()[is_toxic])
    example, term = (np.concatenate(x) for x in zip(*of_toxic))
    toxic = np.bincount(np.unique(group[example] * width + term) % max(1, width), minlength=width).astype(float)
    n_groups = len(np.unique(group[is_toxic]))
    base = min(MIN_SHARE / 2, n_groups / max(1, n_groups + (~is_toxic).sum()))
    idf = np.log((len(ids) + 1) / (held + 1)) + 1
    known = np.arange(width) < len(vocabulary)
    counts, if_clean, if_toxic = (np.where(known, 1.0, worth(np.maximum(0, toxic - a), np.maximum(0, clean - b), idf, base)) for a, b in ((0, 0), (0, 1), (1, 0)))
    # An example's own label must not weigh the terms that it is asked with.
    alone = np.bincount(group[is_toxic], minlength=len(ids) + 1)[group] == 1
    index = Index(vocabulary, others, idf, counts, ids, label, bare, copies, pieces)
    index.calibrate(docs.sparkSession, if_clean.astype(np.float32), if_toxic.astype(np.float32), alone)
    give_back()
    return index


def score(docs: DataFrame, index: Index | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and evidence, the ids of the nearest examples."""
    spec = index.sent(docs.sparkSession) if index else None
    knots = index.knots if index else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spec.value if spec else None
        for batch in batches:
            value = np.full(len(batch), own.bare if own else 0.0)
            evidence: list[list] = [[]] * len(batch)
            if own is not None:
                at, term, times = vectors(batch.column(1), own.vocabulary, own.others)
                weight = (1 + np.log(np.maximum(1, times))) * own.idf[term] * own.worth[term]
                cut = np.searchsorted(at, np.arange(len(batch) + 1))
                weight /= np.sqrt(np.bincount(at, weight**2, len(batch)))[at]
                for i, (near, similarity) in enumerate(own.all_nearest(cut, term, weight)):
                    if len(near):
                        value[i] = calibrated(knots, own.vote(near, similarity))
                        evidence[i] = [own.ids[e] for e in near[:EVIDENCE]]
                for i in np.flatnonzero(np.bincount(at, term < len(own.vocabulary), len(batch)) == 0) if own.copies else ():
                    if same := own.copies.get(text_key(batch.column(1)[i].as_py())):
                        toxic = sum(label for _, label in same)
                        value[i] = (toxic + 0.5) / (len(same) + 1) if toxic else min(own.bare, 0.5 / (len(same) + 1))
                        evidence[i] = [e for e, _ in same[:EVIDENCE]]
            ids = pa.array(evidence, pa.list_(batch.schema.field(0).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), ids], ["doc_id", "score", "evidence"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>")
