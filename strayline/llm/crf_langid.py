"""Language of texts whose words may switch language, by a linear-chain CRF.

Every word gets the scores of its affixes, character n-grams and the languages'
lexicons; transitions between the languages of neighbouring words are learned with
them. Forward-backward gives each word's posterior over its whole text, however long:
chunks of a text are first summed up as matrices, which chain the chunks exactly, and
are then run again from both ends. Runs of words whose likeliest language is one are
the text's spans; words without a letter go with the run they are in. A text's language is the one with the most
posterior over words with a letter, and its score is that language's mean.

The model is fitted by gradient on the likelihood of at most ``MAX_TEXTS`` whole texts,
languages in turn, each those with the smallest hash of their id, with every word labelled as its text is.
Texts that are null or have no letter are ``und`` with score 0 and have no span. If no text is labelled,
all are. An empty table gives an empty result. Equal posteriors go to the language
that sorts first.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import early, fold, small_batches, stored, words

MAX_TEXTS = 800
LEXICON = 2000
CHUNK = 512
#: Words whose scores a worker keeps.
CACHE = 700_000
EDGES = " .,;:!?'\"()[]{}*#$%&|<>-_/\\"
UNKNOWN = "und"


def word_features(word: str, lexicon: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, value) of each feature of a lower-cased word; none if it has no letter."""
    w = word.strip(EDGES)
    if not w.isalpha() and not any(map(str.isalpha, w)):
        return []
    b = f"^{w}$"
    n = len(b)
    out = [("x", lexicon.get(w, "")), ("p", w[:1]), ("p", w[:2]), ("p", w[:3]), ("s", w[-1:]), ("s", w[-2:]), ("s", w[-3:])]
    out += [("g", b[i : i + 2]) for i in range(n - 1)]
    out += [("g", b[i : i + 3]) for i in range(n - 2)]
    return out


@dataclass
class Crf:
    languages: list[str]
    lexicon: dict[str, str]
    index: dict[tuple[str, str], int]
    weights: np.ndarray
    transitions: np.ndarray

    def __post_init__(self) -> None:
        # By kind, so that a lookup needs no pair.
        self.of = {kind: {v: i for (k, v), i in self.index.items() if k == kind} for kind in "xpsg"}

    def emissions(self, known: list[str]) -> np.ndarray:
        """Scores of each word for each language; zeros without a letter. The last row of weights is zero."""
        none = len(self.weights) - 1
        x, p, s, g = (self.of[k].get for k in "xpsg")
        lexicon, flat, starts = self.lexicon.get, [], []
        for word in known:
            starts.append(len(flat))
            w = word.strip(EDGES)
            if not w.isalpha() and not any(map(str.isalpha, w)):
                flat.append(none)
                continue
            b = f"^{w}$"
            flat += (x(lexicon(w, ""), none), p(w[:1], none), p(w[:2], none), p(w[:3], none), s(w[-1:], none), s(w[-2:], none), s(w[-3:], none))
            flat += [g(b[i : i + 2], none) for i in range(len(b) - 1)]
            flat += [g(b[i : i + 3], none) for i in range(len(b) - 2)]
        if not known:
            return np.zeros((0, len(self.languages)), np.float32)
        return np.add.reduceat(self.weights[np.array(flat)], np.array(starts), axis=0)


def _chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text, place in the text) of all chunks, the longest first."""
    sizes = np.diff(offsets)
    n = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[text] + place * CHUNK
    length = np.minimum(CHUNK, offsets[text + 1] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], text[order], place[order]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(emissions: np.ndarray, offsets: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Of each word, given log emissions. The chain starts from all languages alike."""
    n, k = emissions.shape
    if not n:
        return emissions
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-30
    a = np.exp(transitions - transitions.max())
    start, length, text, place = _chunks(offsets)
    active = len(length) - np.searchsorted(length[::-1], np.arange(1, CHUNK + 1), "left")
    into = np.full((len(start), k), 1 / k)
    out = np.ones((len(start), k))
    if place.any():
        # Only chunks of texts with several of them are chained.
        some = np.flatnonzero(np.bincount(text, minlength=len(offsets) - 1)[text] > 1)
        whole = np.zeros((len(start), k, k))
        part, low, long = np.broadcast_to(np.eye(k), (len(some), k, k)).copy(), start[some], length[some]
        live = len(long) - np.searchsorted(long[::-1], np.arange(1, CHUNK + 1), "left")
        for t in range(CHUNK):
            if not (m := live[t]):
                break
            part[:m] = (part[:m] @ a) * e[low[:m] + t][:, None, :]
            if t % 8 == 7 or t + 1 == CHUNK or live[t + 1] < m:
                part[:m] /= part[:m].sum(axis=(1, 2), keepdims=True)
        whole[some] = part
        last = place.max()
        by_place = [np.flatnonzero(place == p) for p in range(last + 1)]
        at = np.full(len(offsets) - 1, -1)
        for p in range(1, last + 1):
            at[text[by_place[p - 1]]] = by_place[p - 1]
            before = at[text[by_place[p]]]
            into[by_place[p]] = _unit(np.einsum("ni,nij->nj", into[before], whole[before]))
        at[:] = -1
        for p in range(last - 1, -1, -1):
            at[text[by_place[p + 1]]] = by_place[p + 1]
            has = by_place[p][at[text[by_place[p]]] >= 0]
            has = has[place[at[text[has]]] == p + 1]
            after = at[text[has]]
            out[has] = _unit(np.einsum("nij,nj->ni", whole[after], out[after]))
    forward = np.empty_like(e)
    now = into
    for t in range(CHUNK):
        if not (m := active[t]):
            break
        now = _unit((now[:m] @ a) * e[start[:m] + t])
        forward[start[:m] + t] = now
    backward = np.empty_like(e)
    now = out.copy()
    for t in range(CHUNK - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        going = now[:m]
        inner = t < length[:m] - 1
        if inner.any():
            i = np.flatnonzero(inner)
            nxt = start[i] + t + 1
            going[i] = _unit((e[nxt] * going[i]) @ a.T)
        backward[start[:m] + t] = going
    return _unit(forward * backward + 1e-300)


def train(texts: list[str], labels: list[str], steps: int = 30, rate: float = 0.15, decay: float = 1e-6) -> Crf:
    languages = sorted(set(labels))
    k = len(languages)
    codes, offsets, known = words(pa.array([t.lower() for t in texts], pa.string()))
    vocabulary = known.to_pylist()
    gold_of_text = np.array([languages.index(x) for x in labels])
    gold = np.repeat(gold_of_text, np.diff(offsets))

    # A language's lexicon: its most frequent words among those it has most of.
    seen = np.zeros((len(vocabulary), k))
    np.add.at(seen, (codes, gold), 1)
    by_core: dict[str, np.ndarray] = {}
    for w, row in zip(vocabulary, seen):
        core = w.strip(EDGES)
        by_core[core] = by_core.get(core, 0) + row
    cores = list(by_core)
    total = np.array([by_core[c] for c in cores]) if cores else np.zeros((0, k))
    share = total / np.maximum(1, total.sum(axis=0))
    lexicon: dict[str, str] = {}
    for j, name in enumerate(languages):
        top = np.argsort(-np.where(share.argmax(axis=1) == j, total[:, j], 0), kind="stable")[:LEXICON]
        lexicon |= {cores[i]: name for i in top if total[i, j] >= 3}

    # Features by number as they come; those of one word alone are left out.
    ids: dict[tuple[str, str], int] = {}
    numbers, sizes = array("i"), array("i")
    for w in vocabulary:
        own = word_features(w, lexicon)
        numbers.extend(ids.setdefault(f, len(ids)) for f in own)
        sizes.append(len(own))
    flat, n_words = np.frombuffer(numbers, np.int32) if len(numbers) else np.zeros(0, np.int32), len(vocabulary)
    word_at = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    often = np.bincount(flat, minlength=len(ids)) >= 2
    place = np.cumsum(often) - 1
    index = {f: int(place[i]) for f, i in ids.items() if often[i]}
    keep = often[flat]
    flat, word_at = place[flat[keep]], word_at[keep]
    del ids
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))

    # Training sequences are runs of at most CHUNK words; each is a whole sequence of its own.
    cut = np.unique(np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(offsets, offsets[1:])] + [offsets]))
    n = max(1, len(codes))
    inside = np.ones(len(codes), bool)
    inside[cut[:-1][cut[:-1] < len(codes)]] = False
    second = np.flatnonzero(inside)
    real = np.zeros((k, k))
    np.add.at(real, (gold[second - 1], gold[second]), 1)
    squares = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(steps):
        emission = np.zeros((n_words, k))
        for j in range(k):
            emission[:, j] = np.bincount(word_at, weights[flat, j], n_words)
        post, pair = _expected(emission[codes], cut, moves)
        post[np.arange(len(codes)), gold] -= 1
        per_word = np.stack([np.bincount(codes, -post[:, j], n_words) for j in range(k)], axis=1)
        grad_w = np.stack([np.bincount(flat, per_word[word_at, j], len(index)) for j in range(k)], axis=1) / n - decay * weights
        grad_m = (real - pair) / n - decay * moves
        for p, g, s in ((weights, grad_w, squares[0]), (moves, grad_m, squares[1])):
            s += g * g
            p += rate * g / (np.sqrt(s) + 1e-8)
    return Crf(languages, lexicon, index, np.vstack([weights, np.zeros((1, k))]).astype(np.float32), moves)


def _expected(x: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words and expected counts of neighbouring languages, for sequences of at most CHUNK words."""
    e = np.exp(x - x.max(axis=1, keepdims=True)) + 1e-30 if len(x) else x
    a = np.exp(moves - moves.max())
    k = x.shape[1]
    start, length, _, _ = _chunks(offsets)
    active = len(length) - np.searchsorted(length[::-1], np.arange(1, CHUNK + 1), "left")
    post, now = np.empty_like(e), np.full((len(start), k), 1 / k)
    for t in range(CHUNK):
        if not (m := active[t]):
            break
        now = _unit((now[:m] @ a) * e[start[:m] + t])
        post[start[:m] + t] = now
    total, back = np.zeros((k, k)), np.ones((len(start), k))
    for t in range(CHUNK - 1, 0, -1):
        m = active[t]
        if not m:
            continue
        at = start[:m] + t
        before = post[at - 1].copy()
        nxt = e[at] * back[:m]
        post[at] = _unit(post[at] * back[:m])
        joint = before[:, :, None] * a[None] * nxt[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[:m] = _unit(nxt @ a.T)
    if len(start):
        post[start] = _unit(post[start] * back)
    return post, total


def fit(docs: DataFrame, modulus: int = 4, remainder: int = 2, most: int = MAX_TEXTS) -> Crf | None:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), modulus, remainder))
    # All languages take turns, each with the smallest hashes first, so that rare ones are learned too.
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("total")), "languages")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = rows.select("doc_id", "lang").join(sizes, "lang").filter(early("doc_id", most, F.col("total"))).select("doc_id", "lang")
    turns = first.withColumn("turn", turn).filter(F.col("turn") <= most)
    kinds = sizes.count()
    some = turns.orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(max(most, kinds)).drop("turn")
    found = rows.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy("doc_id", "lang").toPandas()
    return train(found["text"].tolist(), found["lang"].tolist()) if len(found) else None




def runs_of(label: np.ndarray, counted: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of the runs of words with one label. Words that don't count go on with the run before them, or begin the one after; texts without any that counts have no run."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(counted)
    own, language = text[at], label[at]
    first = np.r_[True, own[1:] != own[:-1]][: len(at)]
    new = first | np.r_[True, language[1:] != language[:-1]][: len(at)]
    return np.where(first, offsets[own], at)[new], own[new]


def spans(docs: DataFrame, model: Crf | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans: the runs of words of one language, with the places of the first word and of the one after the last, and the language's mean posterior over words with a letter."""
    spec = docs.sparkSession.sparkContext.broadcast(model)
    fields = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())])
    names = ["doc_id", "lang_pred", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = spec.value
        k = len(crf.languages) if crf else 0
        row_of: dict[str, int] = {}
        scores = np.zeros((0, k), np.float32)
        for batch in batches:
            texts = batch.column(1)
            if crf is None:
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(fields))], names)
                continue
            codes, offsets, known = words(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
            if len(row_of) > CACHE:
                row_of, scores = {}, scores[:0]
            distinct = known.to_pylist()
            new = [w for w in distinct if w not in row_of]
            used = len(row_of)
            if used + len(new) > len(scores):
                scores = np.vstack([scores[:used], np.zeros((used + 2 * len(new), k), np.float32)])
            scores[used : used + len(new)] = crf.emissions(new)
            row_of.update(zip(new, range(used, used + len(new))))
            emission = scores[np.fromiter(map(row_of.__getitem__, distinct), np.int64, len(distinct))]
            letter = np.asarray(pc.match_substring_regex(known, r"\pL")).astype(bool)
            post = posteriors(emission[codes].astype(np.float64), offsets, crf.transitions)
            counted = letter[codes]
            sums = np.stack([np.r_[0, np.cumsum(post[:, j] * counted)] for j in range(k)], axis=1)
            count = np.r_[0, np.cumsum(counted)]
            mass, n = sums[offsets[1:]] - sums[offsets[:-1]], count[offsets[1:]] - count[offsets[:-1]]
            best = mass.argmax(axis=1)
            share = np.clip(mass[np.arange(len(best)), best] / np.maximum(n, 1), 0, 1)
            name = [crf.languages[b] if c else UNKNOWN for b, c in zip(best, n)]

            label = post.argmax(axis=1)
            start, own = runs_of(label, counted, offsets)
            end = np.r_[start[1:], 0][: len(start)]
            last = np.r_[own[1:] != own[:-1], True][: len(own)]
            end[last] = offsets[own[last] + 1]
            # A run's first word may be one that doesn't count: its last word with a letter has the language.
            lettered = np.flatnonzero(counted)
            language = label[lettered[count[end] - 1]] if len(start) else start
            mean = (sums[end, language] - sums[start, language]) / np.maximum(count[end] - count[start], 1)
            parts = [pa.array((start - offsets[own]).astype(np.int32)), pa.array((end - offsets[own]).astype(np.int32)), pa.array([crf.languages[j] for j in language], pa.string()), pa.array(np.clip(mean, 0, 1))]
            cut = np.searchsorted(own, np.arange(len(offsets)))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(np.where(n > 0, share, 0.0)), lists], names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string,score:double>>")


def predict(docs: DataFrame, model: Crf | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    return spans(docs, model, id, text).drop("spans")
