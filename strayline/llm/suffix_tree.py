"""Scores of texts under a probabilistic suffix tree over words.

Symbols are lower-cased (A-Z) words and one end. The root is the smoothed unigram
distribution over all training texts, with half a count for every known symbol and
half for all unknown ones together. A context of one to ``DEPTH`` words is a candidate
if training has it ``MIN_CONTEXT`` times or more; of its next symbols those that follow
it ``MIN_JOINT`` times or more are stored. The tree grows with the corpus. A candidate is
retained if its distribution diverges from that of its longest retained suffix by
``MIN_DIVERGENCE`` nats a token or more. What a state doesn't store it leaves to that
suffix, so that every state's distribution sums to one:

    P(s | w) = (n(w s) [if stored] + (n(w) - stored + KAPPA) P(s | suffix of w)) / (n(w) + KAPPA)

A token is scored by the longest state that is a suffix of what comes before it.

Vocabulary and tree are as large as the corpus makes them and are never broadcast. Tasks
write the texts they read as blocks of word numbers. Each block's distinct words go to
the owners of their hashes, which send back their counts and their numbers in the whole
corpus. From a block each token goes, with the three words before it, to the part of its
last word. A context's suffixes end in the same word, so a part has all counts of its
contexts: it grows their branch of the tree, scores its tokens, and hands back sums by
text. Only counts of two or more have numbers: a token after a rarer word is the root's.

A word that ``HOT`` training tokens or more follow has no part of its own. Blocks send only
how often each symbol follows it, cut into slices by the symbol; the slices' sums give
its place in the tree; then its tokens, with what it says of them, go on to the parts of
the last two words, and where those are too many of the last three. So no task holds more than
a part's tokens and those of contexts below ``HOT``, however common a word is.

Null texts count as empty and hold just the end. Held-out texts teach nothing. Without
training texts N and V are 0 and every token is unknown. Rows that repeat are all scored
and teach as often as they are there. Sums by text and part travel as 32-bit floats.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, fold, give_back, parts, small_batches, stored, words
from .packing import pack, pack_words, unpack, unpack_words

DEPTH = 3
MIN_CONTEXT = 2
MIN_JOINT = 2
MIN_DIVERGENCE = 0.02
KAPPA = 1.0
#: Text of a block, which a task holds at once.
BLOCK_BYTES = 14 << 20
#: Training tokens of a part, if spread evenly.
PART_TOKENS = 1_500_000
#: Training tokens of a context that is cut into slices.
HOT = 4_000_000
#: Tokens of a part whose contexts are looked at together, if spread evenly.
TOGETHER = 400_000
#: Blocks whose distinct words an owner of hashes gets, if spread evenly.
OWNED = 4
#: Words with fewer occurrences can be in no state.
LOW = min(MIN_JOINT, MIN_CONTEXT)
#: Stands for the end in tables of words; no word is empty.
END = ""

CONTEXT = [f"c{i}" for i in range(1, DEPTH + 1)]
#: Kinds of messages. BASE: a block's texts under the root; SUMS: of some tokens, by text; HOT_TOKENS: a block's tokens after a hot context;
#: ASK and ANSWER: how often symbols follow it in the block, and in all; TOTAL: what a slice of the symbols says of it; COLD + k: tokens of
#: which all that follow the same k words are in the same part.
BASE, SUMS, HOT_TOKENS, ASK, ANSWER, TOTAL, COLD = range(7)
#: Words of a hot context, the latest first, and -1 for none.
CONTEXT = [f"c{i}" for i in range(1, DEPTH + 1)]
NAMES = ["part", "kind", "block", *CONTEXT, "data", "of_context", "stored_n", "stored_q", "deeper"]
TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * (DEPTH + 1), pa.binary(), *[pa.float64()] * 3, pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))]
MESSAGE = f"part long, kind int, block long, {', '.join(f'{c} long' for c in CONTEXT)}, data binary, of_context double, stored_n double, stored_q double, deeper array<struct<word:long,n:long>>"


def with_ends(values: np.ndarray, offsets: np.ndarray, end) -> np.ndarray:
    """values with an end after each text."""
    out = np.full(len(values) + len(offsets) - 1, end, values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = values
    return out


def encoded(docs: DataFrame, id: str, text: str, modulus: int, remainder: int, block_bytes: int) -> DataFrame:
    """A row for each block: its texts' ids and folds, their sizes and symbols as places among its distinct words, and these in the order of their hashes with their training counts."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", fold(F.col("doc_id"), modulus, remainder))
    names = ["block", "ids", "held_out", "sizes", "codes", "words", "n"]

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        teach = ~table["held_out"].to_numpy()
        codes, offsets, known = words(table["text"], lower=True)
        sizes = np.diff(offsets)
        n = np.r_[np.bincount(codes[np.repeat(teach, sizes)], minlength=len(known)), teach.sum()]
        known = np.array([*known.to_pylist(), END], object)
        order = np.argsort(hashes(known), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        whole = [pa.ListArray.from_arrays([0, len(table)], table[c].combine_chunks()) for c in ("doc_id", "held_out")]
        data = [pack(sizes + 1), pack(with_ends(place[codes], offsets, place[-1])), pack_words(known[order]), pack(n[order])]
        return pa.RecordBatch.from_arrays([pa.array([number]), *whole, *[pa.array([x], pa.binary()) for x in data]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.column(1).nbytes
            if size >= block_bytes:
                yield block(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)
        give_back()

    small_batches(docs.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, held_out array<boolean>, sizes binary, codes binary, words binary, n binary")


def hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def numbered(blocks: DataFrame, owners: int) -> DataFrame:
    """block, owner and data: the number and training count of the block's words that the owner has, in the block's order; tokens, kinds and most: once for each owner its training tokens, distinct words and largest count.

    Words that no state can have are told apart by their counts alone, as -1 - n. The others' numbers follow their counts, so that common ones are small.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, known, n in zip(*(c.to_pylist() for c in batch.columns)):
                known, (n,) = unpack_words(known).to_numpy(zero_copy_only=False), unpack(n)
                # The hashes rise, and so do the owners.
                owner = (hashes(known) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
                cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                spans = list(zip(cut, np.r_[cut[1:], len(owner)]))
                columns = [owner[cut].astype(np.int32), [block] * len(cut), [pack_words(known[a:z]) for a, z in spans], [pack(n[a:z]) for a, z in spans]]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["owner", "block", "words", "n"])

    def count(table: pa.Table) -> pa.Table:
        known = [unpack_words(x.as_py()) for x in table["words"]]
        n = np.concatenate([unpack(x.as_py())[0] for x in table["n"]])
        all_ = pa.concat_arrays(known).dictionary_encode()
        place = all_.indices.to_numpy()
        total = np.bincount(place, n, len(all_.dictionary)).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = np.where(total >= LOW, rank * owners + table["owner"][0].as_py(), -1 - total)
        cut = np.cumsum([0, *map(len, known)])
        data = [pack(number[place[a:z]], total[place[a:z]]) for a, z in zip(cut, cut[1:])]
        once = lambda x: pa.array([int(x)] + [0] * (len(table) - 1), pa.int64())
        return pa.table([table["block"], table["owner"], pa.array(data, pa.binary()), once(total.sum()), once((total > 0).sum()), once(total.max())], names=["block", "owner", "data", "tokens", "kinds", "most"])

    small_batches(blocks.sparkSession)
    pieces = blocks.select("block", "words", "n").mapInArrow(split, "owner int, block long, words binary, n binary")
    return pieces.groupBy("owner").applyInArrow(count, "block long, owner int, data binary, tokens long, kinds long, most long")


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of the columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = (out ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


@dataclass
class Tokens:
    """before: the last word, the one before it and so on, negative for none; symbol: places among names, which rise; doc: twice the text's place in its block, and one more where it teaches; extra: for each name its training count or, after a hot context, its log10 probability."""

    before: list[np.ndarray]
    symbol: np.ndarray
    doc: np.ndarray
    names: np.ndarray
    extra: np.ndarray

    def some(self, at: np.ndarray) -> Tokens:
        used, symbol = np.unique(self.symbol[at], return_inverse=True)
        return Tokens([b[at] for b in self.before], symbol, self.doc[at], self.names[used], self.extra[used])

    def packed(self) -> bytes:
        return pack(*self.before, self.symbol, self.doc, np.diff(self.names, prepend=0), self.extra)

    @classmethod
    def of(cls, data: bytes) -> Tokens:
        *before, symbol, doc, steps, extra = unpack(data)
        names = np.cumsum(steps, dtype=np.int64)
        return cls(before, symbol, doc, names.astype(np.int32) if len(names) and names[-1] < 1 << 31 else names, extra)


def log_base(extra: np.ndarray, unit: float) -> np.ndarray:
    """log10 probabilities of symbols before a context is looked at."""
    return extra if extra.dtype.kind == "f" else np.log10((extra + 0.5) / unit)


def spans(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of equal keys."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return zip(cut.tolist(), np.r_[cut[1:], len(key)].tolist())


class Outbox:
    def __init__(self, n_parts: int, alone: int, hot: int) -> None:
        self.n_parts, self.alone, self.hot, self.rows = n_parts, min(alone, hot), hot, []

    def send(self, part: int, kind: int, block: int, data: bytes, context: tuple = (), of_context=None, stored_n=None, stored_q=None, deeper=None) -> None:
        self.rows.append((part, kind, block, *context, *[-1] * (DEPTH - len(context)), data, of_context, stored_n, stored_q, deeper))

    def table(self) -> pa.Table:
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*self.rows)) or [()] * len(NAMES), TYPES)], names=NAMES)

    def sums(self, block: int, doc: np.ndarray, value: np.ndarray) -> None:
        docs, place = np.unique(doc >> 1, return_inverse=True)
        self.send(block % self.n_parts, SUMS, block, pack(docs, np.bincount(place, value).astype(np.float32)))

    def tokens(self, block: int, tokens: Tokens, level: int, of_context: np.ndarray) -> None:
        """Tokens after the same words but the last of level go on. of_context: the training tokens after each one's context if they are many, else 0."""
        cold = np.flatnonzero(of_context < self.hot).astype(np.int32)
        latest = [b[cold] for b in tokens.before[: max(2, level)]]
        part = latest[0] % self.n_parts if level == 1 else (mixed(latest[:level]) % np.uint64(self.n_parts)).astype(np.int32)
        if level == 1 and len(many := np.flatnonzero(of_context[cold] >= self.alone)):
            # Their parts are beyond those of the others.
            part = part.astype(np.int64)
            part[many] = self.n_parts + latest[0][many].astype(np.int64)
        # Tokens that lie with their like take less room.
        like = part.astype(np.int64) << 20
        like += latest[0] & 0xFFFFF
        like <<= 20
        like += latest[1] & 0xFFFFF
        latest.clear()
        order = np.argsort(like).astype(np.int32)
        cold, part, like = cold[order], part[order], None
        for a, z in spans(part):
            self.send(int(part[a]), COLD + level, block, tokens.some(cold[a:z]).packed())
        hot = np.flatnonzero(of_context >= self.hot)
        hot = hot[np.argsort(tokens.before[level - 1][hot], kind="stable")]
        for a, z in spans(tokens.before[level - 1][hot]):
            own, n = tokens.some(hot[a:z]), int(of_context[hot[a]])
            context = tuple(int(b[0]) for b in own.before[:level])
            self.send(block % self.n_parts, HOT_TOKENS, block, own.packed(), context)
            times = np.bincount(own.symbol, own.doc & 1, len(own.names)).astype(np.int64)
            slice_of = (mixed([own.names]) % np.uint64(n // self.hot + 1)).astype(np.int64)
            first = int(mixed([np.array([c]) for c in context])[0] % np.uint64(self.n_parts))
            order = np.argsort(slice_of, kind="stable")
            for b, y in spans(slice_of[order]):
                at = order[b:y]
                self.send((first + int(slice_of[at[0]])) % self.n_parts, ASK, block, pack(at, own.names[at], times[at], own.extra[at]), context)


def opened(number: dict, unit: float, n_parts: int, alone: int, hot: int) -> pa.Table:
    """The messages of a block: its texts under the root, and its tokens."""
    out = Outbox(n_parts, alone, hot)
    block, held, sizes, codes = (number[c] for c in ("block", "held_out", "sizes", "codes"))
    # Words that no state can have are one symbol for each count.
    names, first, place = np.unique(number["number"], return_index=True, return_inverse=True)
    n = number["n"][first]
    symbol = place.astype(np.int32)[codes]
    del codes, place
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    word = names.astype(np.int32 if len(names) and names[-1] < 1 << 31 else np.int64)[symbol]
    since = np.arange(len(symbol), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    before: list[np.ndarray] = []
    for k in range(1, DEPTH + 1):
        back = np.full(len(symbol), -1, word.dtype)
        ok = since[k:] >= k
        if before:
            ok &= before[-1][k:] >= 0
        back[k:] = np.where(ok, np.maximum(word[:-k], -1), word.dtype.type(-1))
        before.append(back)
    del since, word
    first_words, root = before[0] < 0, log_base(n, unit)
    sums = [np.bincount(doc, x, len(sizes)) for x in ((n > 0)[symbol], root[symbol])] + [np.bincount(doc[first_words], root[symbol[first_words]], len(sizes))]
    out.send(block % n_parts, BASE, block, pack(sizes, sums[0].astype(np.int64), *sums[1:]))
    at = np.flatnonzero(~first_words)
    of_context = np.where((n >= out.alone) & (names >= 0), n, 0)[symbol[at - 1]]
    code = 2 * doc + ~np.repeat(held, sizes)
    out.tokens(block, Tokens([b[at] for b in before], symbol[at], code[at], names, n), 1, of_context)
    give_back()
    return out.table()


def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the position of one of each distinct key, in their order; of each key its place among them)."""
    order = np.argsort(key, kind="stable").astype(np.int32)
    risen = key[order]
    del key
    new = np.r_[True, risen[1:] != risen[:-1]][: len(risen)]
    del risen
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    place = np.empty(len(order), np.int32)
    place[order] = number
    return order[new], place


def token_scores(symbol: np.ndarray, before: list[np.ndarray], teach: np.ndarray, value: np.ndarray, level: int = 1, some: np.ndarray | None = None, together: int = TOGETHER) -> None:
    """Sets value to the log10 probability of each token, or of those at some, by the tree of those that teach.

    symbol: -1 - n for words that no state has. before: the last word, the one before it and so on, negative for none. value: what contexts shorter than level say.
    All tokens after the last level words of any must be there: then so are all contexts that end in them, with their suffixes and counts. Contexts are
    looked at in groups of about so many tokens together; a larger one alone, and those that end in it in groups again.
    """
    if some is None:
        some = np.arange(len(symbol), dtype=np.int32)
    some = some[before[level - 1][some] >= 0]
    group = np.zeros(len(some), np.uint32)
    for k in range(level):
        group ^= before[k][some].astype(np.uint32)
        group *= np.uint32(0x9E3779B1)
        group ^= group >> np.uint32(15)
    group %= np.uint32(len(some) // together + 1)
    order = np.argsort(group, kind="stable").astype(np.int32)
    cuts = list(spans(group[order]))
    some, group = some[order], None
    del order
    for a, z in cuts:
        at = some[a:z]
        context = places(before[0][at])[1]
        for k in range(1, level):
            context = places(joined(context, before[k][at]))[1]
        at = one_level(at, context, symbol, teach, value)
        del context
        if level < DEPTH and len(at):
            token_scores(symbol, before, teach, value, level + 1, at, together)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One key of both. A word's number has up to 42 bits, and a place in a part 21 bits more; where there is one context, the word alone is the key."""
    if not len(context) or not context.any():
        return word
    key = context.astype(np.int64)
    key <<= 42
    key |= word
    return key


def one_level(at: np.ndarray, context: np.ndarray, symbol: np.ndarray, teach: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sets the values of the tokens at at by their contexts alone. Returns those whose context is a candidate: no longer one is more common than its suffix."""
    of_context = np.bincount(context[teach[at]], minlength=int(context.max()) + 1 if len(context) else 0)
    often = of_context[context] >= MIN_CONTEXT
    at, context = at[often], context[often]
    del often
    first, entry = places(joined(context, symbol[at] + LOW))
    n, place, own = np.bincount(entry[teach[at]], minlength=len(first)), context[first], symbol[at[first]]
    log_q = value[at[first]]
    q, kept, size = 10**log_q, (n >= MIN_JOINT) & (own >= 0), len(of_context)
    stored_n = np.bincount(place[kept], n[kept], size)
    stored_q = np.bincount(place[kept], q[kept], size)
    rest = (of_context - stored_n + KAPPA) / (of_context + KAPPA)
    p = n / (of_context + KAPPA)[place] + rest[place] * q
    gain = np.bincount(place[kept], (p * np.log(p / q))[kept], size) + rest * np.maximum(0, 1 - stored_q) * np.log(rest)
    found = np.where(kept, np.log10(p), np.log10(rest[place]) + log_q)
    found = np.where((gain >= MIN_DIVERGENCE)[place], found, log_q)
    value[at] = found[entry]
    return at


def worked(table: pa.Table, unit: float, n_parts: int, alone: int, hot: int) -> pa.Table:
    """A part's answers: sums for the tokens that are all here, and what it knows of the symbols after hot contexts."""
    out, kinds = Outbox(n_parts, alone, hot), table["kind"].to_numpy()
    for level in range(1, DEPTH + 1):
        rows = table.filter(pa.array(kinds == COLD + level))
        if not len(rows):
            continue
        before: list[list] = [[] for _ in range(DEPTH)]
        symbol, base, doc = [], [], []
        for data in rows["data"]:
            own = Tokens.of(data.as_py())
            for k, b in enumerate(own.before):
                before[k].append(b)
            symbol.append(own.names[own.symbol])
            base.append(log_base(own.extra, unit)[own.symbol])
            doc.append(own.doc)
        # Pieces go as soon as they are whole.
        for pieces in before:
            pieces[:] = [np.concatenate(pieces)]
        before = [pieces[0] for pieces in before]
        symbol = np.concatenate(symbol)
        value = np.concatenate(base)
        base, teach = None, (np.concatenate(doc) & 1).astype(bool)
        token_scores(symbol, before, teach, value, level)
        cut = np.cumsum([0, *map(len, doc)])
        for block, own, a, z in zip(rows["block"].to_pylist(), doc, cut, cut[1:]):
            out.sums(block, own, value[a:z])
    asked: dict[tuple, list] = defaultdict(list)
    rows = table.filter(pa.array(kinds == ASK))
    for block, data, *context in zip(*(rows[c].to_pylist() for c in ("block", "data", *CONTEXT))):
        asked[tuple(context)].append((block, *unpack(data)))
    part = table["part"][0].as_py()
    for context, found in asked.items():
        names, first, place = np.unique(np.concatenate([f[2] for f in found]), return_index=True, return_inverse=True)
        joint = np.bincount(place, np.concatenate([f[3] for f in found]), len(names)).astype(np.int64)
        q = 10 ** log_base(np.concatenate([f[4] for f in found])[first], unit)
        kept = (joint >= MIN_JOINT) & (names >= 0)
        deeper = [{"word": int(names[i]), "n": int(joint[i])} for i in np.flatnonzero((joint >= hot) & (names >= 0))]
        out.send(part, TOTAL, -1, pack(joint[kept], q[kept]), context, float(joint.sum()), float(joint[kept].sum()), float(q[kept].sum()), deeper)
        cut = np.cumsum([0, *(len(f[1]) for f in found)])
        for (block, at, *_), a, z in zip(found, cut, cut[1:]):
            out.send(part, ANSWER, block, pack(at, joint[place[a:z]]), context)
    give_back()
    return pa.concat_tables([table.filter(pa.array(np.isin(kinds, [BASE, SUMS, HOT_TOKENS]))).cast(out.table().schema), out.table()])


def hot_contexts(totals: DataFrame, level: int) -> DataFrame:
    """Of each hot context of level words: of_context, stored_n (the share that it leaves to its suffix), stored_q (1 if it is a state), deeper (hot contexts that end in it, as the word before it and their counts)."""
    sums = totals.groupBy(*CONTEXT).agg(*(F.sum(c).alias(c) for c in ("of_context", "stored_n", "stored_q")))
    rest = (F.col("of_context") - F.col("stored_n") + KAPPA) / (F.col("of_context") + KAPPA)
    sums = sums.select(*CONTEXT, "of_context", rest.alias("rest"), "stored_q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = []
            for data, of_context, rest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, q = unpack(data)
                p = n / (of_context + KAPPA) + rest * q
                gain.append(float((p * np.log(p / q)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(gain, pa.float64())], [*CONTEXT, "gain"])

    gains = totals.select("data", *CONTEXT).join(sums, CONTEXT).select("data", "of_context", "rest", *CONTEXT)
    gains = gains.mapInArrow(run, f"{', '.join(f'{c} long' for c in CONTEXT)}, gain double").groupBy(*CONTEXT).agg(F.sum("gain").alias("gain"))
    gain = F.col("gain") + F.col("rest") * F.greatest(F.lit(0.0), 1 - F.col("stored_q")) * F.log("rest")
    found = sums.join(gains, CONTEXT).select(*CONTEXT, "of_context", F.col("rest").alias("stored_n"), (gain >= MIN_DIVERGENCE).cast("double").alias("stored_q"))
    # A symbol that often follows this context makes a hot one with it, whose last words are the symbol and all of this one's but the first.
    words = [F.col("d.word"), *(F.col(c) for c in CONTEXT[: level - 1])]
    longer = totals.select(F.explode("deeper").alias("d"), *CONTEXT).select(
        *[w.alias(c) for w, c in zip(words, CONTEXT)], *[F.lit(-1).cast("long").alias(c) for c in CONTEXT[level:]], F.struct(F.col(CONTEXT[level - 1]).alias("word"), F.col("d.n").alias("n")).alias("d")
    )
    return found.join(longer.groupBy(*CONTEXT).agg(F.collect_list("d").alias("deeper")), CONTEXT, "left")


def advanced(table: pa.Table, unit: float, n_parts: int, alone: int, hot: int) -> pa.Table:
    """A block's tokens after one hot context: sums of those that are done, and the others with what the context says of them."""
    out, kinds = Outbox(n_parts, alone, hot), table["kind"].to_numpy()
    row = table.filter(pa.array(kinds == HOT_TOKENS)).to_pylist()[0]
    tokens, block = Tokens.of(row["data"]), row["block"]
    level = sum(row[c] >= 0 for c in CONTEXT)
    joint = np.zeros(len(tokens.names), np.int64)
    for data in table.filter(pa.array(kinds == ANSWER))["data"]:
        at, n = unpack(data.as_py())
        joint[at] = n
    value = log_base(tokens.extra, unit)
    if row["stored_q"]:
        kept, rest = (joint >= MIN_JOINT) & (tokens.names >= 0), row["stored_n"]
        value = np.where(kept, np.log10(joint / (row["of_context"] + KAPPA) + rest * 10**value), np.log10(rest) + value)
    further = tokens.before[level] if level < DEPTH else np.full(len(tokens.symbol), -1)
    done = further < 0
    if done.any():
        out.sums(block, tokens.doc[done], value[tokens.symbol[done]])
    if not done.all():
        going = Tokens(tokens.before, tokens.symbol, tokens.doc, tokens.names, value).some(np.flatnonzero(~done))
        more = sorted((d["word"], d["n"]) for d in row["deeper"] or [])
        word, n = np.array([w for w, _ in more], np.int64), np.array([0, *(n for _, n in more)])
        place = pc.index_in(pa.array(further[~done].astype(np.int64)), value_set=pa.array(word))
        out.tokens(block, going, level + 1, n[pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1])
    return out.table()


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 1, block_bytes: int = BLOCK_BYTES, part_tokens: int = PART_TOKENS, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. block_bytes, part_tokens and hot bound what a task holds and change no result; the larger they are, the fewer and fuller are the messages."""
    spark = docs.sparkSession
    blocks = bucketed(encoded(docs, id, text, modulus, remainder, block_bytes), "block", parts(spark), "blocks")
    numbers = stored(numbered(blocks, max(parts(spark), blocks.count() // OWNED)), "numbers")
    total, kinds, most = (x or 0 for x in numbers.agg(F.sum("tokens"), F.sum("kinds"), F.max("most")).first())
    unit, n_parts, hot = total + 0.5 * (kinds + 1), max(parts(spark), -(-total // part_tokens)), max(hot, LOW)
    # A word with half a part has a part of its own.
    known = (unit, n_parts, max(1, part_tokens // 2), hot)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        own, right = left.to_pylist()[0], right.sort_by("owner")
        number, n = (np.concatenate(x) for x in zip(*(unpack(d.as_py()) for d in right["data"])))
        read = {c: unpack(own[c])[0] for c in ("sizes", "codes")}
        return opened({"block": own["block"], "held_out": np.array(own["held_out"]), "number": number, "n": n, **read}, *known)

    def work(messages: DataFrame) -> DataFrame:
        return messages.groupBy("part").applyInArrow(lambda t: worked(t, *known), MESSAGE)

    sent = blocks.select("block", "held_out", "sizes", "codes").groupBy("block").cogroup(numbers.select("block", "owner", "data").groupBy("block")).applyInArrow(first, MESSAGE)
    now = work(sent)
    results = [now]
    if most >= hot:
        now = stored(now, "messages")
        results = [now]
        for level in range(1, DEPTH + 1):
            totals = now.filter(F.col("kind") == TOTAL)
            if totals.isEmpty():
                break
            facts = stored(hot_contexts(totals, level), f"hot-contexts-{level}")
            tokens = now.filter(F.col("kind") == HOT_TOKENS).drop("of_context", "stored_n", "stored_q", "deeper").join(facts, CONTEXT).select(*NAMES)
            on = tokens.union(now.filter(F.col("kind") == ANSWER).select(*NAMES)).groupBy("block", *CONTEXT)
            on = on.applyInArrow(lambda t: advanced(t, *known), MESSAGE)
            now = stored(work(on), f"messages-{level}")
            results.append(now)

    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held = (left[c].combine_chunks().flatten() for c in ("ids", "held_out"))
        sums = np.zeros(len(ids))
        for kind, data in zip(right["kind"].to_pylist(), right["data"].to_pylist()):
            if kind == BASE:
                sizes, known, base, alone = unpack(data)
                sums += alone
            else:
                at, value = unpack(data)
                sums[at] += value
        return pa.table([ids, held, *[pa.array(x) for x in (sizes.astype(np.int64), known.astype(np.int64), base, sums)]], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = reduce(DataFrame.union, (r.filter(F.col("kind").isin(BASE, SUMS)).select("block", "kind", "data") for r in results))
    scored = blocks.select("block", "ids", "held_out").groupBy("block").cogroup(found.groupBy("block"))
    scored = scored.applyInArrow(last, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
