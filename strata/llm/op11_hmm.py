"""Scoring by a hidden Markov language model.

A text is a sequence of words (A-Z in lower case) and one end. Hidden states follow one another by a
transition matrix; a state emits a class, and a class one of its words:

    P(text) = sum over state paths of  prod  A[z', z] * B[z, class(w)] * P(w | class(w))

Frequent words (a share of 1 / OWN of the training tokens or more, so OWN at most) and the end are classes of
their own; every other word belongs to the class of its last three bytes, and has add-one probability there,
with one more share for all words not seen. Counts of words, classes and their sizes cover all training rows
without a cap, so what is gathered grows with the corpus; only the states' tables have a fixed size.

Baum-Welch: each task runs the forward and backward recursions over its texts and adds up expected counts as
whole numbers of 2^-16, Spark sums them over tasks (whatever the order, and again after a lost executor, the
sum is the same), the driver divides. The first WARM_ROUNDS rounds go through all training texts once, by turns
(incremental EM): each takes the texts of its share of their hashes, cut into pieces of PIECE tokens so that long
ones don't go on alone, and divides the counts of all that have had their turn. Then ROUNDS rounds run over all
training texts, whole. The score is the exact likelihood of the whole text by the forward recursion, scaled at
every few words.

Words meet their counts in two ways that give the same sums: those with a share of 1 / LISTED of all tokens or
more are a list of LISTED entries at most that is sent to tasks; all rarer ones are joined, at one row for each
distinct word of a text. None of these is in more than a 1 / LISTED share of the tokens, so no key is hot.

Null and empty texts are an end alone. Rows with a null id are training rows. Repeated rows count as often as
they occur and each gets its result; ties can't arise. Without training rows N and V are 0, every word is
unknown and classes are equally likely. Very long texts are scored whole. Columns of ``carry`` travel in one
struct, so no name clashes with what tasks use; one that is called like a result is replaced by it. A word is
known by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from strata.llm import hashing
from strata.llm.common import bounded_batches, chunks, keep, scratch_dir, table, text_buffers

STATES = 8
#: Words of 1 / OWN of the training tokens or more are classes of their own; the others share SHARED classes.
OWN, SHARED = 8192, 4096
#: Words of 1 / LISTED of all tokens or more are sent to tasks (28 bytes each), the others are joined.
LISTED = 1 << 20
END = OWN + SHARED
CLASSES = END + 1
#: Rounds that go through all training texts by turns, in pieces of so many tokens; then rounds over all of them.
WARM_ROUNDS, PIECE, ROUNDS = 24, 256, 3
#: Expected counts are summed in units of 1 / UNIT.
UNIT = 1 << 16
#: Tokens whose recursions a task runs at once (a longer text is run alone). Texts of more than LONG tokens run
#: with one another, so that the many positions that few texts reach are gone through once for all of them.
TOKENS, LONG = 1 << 20, 2048
#: Positions after which the recursions are scaled to a sum of 1, and cells whose emissions are looked up at once.
SCALED, SPAN = 4, 3 << 10
#: Bytes of text that are hashed at once (a longer text is hashed alone): arrays of 8 bytes for each stay below the
#: size at which a worker maps memory anew each time. Bytes of text whose words are then looked up or counted at once.
HASHED, LOOKED_UP = 3 << 13, 1 << 20
#: Words that a task gathers before equal ones become one; it hands them on when half as many are left.
GATHER = 1 << 20
RESULT = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
_LOWER = np.frombuffer(hashing.LOWER, dtype=np.uint8)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, shared class) of each word of the texts, and each text's first word (n + 1)."""
    found = [_words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, HASHED)]
    if len(found) == 1:
        return found[0]
    first = np.concatenate(([0], *(np.diff(x[3]) for x in found))).astype(np.int64)
    h1, h2, g = (np.concatenate([x[k] for x in found] or [np.zeros(0, dtype=np.int64)]) for k in range(3))
    return h1, h2, g, np.cumsum(first)


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[buf]
    starts, ends, first = hashing.words(low, offsets)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, first
    size = (ends - starts).astype(np.uint64)
    h = hashing.prefix(low)
    h1 = hashing.mix(hashing.spans(h, starts, ends) + size)
    h2 = hashing.mix(hashing.spans(hashing.prefix(low, hashing.BYTE2), starts, ends) + size)
    g = hashing.mix(hashing.spans(h, np.maximum(starts, ends - 3), ends)) % np.uint64(SHARED)
    return h1.view(np.int64), h2.view(np.int64), g.astype(np.int64), first


def _merged(h1, h2, *numbers):
    """Rows of one (h1, h2) become one; the first number is kept, others are summed."""
    if not len(h1):
        return (h1, h2, *numbers)
    met = pa.array(h1).dictionary_encode()
    code, once = met.indices.to_numpy(), met.dictionary.to_numpy()
    at = np.empty(len(once), dtype=np.int64)
    at[code] = np.arange(len(code))
    if np.array_equal(h2[at][code], h2):
        return (once, h2[at], numbers[0][at], *(np.bincount(code, weights=x, minlength=len(once)).astype(np.int64) for x in numbers[1:]))
    # different words with one h1
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    at = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    return (h1[at], h2[at], numbers[0][order][at], *(np.add.reduceat(x[order], at) for x in numbers[1:]))


@dataclass
class Listed:
    """What tasks know of words: the frequent ones, and the sizes of the shared classes."""

    h1: np.ndarray  # ascending, each once
    h2: np.ndarray
    count: np.ndarray  # in training tokens
    own: np.ndarray  # the word's own class, or -1
    tokens: np.ndarray  # training tokens of each class
    sizes: np.ndarray  # distinct words of each shared class in training tokens

    def finder(self) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function that gives the place of each (h1, h2) in the list, and whether it is there. The leading
        bits of h1 lead to the few entries that have them."""
        bits = max(len(self.h1).bit_length(), 1)
        key = lambda h: (h >> (64 - bits)) + (1 << (bits - 1))
        ends = np.cumsum(np.bincount(key(self.h1), minlength=1 << bits)).astype(np.int32)
        h1, h2 = np.append(self.h1, 0), np.append(self.h2, 0)

        def find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = key(a)
            end = ends[k]
            at = np.where(k > 0, ends[k - 1], 0)
            left = np.flatnonzero((at < end) & (h1[at] < a))
            while len(left):
                at[left] += 1
                left = left[(at[left] < end[left]) & (h1[at[left]] < a[left])]
            return at, (at < end) & (h1[at] == a) & (h2[at] == b)

        return find


@dataclass
class Vocabulary:
    counts: DataFrame  # (h1, h2, g, c, a): a word's tokens in training rows and in all rows
    n: int  # training tokens
    v: int  # distinct training tokens
    listed: Listed


def count_words(docs: DataFrame, train: Column, where: str, text: str = "text") -> Vocabulary:
    """Counts of all words of ``docs``, in the rows that ``train`` selects and in all."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(found: tuple) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in found], ["h1", "h2", "g", "c", "a"])

        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            mark = batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in chunks(off, LOOKED_UP):
                h1, h2, g, first = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                found = h1, h2, g, np.repeat(mark[i:j], np.diff(first)), np.ones(len(h1), dtype=np.int64)
                held.append(_merged(*found) if len(h1) > GATHER else found)
                if sum(len(x[0]) for x in held) > GATHER:
                    held = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > GATHER // 2:
                        yield from out(held.pop())
        if held:
            yield from out(_merged(*(np.concatenate(x) for x in zip(*held, strict=True))))

    rows = docs.select(F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    found = rows.mapInArrow(run, "h1 long, h2 long, g long, c long, a long")
    counts = keep(found.groupBy("h1", "h2").agg(F.min("g").alias("g"), F.sum("c").alias("c"), F.sum("a").alias("a")), where, "counts")
    ends = rows.agg(F.count_if("train"), F.count(F.lit(1))).first()
    known = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("a")).first()
    n, v, every = (known[0] or 0) + ends[0], known[1] + (ends[0] > 0), (known[2] or 0) + ends[1]
    own = F.col("c") * OWN >= F.lit(max(n, 1))
    frequent = counts.where((F.col("a") * LISTED >= F.lit(every)) | own).select("h1", "h2", "c", "g", own.alias("own")).toArrow()
    h1, h2, c, g, mine = (frequent.column(x).to_numpy() for x in ("h1", "h2", "c", "g", "own"))
    order = np.lexsort((h2, h1))
    h1, h2, c, g, mine = h1[order], h2[order], c[order], g[order], mine[order].astype(bool)
    one = np.append(True, h1[1:] != h1[:-1])[: len(h1)]  # of two with one h1, the second counts as rare
    h1, h2, c, g, mine = h1[one], h2[one], c[one], g[one], mine[one]
    classes = np.where(mine, np.cumsum(mine) - 1, -1)
    shared = np.array([tuple(r) for r in counts.where("c > 0").groupBy("g").agg(F.sum("c"), F.count(F.lit(1))).collect()], dtype=np.int64).reshape(-1, 3)
    tokens, sizes = np.zeros(CLASSES, dtype=np.int64), np.zeros(SHARED, dtype=np.int64)
    tokens[OWN + shared[:, 0]], sizes[shared[:, 0]] = shared[:, 1], shared[:, 2]
    np.subtract.at(tokens, OWN + g[mine], c[mine])
    np.subtract.at(sizes, g[mine], 1)
    tokens[classes[mine]] = c[mine]
    tokens[END] = ends[0]
    return Vocabulary(counts, n, v, Listed(h1, h2, c, classes, tokens, sizes))


def sequences(docs: DataFrame, vocabulary: Vocabulary, train: Column, where: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A written table of the texts as classes: (rid, carried, train, n_tokens, known, base, inside, ids, rare).

    ``ids`` holds a 16-bit class for each token. ``base`` and ``inside`` (log10 of what a word has in the
    base and within its class) lack the counts of the rare words, which are listed with their number in the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n, v, sent = vocabulary.n, vocabulary.v, spark.sparkContext.broadcast(vocabulary.listed)
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in (carry if carry is not None else [c for c in docs.columns if c != text]))).alias("carried"),
        F.coalesce(train, F.lit(True)).alias("train"), F.col(text).alias("text"))
    rare = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Listed = sent.value
        under = np.log10(n + v + 1)
        room = np.append(-np.log10(m.tokens[OWN:END] + m.sizes + 1.0), 0.0)
        find, counts, owns = m.finder(), np.append(m.count, 0), np.append(m.own, -1)
        gains = np.log10(counts + 1.0)
        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            for i, j in chunks(off, LOOKED_UP):
                h1, h2, g, first = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                doc = np.repeat(np.arange(j - i), np.diff(first))
                at, hit = find(h1, h2)
                at[~hit] = len(m.h1)  # the entry of words that aren't listed
                count, own, gain = counts[at], owns[at], gains[at]
                inside = np.where(own >= 0, 0.0, gain + room[g])
                add = lambda w, d=doc, k=j - i: np.bincount(d, weights=w, minlength=k)
                ids = np.full(len(h1) + j - i, END, dtype=np.uint16)  # words, and each text's end after them
                ids[np.arange(len(h1)) + doc] = np.where(own >= 0, own, OWN + g)
                ends = first + np.arange(j - i + 1)
                # distinct rare words of each text
                r1, r2, d = h1[~hit], h2[~hit], doc[~hit]
                order = np.lexsort((r2, r1, d))
                r1, r2, d = r1[order], r2[order], d[order]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]))[: len(d)])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(d[new], np.arange(j - i + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(r1[new]), pa.array(r2[new]), pa.array(np.diff(np.append(new, len(d))))], fields=list(rare)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("rid", "carried", "train")), pa.array(np.diff(first) + 1),
                     pa.array(np.bincount(doc[count > 0], minlength=j - i) + int(m.tokens[END] > 0)),
                     pa.array(add(gain - under) + np.log10(m.tokens[END] + 1) - under), pa.array(add(inside)),
                     pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), lists],
                    ["rid", "carried", "train", "n_tokens", "known", "base", "inside", "ids", "rare"])

    schema = base.drop("text").schema.add("n_tokens", "long").add("known", "long").add("base", "double").add("inside", "double").add("ids", "binary")
    out = base.mapInArrow(run, schema.add("rare", ArrayType(StructType().add("h1", "long").add("h2", "long").add("n", "long"))))
    return keep(out, where, "sequences")


@dataclass
class Model:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


class Lockstep:
    """Sequences of several lengths laid out by position, the longest first: at each position those that
    are so long are one block, and a recursion is one vectorised step for each position. Tables have a row
    for each state and a column for each cell. Scaling at every few positions gives the same numbers as at
    each one: between them, a probability falls by the few words that lie there."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # sequences at each position
        self.block = np.concatenate(([0], np.cumsum(self.active)))
        row = np.repeat(np.arange(len(size)), size)
        position = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        self.ids = np.empty(len(row), dtype=np.int64)
        self.ids[self.block[position] + row] = np.concatenate([sequences[k] for k in self.order])
        self.last = self.block[size - 1] + np.arange(len(size))  # the cell of each sequence's end
        self.scaled = np.concatenate(([0], np.cumsum(self.active[SCALED - 1 :: SCALED])))  # the sums of every SCALED-th position

    def spans(self) -> Iterator[tuple[int, int]]:
        """Runs (lo, hi) of positions, of about SPAN cells each."""
        lo = 0
        while lo < len(self.active):
            hi = max(int(np.searchsorted(self.block, self.block[lo] + SPAN, side="right")) - 1, lo + 1)
            yield lo, hi
            lo = hi

    def forward(self, m: Model, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 likelihood of each sequence, the sums that scaled positions are divided by, the sum of alpha
        in each sequence's last cell, the longest first); fills ``alpha`` (states, cells)."""
        emit, back, ones = m.emit.T.copy(), m.step.T.copy(), np.ones(len(m.start))
        found, end, scale, now = np.zeros(len(self.order)), np.empty(len(self.order)), np.empty(self.scaled[-1]), None
        for lo, hi in self.spans():
            first, cells, block = self.block[lo], slice(self.block[lo], self.block[hi]), (self.block[lo : hi + 1] - self.block[lo]).tolist()
            table = np.take(emit, self.ids[cells], axis=1)
            for t, a, b in zip(range(lo, hi), block[:-1], block[1:], strict=True):
                here = table[:, a:b]
                here *= m.start[:, None] if now is None else back @ now[:, : b - a]
                if t % SCALED == SCALED - 1:
                    total = ones @ here
                    here /= total
                    found[: b - a] += np.log10(total)
                    scale[self.scaled[t // SCALED] : self.scaled[t // SCALED + 1]] = total
                now = here
            over = np.flatnonzero((self.last >= first) & (self.last < cells.stop))
            end[over] = ones @ table[:, self.last[over] - first]
            if alpha is not None:
                alpha[:, cells] = table
        out = np.empty(len(self.order))
        out[self.order] = found + np.log10(end)
        return out, scale, end


def expected(sequences: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions of the sequences under a model, and their log10 likelihood."""
    s = Lockstep(sequences)
    k = len(m.start)
    gamma = np.empty((k, len(s.ids)))  # alpha, until it is multiplied by beta
    found, scale, end = s.forward(m, gamma)
    emit, met, after = m.emit.T.copy(), np.zeros((k, k)), np.zeros((k, 0))
    for lo, hi in reversed(list(s.spans())):
        first, cells, block = s.block[lo], slice(s.block[lo], s.block[hi]), (s.block[lo : hi + 1] - s.block[lo]).tolist()
        ahead = np.take(emit, s.ids[cells], axis=1)
        beta = np.empty_like(ahead)
        over = np.flatnonzero((s.last >= first) & (s.last < cells.stop))
        beta[:, s.last[over] - first] = 1 / end[over]
        for t, a, b in zip(range(hi - 1, lo - 1, -1), block[-2::-1], block[:0:-1], strict=True):
            beta[:, a : a + after.shape[1]] = after  # the sequences that go on
            here = ahead[:, a:b]
            here *= beta[:, a:b]
            if t % SCALED == SCALED - 1:
                here /= scale[s.scaled[t // SCALED] : s.scaled[t // SCALED + 1]]
            after = m.step @ here
        start = max(lo, 1)
        before = np.arange(s.block[start], cells.stop) - np.repeat(s.active[start - 1 : hi - 1], s.active[start:hi])
        met += np.take(gamma, before, axis=1) @ ahead[:, s.block[start] - first :].T
        gamma[:, cells] *= beta
    emits = np.stack([np.bincount(s.ids, weights=x, minlength=CLASSES) for x in gamma], axis=1)
    return gamma[:, : s.active[0]].sum(axis=1), met * m.step, emits, float(found.sum())


def grouped(sequences: Iterable[np.ndarray], limit: int = TOKENS) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Sequences of about ``limit`` tokens together, and their numbers; those of more than LONG tokens by themselves."""
    held: dict[bool, tuple[list[int], list[np.ndarray]]] = {}
    total = {True: 0, False: 0}
    for i, s in enumerate(sequences):
        long = len(s) > LONG
        if long in held and total[long] + len(s) > limit:
            yield held.pop(long)
            total[long] = 0
        numbers, group = held.setdefault(long, ([], []))
        numbers.append(i)
        group.append(s)
        total[long] += len(s)
    yield from held.values()


def maximised(starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    """Probabilities from expected counts; each state also gets one token dealt out by the classes' shares."""
    start, step, emit = starts + 0.1, steps + 0.1, emits + share[:, None]
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(share: np.ndarray, states: int) -> Model:
    """States that rather stay, and differ at random (in a fixed way) in what they emit."""
    emit = share[:, None] * np.random.default_rng(11).gamma(2.0, size=(CLASSES, states))
    return Model(np.full(states, 1 / states), np.eye(states) * 0.9 + 0.1 / states, emit / emit.sum(axis=0))


def baum_welch(sequences: DataFrame, vocabulary: Vocabulary, states: int = STATES, warm_rounds: int = WARM_ROUNDS, rounds: int = ROUNDS, log: list | None = None) -> Model:
    """Fit on the training rows of ``sequences``. ``log`` gets the log10 likelihood before each full round."""
    spark = sequences.sparkSession
    train = sequences.where("train").select("ids")
    share = (vocabulary.listed.tokens + 1.0) / (vocabulary.listed.tokens.sum() + CLASSES)
    m = first_model(share, states)
    if not vocabulary.n:
        return m
    names = [f"s{z}" for z in range(states)]
    schema = ", ".join(["cell long", *(f"{x} long" for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = sent.value, None
        texts = (np.frombuffer(x, dtype=np.uint16) for batch in batches for x in batch.column("ids").to_pylist())
        for _, group in grouped(s[i : i + piece] for s in texts for i in range(0, len(s), piece)) if piece else grouped(texts):
            starts, steps, emits, likelihood = expected(group, model)
            last = np.zeros((1, states))
            last[0, 0] = likelihood
            rows = np.concatenate((emits, steps, starts[None], last))
            total = rows if total is None else total + rows
        if total is not None:
            whole = np.rint(total * UNIT).astype(np.int64)
            cells = np.flatnonzero(whole.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(whole[cells, z]) for z in range(states))], ["cell", *names])

    def counted(rows: DataFrame) -> np.ndarray:
        """Expected counts of texts under ``m``, a row for each cell, and their log10 likelihood in the last row."""
        found = rows.mapInArrow(run, schema).groupBy("cell").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
        total = np.zeros((CLASSES + states + 2, states))
        total[found.column("cell").to_numpy()] = np.stack([found.column(x).to_numpy() for x in names], axis=1) / UNIT
        return total

    so_far = np.zeros((CLASSES + states + 2, states))
    for k in range(warm_rounds + rounds):
        sent, piece = spark.sparkContext.broadcast(m), PIECE if k < warm_rounds else 0
        if piece:
            so_far += counted(train.where(F.pmod(F.xxhash64("ids"), F.lit(warm_rounds)) == k))
            total = so_far
        else:
            total = counted(train)
            if log is not None:
                log.append(float(total[CLASSES + states + 1, 0]))
        if total.any():  # with few texts, nothing may have been counted yet
            m = maximised(total[CLASSES + states], total[CLASSES : CLASSES + states], total[:CLASSES], share)
        sent.unpersist()
    return m


def score(sequences: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """The carried columns, n_tokens, n_known (tokens with a training count), train_tokens (long),
    base_score (add-one unigram) and score (log10 of the probability of the whole text)."""
    spark = sequences.sparkSession
    sent = spark.sparkContext.broadcast(model)
    carried = sequences.select("rid", "carried", "n_tokens", "known", "base", "inside", "ids")
    kept = carried.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for numbers, group in grouped(np.frombuffer(x, dtype=np.uint16) for x in batch.column("ids").to_pylist()):
                found[numbers] = Lockstep(group).forward(m)[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, "path"])

    scored = carried.mapInArrow(run, carried.select(*kept).schema.add("path", "double"))
    rare = sequences.select("rid", F.explode("rare").alias("r")).select("rid", "r.*").join(vocabulary.counts.select("h1", "h2", "c"), ["h1", "h2"])
    rare = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("met"))
    gain, met = F.coalesce("gain", F.lit(0.0)), F.coalesce("met", F.lit(0))
    results = [F.col("n_tokens"), (F.col("known") + met).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("path") + F.col("inside") + gain).alias("score")]
    return scored.join(rare, "rid", "left").select(*(F.col(f"carried.`{c}`") for c in carried.schema["carried"].dataType.names if c not in RESULT), *results)


def language_model(docs: DataFrame, train: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Learn from the rows that ``train`` selects (null: they count as training rows), score all."""
    where = scratch_dir(docs.sparkSession)
    vocabulary = count_words(docs, train, where, text)
    found = sequences(docs, vocabulary, train, where, text, carry)
    return score(found, vocabulary, baum_welch(found, vocabulary))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    return language_model(docs, ~F.col("held_out"), carry=["doc_id", "held_out"]).select("doc_id", "held_out", *RESULT)
