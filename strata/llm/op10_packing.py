"""Sequence packing as vector bin packing.

An example has three sizes: tokens, segments and loss-bearing tokens. Bins have a limit on each, and
the dot-product heuristic decides: into the open bin goes the fitting example whose sizes, as shares
of the limits, have the largest dot product with the room that is left.

A bin that the heuristic can't fill is topped up with a part of another piece, as documents may be cut
anywhere; one that the segment or loss limit closes is cut into sequences of a power of two, which need
no padding, and so is the last one of a task.

Packing happens within each task over a bounded pool, so nothing is shuffled; ids of sequences hold
the partition, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import bounded_batches, table

LIMIT_TOKENS = 2048
#: Pieces of one sequence.
LIMIT_SEGMENTS = 256
#: Loss-bearing tokens of one sequence; a document's first token is no target. For plain documents, a lower limit
#: would only make padding, since nearly all of their tokens bear loss.
LIMIT_LOSS = 2048
#: Limits for instruction data, where only answers bear loss.
TURN_SEGMENTS, TURN_LOSS, TURN_ROLE = 64, 1024, "assistant"
#: Pieces waiting in a task's pool, at most; each is shorter than a sequence.
POOL = 2048
END_ID = 1
_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def pack_vectors(sizes: np.ndarray, limits: Iterable[int], keep_open: float | None = None) -> tuple[list[list[int]], list[int]]:
    """Pack rows of ``sizes`` (n, d) into bins of ``limits`` (d); returns bins of row numbers.

    Each bin is opened with the example of the largest total share, then filled with the fitting one
    of the largest dot product of shares and room left, until none fits. Ties: the lowest number. With
    ``keep_open``, bins filled to less than that share in every dimension are not closed: their rows
    are returned as left over. A row over a limit raises ValueError; no rows: no bins.
    """
    limit = np.asarray(list(limits), dtype=np.float64)
    sizes = np.asarray(sizes, dtype=np.float64).reshape(-1, len(limit))
    if (sizes > limit).any():
        raise ValueError("an example is over a limit")
    # Equal vectors are one class with a list of members: the heuristic scans classes.
    shares, which, counts = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(counts)
    members = [list(order[e - c : e][::-1]) for e, c in zip(ends, counts, strict=True)]
    left, scaled = counts.copy(), shares / limit
    total, bins, rest, n = scaled.sum(axis=1), [], [], len(sizes)
    while n:
        room, own = limit.copy(), []
        score = np.where(left > 0, total, -1.0)
        while True:
            k = int(np.argmax(score))
            if score[k] < 0:
                break
            own.append(int(members[k].pop()))
            left[k] -= 1
            n -= 1
            room -= shares[k]
            fits = (left > 0) & (shares <= room).all(axis=1)
            score = np.where(fits, scaled @ (room / limit), -1.0)
        if keep_open is not None and ((limit - room) / limit).max() < keep_open:
            rest += own
        else:
            bins.append(own)
    return bins, rest


def binary_cuts(n: int, limit: int) -> list[int]:
    """n as lengths that need no padding: full ones, then powers of two, falling."""
    out = [limit] * (n // limit)
    return out + [1 << b for b in reversed(range(limit.bit_length())) if (n % limit) >> b & 1]


class Packer:
    """Cuts documents into pieces and yields (doc, start, ids, doc_tokens, sequence, offset, loss-bearing tokens)."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, pool: int):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits: 1 at least")
        self.next, self.tokens, self.limits, self.size, self.pool = first_id, tokens, (tokens, segments, loss), pool, []

    def add(self, doc, ids: np.ndarray, bears: np.ndarray) -> Iterator[tuple]:
        """Full pieces are sequences at once; the rest waits in the pool. ``bears``: which tokens bear loss."""
        n, run = len(ids), np.append(0, np.cumsum(bears))
        s = 0
        while s < n:
            e = min(s + self.tokens, n, int(np.searchsorted(run, run[s] + self.limits[2], side="right")) - 1)
            piece = (doc, s, ids[s:e], n, bears[s:e])
            if e - s == self.tokens:
                yield from self._close([piece])
            else:
                self.pool.append((doc, s, ids[s:e].copy(), n, bears[s:e].copy()))
            s = e
        if len(self.pool) >= self.size:
            yield from self._pack()

    def _sizes(self, pieces: list[tuple]) -> np.ndarray:
        return np.array([(len(p[2]), 1, int(p[4].sum())) for p in pieces], dtype=np.int64).reshape(-1, 3)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, n, bears in pieces:
            yield doc, start, ids, n, self.next, at, int(bears.sum())
            at += len(ids)
        self.next += 1

    def _split(self, piece: tuple, k: int) -> tuple[tuple, tuple]:
        doc, start, ids, n, bears = piece
        return (doc, start, ids[:k], n, bears[:k]), (doc, start + k, ids[k:], n, bears[k:])

    def _top_up(self, own: list[tuple], donors: list[tuple]) -> None:
        """Fill ``own`` from the last of ``donors``, as far as the limits allow."""
        sums = self._sizes(own).sum(axis=0)
        while donors and sums[0] < self.tokens and sums[1] < self.limits[1]:
            piece = donors.pop()
            run = np.cumsum(piece[4])
            k = min(self.tokens - sums[0], int(np.searchsorted(run, self.limits[2] - sums[2], side="right")))
            if k <= 0:
                donors.append(piece)
                return
            take, left = self._split(piece, int(k)) if k < len(piece[2]) else (piece, None)
            if left is not None:
                donors.append(left)
            own.append(take)
            sums = sums + (len(take[2]), 1, int(take[4].sum()))

    def _end(self, own: list[tuple]) -> Iterator[tuple]:
        """A full bin is a sequence; any other one is cut into powers of two, which need no padding."""
        pieces = list(own)
        for length in binary_cuts(sum(len(p[2]) for p in pieces), self.tokens):
            out, need = [], length
            while need:
                piece = pieces.pop(0)
                if len(piece[2]) > need:
                    piece, left = self._split(piece, need)
                    pieces.insert(0, left)
                out.append(piece)
                need -= len(piece[2])
            yield from self._close(out)

    def _pack(self) -> Iterator[tuple]:
        bins, rest = pack_vectors(self._sizes(self.pool), self.limits, 0.97)
        if len(rest) > self.size // 2:  # a pool of odd sizes: close what there is
            bins, rest = pack_vectors(self._sizes(self.pool), self.limits)
        full = [[self.pool[i] for i in b] for b in bins]
        donors = sorted((self.pool[i] for i in rest), key=lambda p: len(p[2]))
        if not donors and full:  # the emptiest bin waits
            donors = full.pop(min(range(len(full)), key=lambda i: sum(len(p[2]) for p in full[i])))
        for own in full:
            self._top_up(own, donors)
            yield from self._end(own)
        self.pool = donors

    def finish(self) -> Iterator[tuple]:
        """The fullest bins are topped up with the pieces of the emptiest ones."""
        bins, _ = pack_vectors(self._sizes(self.pool), self.limits)
        left = sorted(([self.pool[i] for i in b] for b in bins), key=lambda b: sum(len(p[2]) for p in b))
        donors: list[tuple] = []
        while left:
            own = left.pop()
            while True:
                self._top_up(own, donors)
                if donors or not left or sum(len(p[2]) for p in own) == self.tokens or len(own) >= self.limits[1]:
                    break
                donors = sorted(left.pop(0), key=lambda p: len(p[2]))
            yield from self._end(own)
            if donors and not left:
                again, _ = pack_vectors(self._sizes(donors), self.limits)
                left, donors = [[donors[i] for i in b] for b in again], []
        self.pool = []


def tokenizer(path: str, ranks_path: str | None = None) -> Callable[[str], np.ndarray]:
    """Encoder of the byte-level vocabulary at ``path``. ``ranks_path``: the same vocabulary as ranks,
    which is encoded four times as fast to the same ids."""
    if ranks_path is None:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # some 10^6 characters of white space in a row are too many for its pattern
            if not slow:
                slow.append(tokenizer(path))
            return slow[0](text)

    return encode


def pack_examples(rows: DataFrame, keys: list[str], path: str, ranks_path: str | None = None, end_id: int = END_ID, tokens: int = LIMIT_TOKENS, segments: int = LIMIT_SEGMENTS, loss: int = LIMIT_LOSS, pool: int = POOL) -> DataFrame:
    """One row for each piece of every row of ``rows`` (``keys``, which are long, text, bears): the keys, start,
    length, ids_crc32, doc_tokens, sequence_id, offset and loss_tokens.

    An example is its ids and ``end_id``; null and empty texts are ``end_id`` alone. If ``bears``, all of its
    tokens but the first bear loss, else none do; null is false. Rows with equal keys are examples of their
    own. Every id lies in exactly one piece. A sequence has ``tokens`` ids or a power of two. No rows: no pieces.
    """
    bounded_batches(rows.sparkSession)
    names = [*keys, *_COLUMNS]

    def run(batches):
        from pyspark import TaskContext

        encode = tokenizer(path, ranks_path)
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss, pool)
        out: list[tuple] = []

        def flush(some=8192):
            nonlocal out
            if len(out) >= some:
                columns = list(zip(*out, strict=True))
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def put(pieces):
            out.extend((*key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, seq, at, own) for key, start, ids, n, seq, at, own in pieces)

        for batch in batches:
            bears = batch.column("bears").to_pylist()
            for key, text, of in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("text"), bears, strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype(np.uint32)
                put(packer.add(key, ids, np.arange(len(ids)) > 0 if of else np.zeros(len(ids), dtype=bool)))
                yield from flush()
        put(packer.finish())
        yield from flush(1)

    return rows.select(*keys, "text", "bears").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _production() -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def pack(docs: DataFrame) -> DataFrame:
    """Plain documents (doc_id, text) with the production vocabulary and limits: all of a document bears loss."""
    return pack_examples(docs.select("doc_id", "text", F.lit(True).alias("bears")), ["doc_id"], **_production())


def pack_turns(conversations: DataFrame, segments: int = TURN_SEGMENTS, loss: int = TURN_LOSS, role: str = TURN_ROLE) -> DataFrame:
    """Instruction data (conv_id, turn, role, text) with the production vocabulary: each turn is an example,
    and only those of ``role`` bear loss."""
    rows = conversations.select("conv_id", "turn", "text", (F.col("role") == role).alias("bears"))
    return pack_examples(rows, ["conv_id", "turn"], segments=segments, loss=loss, **_production())
