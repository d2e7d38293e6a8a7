"""Exact substring dedup: every byte covered by a string of SPAN bytes that occurs elsewhere is removed.

Which strings can repeat is narrowed down first, then decided by a suffix sort:

1. Each window of SPAN bytes has an anchor: the first of its k-grams of the least hash. It depends on
   the window's bytes alone, so equal windows have equal anchors at equal offsets. Neighbouring windows
   with one anchor occurrence are a run; a run is a row.
2. Rows meet by anchor and run. Runs with equal bytes (128 bits of hash over at most 336 bytes) repeat as
   a whole; each task sends one row for each of them. Then different runs are counted by anchor, and one
   that is alone with its anchor ends there.
3. What is left, runs whose bytes differ although the anchor is shared, is suffix-sorted: rightwards
   from the anchor and leftwards on the reversed text, by mergesort. Two suffixes are compared by their
   common extension, which binary search finds on prefix polynomial hashes. For a window that begins d
   bytes before the anchor, the rows that share SPAN - d bytes to the right are a run of the first
   order, those that share d bytes to the left a run of the second; two rows in the same pair of runs
   have that window in common. Extensions of neighbours are verified byte by byte.
4. An anchor with over HOT different runs would be too much for one task. Its windows are rows of their
   own, which go the way of runs in step 2: equal ones (128 bits of hash) are joined within a task, which
   sends one of them, and meet in a sorted pass, without a join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import hashing
from strata.llm.common import apart, bounded_batches, chunks, keep, release, scratch_dir, table, text_buffers

SPAN = 200
KGRAM = 64
#: Bytes of a document that are hashed at once; longer documents are done in parts that overlap.
PART = 1 << 20
#: Rows of a task that are looked at together for equal runs, before the rest is sent.
LOCAL_ROWS = 1 << 19
#: Different runs of one anchor that are sorted together; beyond it, its windows are dealt out.
HOT = 512
#: Runs in question that are cut out at once, and those of hot anchors, which are up to 137 windows each.
CUT_ROWS, CUT_HOT = 4096, 512
_POSITION = np.uint64((1 << 24) - 1)
_DONE, _ONE, _MANY, _ASK, _SHOW = 0, 1, 2, 3, 4  # kinds of rows


def runs(buf: np.ndarray, offsets: np.ndarray, span: int, kgram: int):
    """(first window, last window, anchor, anchor hash, run hash) of every run; positions in buf."""
    n, width = len(buf), span - kgram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < span:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = hashing.prefix(buf)
    at = np.arange(n - kgram + 1)
    gram = hashing.mix(hashing.spans(h, at, at + kgram))
    least = (gram & ~_POSITION) | at.astype(np.uint64)
    done = 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - span + 1), -1)
    valid = np.cumsum(edge)[: len(least)] > 0
    change = least[1:] != least[:-1]
    lo = np.flatnonzero(valid & np.append(True, change | ~valid[:-1]))
    hi = np.flatnonzero(valid & np.append(change | ~valid[1:], True))
    anchor = (least[lo] & _POSITION).astype(np.int64)
    left, right = hashing.spans(h, lo, anchor), hashing.spans(h, anchor + kgram, hi + span)
    run = hashing.mix(hashing.mix(left + (anchor - lo).astype(np.uint64)) + right + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return lo, hi, anchor, gram[anchor], run


def parts(offsets: np.ndarray, span: int):
    """(first document, last document + 1, begin, end) of the pieces of text that are hashed at once."""
    for i, j in chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PART:
            yield i, j, a, b
        else:
            for s in range(a, max(b - span + 1, a + 1), PART):
                yield i, j, s, min(s + PART + span - 1, b)


def common(h: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the texts at i and j, at most ``most``: binary search on hashes."""
    lo, hi = np.zeros_like(most), most.copy()
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = hashing.spans(h, i, i + mid) == hashing.spans(h, j, j + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes text[start : start + length] within their groups, and the common extension
    of each with the one before it (0 for the first of a group). ``group`` is ascending.

    A bottom-up mergesort over all groups at once: an element's place in a merged run is its place in
    its own run and the number of smaller ones in the other, found by binary search.
    """
    n = len(starts)
    h = hashing.prefix(text)
    padded = np.append(text, np.uint8(0))

    def less(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Is suffix a before suffix b? Equal ones: ``ties``."""
        most = np.minimum(lengths[a], lengths[b])
        e = common(h, starts[a], starts[b], most)
        ends = e == most
        byte = padded[np.where(ends, n and len(text), starts[a] + e)] < padded[np.where(ends, len(text), starts[b] + e)]
        return np.where(ends, np.where(lengths[a] == lengths[b], ties, lengths[a] < lengths[b]), byte)

    order = np.arange(n)
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    place = np.arange(n) - first
    width = 1
    while width < size.max(initial=0):
        at = np.flatnonzero(size > width)  # places in groups that are not yet one run
        run = place[at] // width
        other = first[at] + (run ^ 1) * width
        end = np.minimum(other + width, first[at] + size[at])
        lo, hi = np.minimum(other, end), end.copy()
        begin = lo.copy()
        right = run % 2 == 1
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            # the other's element goes first if it is smaller, or equal and in the left run
            before = less(order[mid], order[at[open_]], right[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        target = first[at] + (run // 2) * 2 * width + place[at] % width + (lo - begin)
        moved = order.copy()
        moved[target] = order[at]
        order, width = moved, width * 2
    near = np.zeros(n, dtype=np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        near[1:] = np.where(group[1:] == group[:-1], common(h, starts[a], starts[b], np.minimum(lengths[a], lengths[b])), 0)
        if not np.array_equal(near, _verified(padded, starts, lengths, group, order)):
            # a collision: the order may be wrong too
            order = np.array(sorted(range(n), key=lambda r: (group[r], text[starts[r] : starts[r] + lengths[r]].tobytes())))
            near = _verified(padded, starts, lengths, group, order)
    return order, near


def _verified(padded: np.ndarray, starts, lengths, group, order) -> np.ndarray:
    """The common extensions of neighbours, by their bytes."""
    out = np.zeros(len(order), dtype=np.int64)
    for s in range(1, len(order), 4096):
        a, b = order[s - 1 : s + 4095], order[s : s + 4096]
        a = a[: len(b)]
        most = np.where(group[a] == group[b], np.minimum(lengths[a], lengths[b]), 0)
        k = np.arange(int(most.max(initial=0)))
        last = len(padded) - 1
        differ = padded[np.minimum(starts[a][:, None] + k, last)] != padded[np.minimum(starts[b][:, None] + k, last)]
        differ |= k >= most[:, None]
        differ = np.hstack([differ, np.ones((len(a), 1), dtype=bool)])
        out[s : s + 4096] = np.minimum(differ.argmax(axis=1), most)
    return out


def shared_windows(text: np.ndarray, begin: np.ndarray, length: np.ndarray, left: np.ndarray, group: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of every window of a row's bytes that another row of its group has at the same
    offset from the anchor. Row r is text[begin : begin + length], its anchor ``left`` bytes in."""
    n = len(begin)
    right_order, right_near = suffix_sort(text, begin + left, length - left, group)
    left_order, left_near = suffix_sort(text[::-1], len(text) - (begin + left), left, group)
    rows, windows = [], []
    last = length - span  # the last window of each row
    for d in range(max(0, int((left - last).min(initial=0))), int(left.max(initial=-1)) + 1):
        active = np.flatnonzero((left >= d) & (left - d <= last))
        if len(active) < 2:
            continue
        r, l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        r[right_order] = np.cumsum(right_near < span - d)
        l[left_order] = np.cumsum(left_near < d)
        pair = r[active] * (n + 1) + l[active]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = active[order[np.append(False, same) | np.append(same, False)]]
        rows.append(twice)
        windows.append(left[twice] - d)
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return np.concatenate(rows), np.concatenate(windows)


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join runs of windows lo..hi that follow each other in one document."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1))) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[new], lo[new], hi[np.append(new[1:], len(doc)) - 1] if len(doc) else hi


_ROW = ["kind", "anchor", "run", "key", "size", "lo", "hi", "at"]
_TYPES = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
_SCHEMA = "kind byte, anchor long, run long, key long, size int, lo int, hi int, at int"


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, _TYPES, strict=True)], _ROW)


def _joined_here(held: list[tuple], settled: np.ndarray | None = None):
    """Rows (key, size, lo, hi, at, anchor, run) of a task as batches: one of each anchor and run, _MANY if there
    are more or it is ``settled``, and _DONE what those that there are more of cover, sent on by its own key."""
    key, size, lo, hi, at, anchor, own = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((own, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (own[order][1:] == own[order][:-1])
    later, again = np.append(False, same), np.append(same, False)
    first, many = order[~later], (later | again)[~later]
    kind = np.where(many if settled is None else many | settled[first], _MANY, _ONE).astype(np.int8)
    yield _batch([kind, anchor[first].view(np.int64), own[first].view(np.int64), key[first], size[first], lo[first], hi[first], at[first]])
    dup = order[later | again]
    if len(dup):
        ids = np.unique(np.stack([key[dup], size[dup]]), axis=1, return_inverse=True)
        doc, a, b = _merge(ids[1].reshape(-1), lo[dup], hi[dup])
        k, s = ids[0][0][doc], ids[0][1][doc]
        zero = np.zeros(len(doc), dtype=np.int64)
        yield _batch([np.full(len(doc), _DONE, np.int8), k, zero, k, s, a, b, zero])


def _emit_runs(span: int, kgram: int):
    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            if held:
                yield from _joined_here(held)
            held, count = [], 0

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            buf, off = text_buffers(batch.column("text"))
            for i, j, a, b in parts(off, span):
                lo, hi, at, anchor, own = runs(buf[a:b], np.clip(off[i : j + 1], a, b) - a, span, kgram)
                doc = np.searchsorted(off, lo + a, side="right") - 1
                held.append((keys[doc], (off[doc + 1] - off[doc]), lo + a - off[doc], hi + a - off[doc], at + a - off[doc], anchor, own))
                count += len(lo)
                if count >= LOCAL_ROWS:
                    yield from flush()
        yield from flush()

    return run


def _settle(batches):
    """Rows arrive sorted by anchor and run. Equal runs are settled; of what is left, _ASK is a run in
    question, _SHOW one of each settled run, which may share windows with others of its anchor."""
    held: pa.Table | None = None
    opened = None  # an anchor and run of which rows have gone out already

    def out(c, rows, kind):
        return _batch([np.full(len(rows), kind, np.int8), *(c[n][rows] for n in _ROW[1:])])

    def settle(t: pa.Table):
        c = {n: t.column(n).to_numpy() for n in _ROW}
        done = c["kind"] == _DONE
        if done.any():
            yield out(c, np.flatnonzero(done), _DONE)
        at = np.flatnonzero(~done)
        if not len(at):
            return
        anchor, own, kind = c["anchor"][at], c["run"][at], c["kind"][at]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))
        which = np.cumsum(new) - 1
        many = np.bincount(which, weights=kind == _MANY) + np.bincount(which) > 1
        if opened == (anchor[0], own[0]):
            many[0], new[0] = True, False
        settled = many[which]
        yield out(c, at[settled & (kind == _ONE)], _DONE)
        yield out(c, at[~settled], _ASK)
        yield out(c, at[settled & new], _SHOW)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        anchor, own = held.column("anchor").to_numpy(), held.column("run").to_numpy()
        other = np.flatnonzero((anchor != anchor[-1]) | (own != own[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut == 0 and len(anchor) >= LOCAL_ROWS:  # one run all through
            cut = len(anchor)
        if cut:
            yield from settle(held.slice(0, cut))
            opened = (anchor[cut - 1], own[cut - 1])
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from settle(held)


_CUT = "anchor long, run long, kind byte, key long, size int, lo int, hi int, left int, bytes binary"


def _cut_out(span: int):
    """Bytes of the runs in question, and of hot anchors the windows as rows of two hashes (left is -1), those that
    are equal within a task as one."""

    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            if held:
                # a run that is shown has been settled, and its windows with it
                for b in _joined_here([x[:-1] for x in held], np.concatenate([x[-1] for x in held])):
                    columns = [b.column(n) for n in ("anchor", "run", "kind", "key", "size", "lo", "hi")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b.num_rows, -1, np.int32)), pa.nulls(b.num_rows, pa.binary())], names)
            held, count = [], 0

        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            asked = batch.column("asked")
            flat, ends = asked.flatten(), asked.offsets.to_numpy()
            c = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("kind", "anchor", "hot", "lo", "hi", "at")}
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            c = {n: v[: len(doc)] for n, v in c.items()}
            keys, sizes = batch.column("key").to_numpy(zero_copy_only=False), np.diff(off)

            for hot in (False, True):
                rows, most = np.flatnonzero(c["hot"] == hot), CUT_HOT if hot else CUT_ROWS
                for s in range(0, len(rows), most):
                    e = rows[s : s + most]
                    d, kind, anchor = doc[e], c["kind"][e], c["anchor"][e]
                    lo, hi, at = (c[n][e].astype(np.int64) for n in ("lo", "hi", "at"))
                    texts = [buf[off[q] + a : off[q] + b + span] for q, a, b in zip(d, lo, hi, strict=True)]
                    if not hot:
                        columns = [anchor, np.zeros(len(e), dtype=np.int64), kind.astype(np.int8), keys[d], *(x.astype(np.int32) for x in (sizes[d], lo, hi, at - lo))]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([x.tobytes() for x in texts], pa.binary())], names)
                        continue
                    whole, n = np.concatenate(texts), hi - lo + 1
                    begin = np.append(0, np.cumsum(n + span - 1))[:-1]
                    row = np.repeat(np.arange(len(e)), n)
                    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    first = begin[row] + step
                    one, two = (hashing.mix(hashing.spans(hashing.prefix(whole, t), first, first + span)) for t in (hashing.BYTE, hashing.BYTE2))
                    window = lo[row] + step
                    held.append((keys[d[row]], sizes[d[row]], window, window, np.zeros(len(row), dtype=np.int64), one, two, kind[row] == _SHOW))
                    count += len(row)
                    if count >= LOCAL_ROWS:
                        yield from flush()
        yield from flush()

    names = [x.split()[0] for x in _CUT.split(", ")]
    return run


def _sort_runs(span: int):
    """Rows arrive sorted by anchor; whole anchors, of HOT runs at most, are sorted together."""

    def block(t: pa.Table):
        buf, off = text_buffers(t.column("bytes"))
        anchor = t.column("anchor").to_numpy()
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))
        lo, left = t.column("lo").to_numpy().astype(np.int64), t.column("left").to_numpy().astype(np.int64)
        row, window = shared_windows(buf, off[:-1], np.diff(off), left, group, span)
        ask = t.column("kind").to_numpy()[row] == _ASK
        row, window = row[ask], window[ask]
        row, a, b = _merge(row, window + lo[row], window + lo[row])
        zero = np.zeros(len(row), dtype=np.int64)
        return _batch([np.full(len(row), _DONE, np.int8), zero, zero, t.column("key").to_numpy()[row], t.column("size").to_numpy()[row], a, b, zero])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 20_000:
                continue
            anchor = held.column("anchor").to_numpy()
            other = np.flatnonzero(anchor != anchor[-1])
            if len(other):
                yield block(held.slice(0, other[-1] + 1))
                held = held.slice(other[-1] + 1)
        if held is not None and held.num_rows:
            yield block(held)

    return run


def repeated_spans(keyed: DataFrame, span: int = SPAN, kgram: int = KGRAM, hot: int = HOT) -> DataFrame:
    """(key, size, lo, hi): the windows lo..hi of each text that occur elsewhere. ``keyed``: key, size, text."""
    spark, where = keyed.sparkSession, scratch_dir(keyed.sparkSession)
    rows = keyed.where(F.col("size") >= span).select("key", "text").mapInArrow(_emit_runs(span, kgram), _SCHEMA)
    settled = keep(rows.repartition("anchor", "run").sortWithinPartitions("anchor", "run").mapInArrow(_settle, _SCHEMA), where, "settled")
    done = keep(settled.where(F.col("kind") == _DONE).select("key", "size", "lo", "hi"), where, "done")
    left = settled.where(F.col("kind") != _DONE)
    shared = keep(left.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), where, "shared")
    left = left.join(shared, "anchor").withColumn("hot", F.col("n") > hot)
    asked = keep(left.groupBy("key", "size").agg(F.collect_list(F.struct("kind", "anchor", "hot", "lo", "hi", "at")).alias("asked")), where, "asked")
    release(spark, f"{where}/settled")
    # rows with one key and size are equal texts with one id: each asks, one is enough
    cut = keep(keyed.join(asked, ["key", "size"]).select("key", "text", "asked").mapInArrow(_cut_out(span), _CUT), where, "cut")
    release(spark, f"{where}/asked")
    sorted_ = cut.where("left >= 0").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_runs(span), _SCHEMA)
    found = keep(sorted_.select("key", "size", "lo", "hi"), where, "found")
    windows = cut.where("left < 0").select(*_ROW[:-1], F.lit(0).alias("at"))
    met = windows.where(F.col("kind") != _DONE).repartition("anchor", "run").sortWithinPartitions("anchor", "run").mapInArrow(_settle, _SCHEMA)
    spread = keep(windows.unionByName(met).where(F.col("kind") == _DONE).select("key", "size", "lo", "hi"), where, "spread")
    release(spark, f"{where}/cut")
    return done.unionByName(found).unionByName(spread)


@apart(["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed"], "text", "key")
def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, kgram: int = KGRAM) -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_removed, n_spans (long), kept_sha256 (string), kept_text
    (the bytes that stay, without characters that were cut in two), removed (array of begin and end).

    Null and empty texts have 0 bytes. Texts shorter than ``span`` lose nothing. Rows with equal ids
    are documents of their own: equal texts remove each other, whoever they belong to. Columns of these
    names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not 0 < kgram <= span <= 256:
        raise ValueError("0 < kgram <= span <= 256")
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed"]
    base = docs.drop(*out)
    names = base.columns
    own = {"_key": F.xxhash64(F.col(key).cast("string"), F.col(text)), "_size": F.coalesce(F.octet_length(text), F.lit(0)), "_text": F.col(text)}
    keyed = base.select(*(c.alias(n[1:]) for n, c in own.items()))
    spans = repeated_spans(keyed, span, kgram).groupBy("key", "size").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    joined = base.withColumns(own).join(spans.withColumnsRenamed({"key": "_key", "size": "_size"}), ["_key", "_size"], "left").select(*names, "_text", "_spans")

    def run(batches):
        for batch in batches:
            buf, off = text_buffers(batch.column("_text"))
            figures, texts, removed = [], [], []
            asked = batch.column("_spans")
            flat, ends = asked.flatten(), asked.offsets.to_numpy()
            lo, hi = flat.field("lo").to_numpy(zero_copy_only=False), flat.field("hi").to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            valid = asked.is_valid().to_numpy(zero_copy_only=False)
            for d in range(batch.num_rows):
                data = buf[off[d] : off[d + 1]]
                gone = np.zeros(len(data) + 1, dtype=np.int64)
                if valid[d] and ends[d + 1] > ends[d]:
                    np.add.at(gone, lo[ends[d] : ends[d + 1]], 1)
                    np.add.at(gone, hi[ends[d] : ends[d + 1]].astype(np.int64) + span, -1)
                cover = np.cumsum(gone)[: len(data)] > 0
                kept = data[~cover].tobytes()
                steps = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
                begin, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
                figures.append((len(data), int(cover.sum()), len(begin), hashlib.sha256(kept).hexdigest()))
                texts.append(kept.decode("utf-8", "ignore"))
                removed.append([{"begin": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)])
            columns = list(zip(*figures, strict=True)) if figures else [[]] * 4
            arrays = [pa.array(columns[i], pa.int64()) for i in range(3)] + [pa.array(columns[3], pa.string()), pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], [*names, *out])

    added = spark.createDataFrame([], "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, removed array<struct<begin:long,end:long>>").schema
    schema = base.schema
    for f in added:
        schema = schema.add(f)
    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
