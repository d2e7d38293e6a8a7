"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of an item is a seed. Training texts meet items by a join on seeds; a bitmap of fixed
size keeps n-grams that are certainly no seed out of it. Around each meeting point, the passage of the text is
aligned with the item, word by word, so that edited and paraphrased copies score too: a match gives 2, a
replaced, missing or added word costs 1, and the score is the share of what the whole item would give.

A passage reaches as far as any alignment through its seed that has the least score, and it is left out
only if too few of the item's words occur in it for that score. So each alignment of the least score
that keeps n words of the item in a row is found; one that keeps no n in a row is not. Equal texts are
aligned once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import hashing
from strata.llm.common import apart, bounded_batches, chunks, keep, release, scratch_dir, table, text_buffers, text_hashes

GRAM = 3
MIN_SCORE = 0.5
MATCH, COST = 2, 1
#: Bits of the bitmap of seeds (8 MB), whatever their number; where it is crowded, the join has more rows.
BITS = 1 << 26
#: Cells of one alignment step, and words of passages that are counted together.
CELLS, ROWS = 1 << 18, 1 << 18
#: Texts that a task remembers, so that copies of them are looked up once.
SEEN = 1 << 17
#: A-Z as a-z, every other ASCII byte that is no letter or digit as a space.
_PLAIN = np.array([c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], dtype=np.uint8)


def word_ids(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's first word (n + 1)."""
    low = _PLAIN[buf]
    wide = np.flatnonzero(low[:-1] == 0xC3) + 1
    upper = wide[(low[wide] >= 0x80) & (low[wide] <= 0x9E) & (low[wide] != 0x97)]
    low[upper] += 0x20
    starts, ends, first = hashing.words(low, offsets)
    return hashing.word_hashes(low, starts, ends), first


def grams_at(words: np.ndarray, first: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, text, place in it) of all texts."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(words) < gram:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    at = np.flatnonzero(doc[gram - 1 :] == doc[: len(doc) - gram + 1])
    return hashing.grams(words, gram)[at], doc[at], at - first[doc[at]]


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences, and the last word of b in the alignment.

    A row of all matrices is a step; within it, gaps in b are a running maximum.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    n, wa, wb = len(a), int(la.max(initial=0)), int(lb.max(initial=0))
    A, B = np.zeros((n, wa), dtype=np.uint64), np.ones((n, wb), dtype=np.uint64)
    for i in range(n):
        A[i, : la[i]], B[i, : lb[i]] = a[i], b[i]
    inside = np.arange(wb) < lb[:, None]
    slope = np.arange(wb, dtype=np.int32) * COST
    h = np.zeros((n, wb), dtype=np.int32)
    best, last = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(wa):
        step = np.where((A[:, i : i + 1] == B) & inside, MATCH, -COST).astype(np.int32)
        t = np.maximum(h - COST, 0)
        step[:, 1:] += h[:, :-1]
        t = np.maximum(t, step)
        h = np.maximum.accumulate(t + slope, axis=1) - slope
        h[i >= la] = 0
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        better = value > best
        best[better], last[better] = value[better], top[better]
    return best, last


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(which part, value) of all values."""
    return np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def able(items: list[np.ndarray], passages: list[np.ndarray], min_score: float) -> np.ndarray:
    """Passages that hold enough of their item's words for ``min_score``."""
    out, k = np.zeros(len(items), dtype=bool), 0
    total = np.append(0, np.cumsum([len(x) + len(y) for x, y in zip(items, passages, strict=True)]))
    while k < len(items):
        e = max(int(np.searchsorted(total, total[k] + ROWS, side="right")) - 1, k + 1)
        (which, own), (where, words) = _flat(items[k:e]), _flat(passages[k:e])
        key = lambda i, w: w + i.astype(np.uint64) * np.uint64(hashing.BASE)
        held = np.isin(key(which, own), key(where, words))
        size = np.array([len(x) for x in items[k:e]])
        out[k:e] = np.bincount(which, weights=held, minlength=e - k) >= min_score * size - 1e-9
        k = e
    return out


def passages(item: np.ndarray, size: np.ndarray, start: np.ndarray, n: int, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the item, begin, end) of the passages of a text of n words. ``start``: where a seed places its
    item, of ``size`` words; places of one item that are about equal are one passage."""
    order = np.lexsort((start, item))
    item, size, start = item[order], size[order], start[order]
    near = (item[1:] == item[:-1]) & (start[1:] - start[:-1] <= np.maximum(size[1:] // 2, 8))
    head = np.flatnonzero(np.append(True, ~near)) if len(item) else np.zeros(0, dtype=np.int64)
    tail = np.append(head[1:], len(item)) - 1 if len(item) else head
    # as many words can be added at most, all on one side of the hit
    pad = np.maximum(np.ceil(MATCH * (1 - min_score) / COST * size[head]).astype(np.int64), 8)
    return order[head], np.maximum(start[head] - pad, 0), np.minimum(start[tail] + size[head] + pad, n)


def align_all(items: list[np.ndarray], texts: list[np.ndarray], min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, last word of the passage) of the pairs from ``min_score`` on."""
    rows = np.flatnonzero(able(items, texts, min_score))
    kept, shares, ends, k = [], [], [], 0
    while k < len(rows):
        e, a, b = k, 0, 0
        while e < len(rows):
            a, b = max(a, len(items[rows[e]])), max(b, len(texts[rows[e]]))
            if e > k and (e - k + 1) * (a + b) > CELLS:
                break
            e += 1
        own = rows[k:e]
        score, last = align([items[r] for r in own], [texts[r] for r in own])
        share = score / (MATCH * np.maximum([len(items[r]) for r in own], 1))
        ok = share >= min_score
        kept.append(own[ok])
        shares.append(share[ok])
        ends.append(last[ok])
        k = e
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(kept), np.concatenate(shares), np.concatenate(ends)) if kept else (none, none.astype(float), none)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


_SEEDS, _WORDS, _HITS = "seed long, item long, place int, size int", "item long, own binary", "seed long, t1 long, t2 long, pos int"
_PASSAGES, _FOUND = "t1 long, t2 long, item long, begin int, words binary", "t1 long, t2 long, item long, score double, last long"


def _each(batch: pa.RecordBatch):
    buf, off = text_buffers(batch.column("text"))
    for i, j in chunks(off):
        yield i, j, *word_ids(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def _seeds(gram: int):
    def run(batches):
        for batch in batches:
            item = batch.column("item").to_numpy()
            for i, _, words, first in _each(batch):
                g, doc, place = grams_at(words, first, gram)
                yield _batch([g.view(np.int64), item[i + doc], place.astype(np.int32), np.diff(first)[doc].astype(np.int32)], _SEEDS)

    return run


def _item_words(batches):
    for batch in batches:
        item = batch.column("item").to_numpy()
        for i, j, words, first in _each(batch):
            yield _batch([item[i:j], pa.array([words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], _WORDS)


def _hits(gram: int, sent):
    def run(batches):
        seen: set = set()
        for batch in batches:
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for i, j, words, first in _each(batch):
                fresh = np.zeros(j - i, dtype=bool)
                for d in range(i, j):
                    if (t1[d], t2[d]) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add((t1[d], t2[d]))
                        fresh[d - i] = True
                g, doc, place = grams_at(words, first, gram)
                bit = g & np.uint64(BITS - 1)
                hit = np.flatnonzero((sent.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0) & fresh[doc])
                yield _batch([g[hit].view(np.int64), t1[i + doc[hit]], t2[i + doc[hit]], place[hit].astype(np.int32)], _HITS)

    return run


def _passages(min_score: float):
    def run(batches):
        for batch in batches:
            t1, t2, met = batch.column("t1").to_numpy(), batch.column("t2").to_numpy(), batch.column("met")
            flat, ends = met.flatten(), met.offsets.to_numpy() - met.offsets.to_numpy()[0]
            item, size, start = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("item", "size", "start"))
            for i, j, words, first in _each(batch):
                for d in range(i, j):
                    s, own = slice(ends[d], ends[d + 1]), words[first[d - i] : first[d - i + 1]]
                    row, begin, end = passages(item[s], size[s], start[s], len(own), min_score)
                    for k in range(0, len(row), 4096):
                        e = slice(k, k + 4096)
                        texts = pa.array([own[a:b].tobytes() for a, b in zip(begin[e], end[e], strict=True)], pa.binary())
                        n = len(row[e])
                        yield _batch([np.full(n, t1[d]), np.full(n, t2[d]), item[s][row[e]], begin[e].astype(np.int32), texts], _PASSAGES)

    return run


def _aligned(min_score: float):
    def run(batches):
        for batch in batches:
            ids = lambda c: [np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()]
            row, score, last = align_all(ids("own"), ids("words"), min_score)
            column = lambda c: batch.column(c).to_numpy()[row]
            yield _batch([column("t1"), column("t2"), column("item"), score, column("begin") + last], _FOUND)

    return run


@apart(["leaks"], "text")
def mark_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", gram: int = GRAM, min_score: float = MIN_SCORE) -> DataFrame:
    """All columns of ``docs`` and ``leaks``: an array of (item_id, score, last_word), empty where clean.

    Null and empty texts have no leaks; null and empty items and items of fewer words than ``gram`` are
    never found. Repeated rows are documents of their own, items of equal id are items of their own. A
    column named ``leaks`` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    where, kind = scratch_dir(spark), items.schema[item_key].dataType.simpleString()
    known = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    known = keep(known.withColumn("item", F.monotonically_increasing_id()), where, "items")
    seeds = keep(known.select("item", "text").mapInArrow(_seeds(gram), _SEEDS), where, "seeds")
    # BITS / 64 rows at most
    word, bit = F.shiftright(F.col("seed").bitwiseAND(BITS - 1), 6).alias("w"), F.expr("shiftleft(1L, cast(seed & 63 as int))")
    found = seeds.groupBy(word).agg(F.bit_or(bit).alias("v")).toArrow()
    bits = np.zeros(BITS // 64, dtype=np.int64)
    bits[found.column("w").to_numpy()] = found.column("v").to_numpy()
    sent = spark.sparkContext.broadcast(bits.view(np.uint8))
    out = docs.drop("leaks")
    texts = out.select(F.col(text).alias("text"), *text_hashes(F.col(text))).where("text is not null")
    hits = texts.mapInArrow(_hits(gram, sent), _HITS)
    met = hits.join(seeds, "seed").select("t1", "t2", "item", "size", (F.col("pos") - F.col("place")).alias("start")).distinct()
    met = keep(met, where, "met")
    lists = met.groupBy("t1", "t2").agg(F.collect_list(F.struct("item", "size", "start")).alias("met"))
    # a task keeps one of equal texts before any is shuffled
    held = texts.dropDuplicates(["t1", "t2"]).join(lists, ["t1", "t2"])
    parts = held.select("t1", "t2", "met", "text").mapInArrow(_passages(min_score), _PASSAGES)
    own = keep(known.select("item", "text").mapInArrow(_item_words, _WORDS), where, "words")
    aligned = parts.join(own, "item").select("t1", "t2", "item", "begin", "words", "own").mapInArrow(_aligned(min_score), _FOUND)
    best = aligned.groupBy("t1", "t2", "item").agg(F.max(F.struct("score", (-F.col("last")).alias("m"))).alias("b"))
    leaks = best.join(known.select("item", "item_id"), "item").select("t1", "t2", F.struct("item_id", "b.score", (-F.col("b.m")).alias("last_word")).alias("l"))
    leaks = keep(leaks.groupBy("t1", "t2").agg(F.sort_array(F.collect_list("l")).alias("_leaks")), where, "leaks")
    for name in ("seeds", "met", "words", "items"):
        release(spark, f"{where}/{name}")
    names = out.columns
    h1, h2 = text_hashes(F.col(text))
    leaks = leaks.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_leaks")
    empty = F.array().cast(f"array<struct<item_id:{kind},score:double,last_word:bigint>>")
    joined = out.withColumns({"_h1": h1, "_h2": h2}).join(leaks, (F.col("_h1") == F.col("_t1")) & (F.col("_h2") == F.col("_t2")), "left")
    return joined.select(*[F.col(f"`{n}`") for n in names], F.coalesce("_leaks", empty).alias("leaks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.score", "l.last_word")
