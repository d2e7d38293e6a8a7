"""Jaccard join, substring dedup, decontamination, pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import common, hashing
from strata.llm import op4_jaccard as op4
from strata.llm import op5_substrings as op5
from strata.llm import op8_decontaminate as op8
from strata.llm.components import connected_components
from strata.storage import scratch_dir


def components_of(texts, percent=75):
    """Brute force: (set sizes, smallest reachable index)."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus(seed, n=120):
    """Groups of edited copies, passages that many texts share, short texts, texts of passages alone."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passages = [[word() for _ in range(rng.randint(6, 30))] for _ in range(4)]
    bases, out = [], []
    for _ in range(n):
        kind = rng.random()
        if bases and kind < 0.5:
            t = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
        elif kind < 0.65:
            t = sum(rng.sample(passages, rng.randint(1, 3)), [])
            if rng.random() < 0.5:
                t = t + [word() for _ in range(rng.randint(1, 3))]
        elif kind < 0.75:
            t = [rng.choice("ab") for _ in range(rng.randint(1, 7))]
        else:
            t = [word() for _ in range(rng.randint(8, 90))] + rng.choice([[], rng.choice(passages)])
            bases.append(t)
        out.append(" ".join(t).upper() if rng.random() < 0.1 else "  ".join(t))
    return out


@pytest.mark.parametrize("seed,few,percent", [(1, 32, 75), (2, 1, 75), (3, 2, 60)])
def test_jaccard_equals_brute_force(spark, seed, few, percent):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, comps = components_of(texts, percent)
    got = {r["id"]: (r["n"], r["component_id"]) for r in op4.near_duplicates(docs, few=few, percent=percent).collect()}
    assert got == {i: (sizes[i], comps[i]) for i in range(len(texts))}


def boilerplate(seed, n=36):
    """Sets that consist for the most part of passages that many share, with more or less of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    common = [[word() for _ in range(rng.choice([20, 30, 44]))] for _ in range(3)]
    out = []
    for _ in range(n):
        t = sum(rng.sample(common, rng.randint(1, 3)), [])
        t = t[rng.randint(0, 6) : len(t) - rng.randint(0, 6)]
        for _ in range(rng.randint(0, 12)):
            t.insert(rng.choice([0, len(t)]), word())
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed,few,bits", [(1, 1, 64), (3, 2, 3)])
def test_sets_of_common_shingles(spark, monkeypatch, seed, few, bits):
    """Prefixes are lengthened to the whole sets, whose costly shingles decide; with 3 bits, hashes clash."""
    monkeypatch.setattr(op4, "BLOCK", 16)
    ran = []
    alone = op4._Join.costly_alone
    monkeypatch.setattr(op4._Join, "costly_alone", lambda self, *c: (ran.append(1), alone(self, *c)))
    texts = boilerplate(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes, comps = components_of(texts)
    assert 3 < len(set(comps)) < 34
    got = {r["id"]: (r["n"], r["component_id"]) for r in op4.near_duplicates(docs, few=few, bits=bits).collect()}
    assert got == {i: (sizes[i], comps[i]) for i in range(len(texts))} and ran


def test_one_of_each(spark, edge, none):
    body, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))
    rows = [(5, body, 1), (5, body, 2), (5, "something else that is of the same id", 3), (None, near, 4), (None, near, 5), (7, near, 6), (8, "", 7), (8, "", 8), (None, None, 9), (9, "alone", 10), (3, "alone", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in op4.one_of_each(docs).collect())
    assert got == sorted([(5, body), (5, "something else that is of the same id"), (8, ""), (8, ""), (0, ""), (3, "alone")])
    assert op4.one_of_each(edge).columns == edge.columns and op4.one_of_each(none).count() == 0


def test_jaccard_edges(spark, edge, none):
    got = sorted(((r["id"], r["n"], r["component_id"]) for r in op4.near_duplicates(edge).collect()), key=str)
    assert Counter(r[0] for r in got) == Counter(r["doc_id"] for r in edge.collect())
    by = {r[0]: r for r in got}
    assert by[1] == (1, 0, 1) and by[3] == (3, 0, 3) and by[4] == by[4][:2] + (4,) and by[5][2] == 4 and by[6][2] == by[9][2] == 6 and by[8] == (8, 1, 8)
    assert sorted(r[1:] for r in got if r[0] is None) == [(0, None), (10, None)]
    assert op4.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        op4.near_duplicates(edge, percent=40)


def test_a_task_drops_the_powers_of_the_one_before(monkeypatch):
    class Task:
        id = 1
        get = classmethod(lambda cls: cls)
        taskAttemptId = classmethod(lambda cls: cls.id)  # noqa: N815

    monkeypatch.setattr(common, "TaskContext", Task)
    common.text_buffers(pa.array(["a"]))
    hashing.powers(1 << 20)
    common.text_buffers(pa.array(["a"]))
    assert hashing._powers["n"] > 1 << 20
    Task.id = 2
    common.text_buffers(pa.array(["a"]))
    assert hashing._powers == {"n": 0} and len(hashing.powers(10)[0]) >= 11


def test_sets_pass_by_without_a_sort(spark, monkeypatch):
    """Where sets are too many to be sent, rows that carry them aren't sorted, and no task holds several parts of them."""
    monkeypatch.setattr(op4, "SMALL", 0)
    monkeypatch.setattr(op4, "SMALL_BYTES", 0)
    plans, keep = [], op4.keep

    def kept(df, where, name):
        if name.endswith(("-links", "-texts", "-possible")):
            plans.append((name[4:], df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, where, name)

    monkeypatch.setattr(op4, "keep", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = corpus(5)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r["id"]: (r["n"], r["component_id"]) for r in op4.near_duplicates(docs).collect()}
        assert got == dict(enumerate(zip(*components_of(texts), strict=True)))
        one = op4.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    links = [p for name, p in plans if name == "links"]
    assert links and all(p.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in p and "Coalesce" not in p for p in links)
    assert all("SortMergeJoin" not in p for name, p in plans if name == "possible")
    assert "ShuffledHashJoin" in one and "SortMergeJoin" not in one.split("Window")[0]


@pytest.mark.parametrize("n", range(7))
def test_a_single_short_text(n):
    """A chunk of one text of few words: its shingles are those it has beside others."""
    text, other = " ".join("abcdefg"[:n]).encode(), b" one two three four five six seven"
    alone = op4.shingle_sets(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    both = op4.shingle_sets(np.frombuffer(text + other, dtype=np.uint8), np.array([0, len(text), len(text + other)]))
    assert len(alone) == 1 and alone[0].tolist() == both[0].tolist() and len(alone[0]) == max(min(n, 1), n - 4)


def test_a_short_text_beside_a_long_one(spark):
    long = " ".join(f"w{i}" for i in range(200000))
    docs = spark.createDataFrame([(1, long), (2, "only three words"), (3, "only two")], "doc_id long, text string").coalesce(1)
    for some, ids in ((docs.where("doc_id < 3"), {1, 2}), (docs.where("doc_id <> 2"), {1, 3})):
        assert {r["id"] for r in op4.near_duplicates(some.coalesce(1)).collect()} == ids


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, rng.integers(1, 100)).astype(np.uint64)))
        assert op4.sketch_distance(op4.sketch_of(a), op4.sketch_of(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7)]
    root = {}
    find = lambda i: i if root.get(i, i) == i else find(root[i])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), scratch_dir(spark), "c").collect()))
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}


def covers_of(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + span]) for d in data for i in range(len(d) - span + 1))
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - span + 1):
            if seen[hash(d[i : i + span])] > 1:
                gone[i : i + span] = True
        yield d, gone


def removed_of(texts, span):
    out = []
    for d, gone in covers_of(texts, span):
        steps = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        kept = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((steps == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed,alphabet,hot", [(1, "ab", 512), (2, "abcdé", 512), (3, "ab", 2), (4, "a", 512)])
def test_repeats_equal_brute_force(spark, seed, alphabet, hot):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(40) for _ in range(3)]
    texts = [text(rng.randint(0, 30)) + rng.choice(passages)[rng.randint(0, 8) :] + text(rng.randint(0, 30)) for _ in range(60)] + [None, "", text(11), passages[0], passages[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op5.remove_repeats(docs, span=12, kgram=5).collect()}
    assert got == dict(enumerate(removed_of(texts, 12)))
    if hot < 512:
        size = lambda h: sorted(map(tuple, op5.repeated_spans(keyed, 12, 5, h).groupBy("key").agg(F.sum(F.col("hi") - F.col("lo"))).collect()))
        covered = lambda h: {(r["key"], w) for r in op5.repeated_spans(keyed, 12, 5, h).collect() for w in range(r["lo"], r["hi"] + 1)}
        assert covered(hot) == covered(512) and size(hot)


def test_repeats_edges(spark, edge, none):
    got = op5.remove_repeats(edge)
    rows = got.collect()
    assert len(rows) == edge.count() and set(edge.columns) < set(got.columns)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["n_bytes"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"] and by[6]["kept_text"] == "" and by[7]["kept_text"] == by[7]["text"]
    assert op5.remove_repeats(none).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    """Parts of a long text give the same windows as the whole."""
    monkeypatch.setattr(op5, "PART", 5000)
    monkeypatch.setattr("strata.llm.common.CHUNK_BYTES", 4000)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (23000, 400, 10, 7000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], ["key", "text"])
    rows = pa.Table.from_batches(list(op5._emit_runs(200, 64)(iter([batch])))).to_pylist()
    covered = sorted((r["key"], w) for r in rows for w in range(r["lo"], r["hi"] + 1))
    assert covered == sorted((k + 1, w) for k, t in enumerate(texts) for w in range(len(t) - 199))


@pytest.mark.parametrize("last", [1, 2, 7])
def test_slices_of_a_run_are_settled_alike(monkeypatch, last):
    """A run that fills slices is settled in all of them, and shown once."""
    monkeypatch.setattr(op5, "LOCAL_ROWS", 40)
    n = 80 + last
    rows = [(7, 1)] * n + [(7, 2), (8, 1), (8, 1), (9, 5)]
    batches = []
    for i in range(0, len(rows), 10):
        anchor, run = (np.array(c, dtype=np.int64) for c in zip(*rows[i : i + 10]))
        zero = np.zeros(len(run), dtype=np.int64)
        batches.append(op5._batch([np.full(len(run), op5._ONE, np.int8), anchor, run, run, zero + 300, zero, zero, zero]))
    out = pa.Table.from_batches(list(op5._settle(iter(batches)))).to_pylist()
    got = Counter((r["anchor"], r["run"], r["kind"]) for r in out)
    assert got == {(7, 1, op5._DONE): n, (7, 1, op5._SHOW): 1, (7, 2, op5._ASK): 1, (8, 1, op5._DONE): 2, (8, 1, op5._SHOW): 1, (9, 5, op5._ASK): 1}


def test_equal_windows_of_hot_anchors_leave_a_task_once():
    """Near copies of one passage: a task sends each different window once, however many of them it has."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(40)
    texts = [text(6) + passage + text(6) for _ in range(300)]
    kinds = [op5._SHOW] + [op5._ASK] * 299
    asked = [[{"kind": k, "anchor": 7, "hot": True, "lo": 0, "hi": len(t) - 12, "at": 0}] for k, t in zip(kinds, texts, strict=True)]
    kind = pa.list_(pa.struct([("kind", pa.int8()), ("anchor", pa.int64()), ("hot", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())]))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 60)), pa.array(texts[i : i + 60]), pa.array(asked[i : i + 60], kind)], ["key", "text", "asked"]) for i in range(0, 300, 60)]
    rows = pa.Table.from_batches(list(op5._cut_out(12)(iter(batches)))).to_pylist()
    sent = [r for r in rows if r["kind"] != op5._DONE]
    windows = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
    assert len(sent) == len(windows)  # not 300 * 41
    assert sum(r["kind"] == op5._MANY for r in sent) == len(windows) - sum(n == 1 for t in texts[1:] for n in [windows[t[i : i + 12]] for i in range(len(t) - 11)])
    done = {(r["key"], w) for r in rows if r["kind"] == op5._DONE for w in range(r["lo"], r["hi"] + 1)}
    assert done == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 11) if windows[t[i : i + 12]] > 1}


def test_hot_windows_equal_brute_force(spark):
    """An anchor that many different runs share, over several tasks, against brute force."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(30)
    texts = [text(rng.randint(0, 9)) + passage + text(rng.randint(0, 9)) for _ in range(80)] + [passage, passage, text(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").withColumn("size", F.octet_length("text")).repartition(5)
    got = {(r["key"], w) for r in op5.repeated_spans(docs.select("key", "size", "text"), 12, 5, 2).collect() for w in range(r["lo"], r["hi"] + 1)}
    windows = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
    assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 11) if windows[t[i : i + 12]] > 1}


def test_suffix_sort():
    rng = random.Random(4)
    for alphabet in ("a", "ab", "abcdef"):
        text = bytes(rng.choice(alphabet.encode()) for _ in range(600))
        starts = np.array(sorted(rng.sample(range(600), 150)))
        lengths = np.minimum(np.array([rng.randint(0, 60) for _ in starts]), 600 - starts)
        group = np.sort(np.array([rng.randint(0, 5) for _ in starts]))
        order, near = op5.suffix_sort(np.frombuffer(text, dtype=np.uint8), starts, lengths, group)
        piece = [text[s : s + n] for s, n in zip(starts, lengths)]
        assert order.tolist() == sorted(range(150), key=lambda i: (group[i], piece[i], i))
        for k in range(1, 150):
            a, b = piece[order[k - 1]], piece[order[k]]
            want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) if group[order[k]] == group[order[k - 1]] else 0
            assert near[k] == want


def test_collisions_are_verified(monkeypatch):
    """With a hash that says all is equal, the bytes decide."""
    monkeypatch.setattr(op5.hashing, "spans", lambda h, a, b: np.zeros(len(a), dtype=np.uint64))
    text = np.frombuffer(b"banana bandana", dtype=np.uint8)
    starts, lengths = np.arange(14), np.minimum(14 - np.arange(14), 5)
    order, near = op5.suffix_sort(text, starts, lengths, np.zeros(14, dtype=np.int64))
    piece = [b"banana bandana"[s : s + n] for s, n in zip(starts, lengths)]
    assert [piece[i] for i in order] == sorted(piece)


def test_alignment():
    def naive(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h))

    rng = np.random.default_rng(3)
    a = [rng.integers(2, 6, rng.integers(0, 12)).astype(np.uint64) for _ in range(80)]
    b = [rng.integers(2, 6, rng.integers(1, 15)).astype(np.uint64) for _ in range(80)]
    score, _ = op8.align(a, b)
    assert score.tolist() == [naive(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_decontamination(spark, edge, none, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"v{rng.randint(0, 3000)}"
    items = [[word() for _ in range(40)] for _ in range(6)]
    docs, want = [], set()
    for i in range(200):
        t = [word() for _ in range(150)]
        if i % 10 == 0:
            k = i // 10 % 6
            copy = list(items[k])
            for _ in range(i // 20):  # up to nine edits: replaced, dropped or added words
                at, kind = rng.randrange(len(copy)), rng.random()
                copy[at : at + 1] = [word()] if kind < 0.4 else [] if kind < 0.7 else [copy[at], word()]
            t[70:70] = copy
            want.add((i, k))
        docs.append((i, " ".join(t).capitalize() + "."))
    d = spark.createDataFrame(docs, "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    b = spark.createDataFrame([(k, ", ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, ""), (92, "two words")], "item_id long, text string")
    found = lambda: {(r["doc_id"], r["l"]["item_id"]) for r in op8.mark_leaks(d, b).select("doc_id", F.explode("leaks").alias("l")).collect()}
    assert found() == want
    monkeypatch.setattr(op8, "BITS", 64)  # a bitmap that lets everything pass
    assert found() == want
    assert op8.mark_leaks(edge, b).count() == edge.count() and op8.mark_leaks(none, b).count() == 0
    assert op8.mark_leaks(edge, b.where("false")).where("size(leaks) > 0").count() == 0


def words_of(texts):
    data = [d.encode() for d in texts]
    words, first = op8.word_ids(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


def leaks_of(spark, texts, items):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = op8.mark_leaks(d, b).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
    return {(r["doc_id"], r["item_id"]): (r["score"], r["last_word"]) for r in rows}


def test_replaced_words_equal_brute_force(spark):
    """An exact copy beside each edited one; every pair of item and text is aligned whole."""
    rng = np.random.default_rng(8)
    items, docs = [], []
    for n, share in ((40, 0.2), (40, 0.25), (40, 0.3), (100, 0.2), (100, 0.3)):
        for _ in range(24):
            t = [f"v{w}" for w in rng.integers(0, 3000, n)]
            copy = [f"u{i}" if r < share else w for i, (w, r) in enumerate(zip(t, rng.random(n)))]
            items.append(" ".join(t))
            docs += [" ".join(t), " ".join([f"x{i}" for i in range(50)] + copy + [f"y{i}" for i in range(50)])]
    a, b = words_of(items), words_of(docs)
    want = {}
    for i in range(len(items)):
        score, _ = op8.align([a[i]] * len(b), b)
        want |= {(q, i): s / (2 * len(a[i])) for q, s in enumerate(score) if s >= len(a[i])}
    assert sum(q % 2 for q, _ in want) > 60
    assert {k: v[0] for k, v in leaks_of(spark, docs, items).items()} == want


def test_items_that_share_seeds(spark):
    """Thousands of items of one beginning, in texts that hold it and one of them whole."""
    common = [f"c{i}" for i in range(10)]
    items = [" ".join(common + [f"i{k}w{i}" for i in range(25)]) for k in range(1500)]
    docs = [" ".join(common + ["z"] * 9), items[3], "x y " + items[700] + " z", items[3]]
    assert set(leaks_of(spark, docs, items)) == {(1, 3), (2, 700), (3, 3)}


def test_recall_against_exhaustive_alignment(spark, sf):
    """All texts of up to 600 words against all items, aligned whole."""
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    docs = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    a = words_of(items)
    b = [(q, w) for q, w in enumerate(words_of(docs)) if len(w) <= 600]
    want = set()
    for i, x in enumerate(a):
        for k in range(0, len(b), 100):
            score, _ = op8.align([x] * len(b[k : k + 100]), [w for _, w in b[k : k + 100]])
            want |= {(b[k + r][0], i) for r in np.flatnonzero(score >= len(x))}
    short = {q for q, _ in b}
    found = {k for k in leaks_of(spark, docs, items) if k[0] in short}
    assert len(want) >= 10 and found <= want and len(found) >= 0.95 * len(want)


def test_added_words_on_one_side(spark):
    item = [f"v{i}" for i in range(40)]
    text = item[:3] + [w for v in item[3:] for w in (v, "x")]
    assert leaks_of(spark, [" ".join(text)], [" ".join(item)]) == {(0, 0): ((80 - 36) / 80, len(text) - 2)}


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
        rows = docs.collect()
        if name == "ngram_jaccard":
            rows.sort(key=lambda r: r["doc_id"])
            _, comps = components_of([r["text"] for r in rows])
            assert {r["doc_id"] for r in out.collect()} == {rows[c]["doc_id"] for c in comps}
        if name == "suffix_dedup":
            want = {r["doc_id"]: np.frombuffer(d, dtype=np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for r, (d, gone) in zip(rows, covers_of([r["text"] for r in rows], 200))}
            assert {r["doc_id"]: r["text"] for r in out.collect()} == want and out.where("n_chars <> length(text)").count() == 0
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            kept = {r["doc_id"] for r in out.collect()}
            assert all(r["doc_id"] not in kept for r in rows if any(i in r["text"] for i in items))
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in rows}
        docs = out
