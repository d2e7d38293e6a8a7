"""Language-model scoring and whitening against brute force."""

import binascii
import math
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import op11_hmm as op11
from strata.llm import op12_whitening as op12
from strata.llm.common import scratch_dir, table


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return i is not None and binascii.crc32(str(i).encode()) % 7 == 2


def base_of(rows):
    """(n_tokens, n_known, N, base) of each (id, text)."""
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return [(len(ts := tokens(x)), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts)) for _, x in rows]


def plain(ids, m):
    """Likelihood by a loop over all words and states, without scaling, in exact fractions."""
    k = len(m.start)
    f = lambda x: Fraction(float(x))
    a = [f(m.start[z]) * f(m.emit[ids[0], z]) for z in range(k)]
    for c in ids[1:]:
        a = [sum(a[y] * f(m.step[y, z]) for y in range(k)) * f(m.emit[c, z]) for z in range(k)]
    p = sum(a)
    shift = p.denominator.bit_length() - p.numerator.bit_length()
    return math.log10(float(p * 2**shift)) - shift * math.log10(2)


def some_model(k=3, seed=5):
    r = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return op11.Model(norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((op11.CLASSES, k)), 0))


def test_forward_and_expected_counts():
    r, m = np.random.default_rng(1), some_model()
    seqs = [r.integers(0, op11.CLASSES, n) for n in (1, 7, 3, 40, 1, 12)]
    got = op11.Lockstep(seqs).forward(m)[0]
    assert np.allclose(got, [plain(s, m) for s in seqs], rtol=1e-12)
    # expected counts by all paths of short sequences
    short = [r.integers(0, 5, n) for n in (1, 2, 4)]
    starts, steps, emits, like = op11.expected(short, m)
    s2, t2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((op11.CLASSES, 3))
    for s in short:
        paths = [[]]
        for _ in s:
            paths = [p + [z] for p in paths for z in range(3)]
        w = np.array([m.start[p[0]] * np.prod([m.emit[c, z] for c, z in zip(s, p)]) * np.prod([m.step[a, b] for a, b in zip(p, p[1:])]) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            s2[p[0]] += x
            for c, z in zip(s, p):
                e2[c, z] += x
            for a, b in zip(p, p[1:]):
                t2[a, b] += x
    assert np.allclose(starts, s2) and np.allclose(steps, t2) and np.allclose(emits, e2)
    assert like == pytest.approx(sum(plain(s, m) for s in short))


def test_recursions_in_spans_and_scaled_now_and_then(monkeypatch):
    """Rare classes don't underflow between scaled positions; runs of positions give the same counts at any size."""
    r, m = np.random.default_rng(2), some_model()
    m.emit[:50] *= 1e-25
    seqs = [r.integers(0, 100, n) for n in (260, 4, 3, 61, 1, 8, 61, 5)] + [np.zeros(90, dtype=np.int64)]
    assert np.allclose(op11.Lockstep(seqs).forward(m)[0], [plain(s, m) for s in seqs], rtol=1e-12)
    whole = op11.expected(seqs, m)
    assert np.isclose(whole[0].sum(), len(seqs)) and np.isclose(whole[2].sum(), sum(map(len, seqs)))
    assert np.isclose(whole[1].sum(), sum(len(s) - 1 for s in seqs))
    for span, scaled in ((1, 4), (7, 1), (40, 3)):
        monkeypatch.setattr(op11, "SPAN", span)
        monkeypatch.setattr(op11, "SCALED", scaled)
        for a, b in zip(op11.expected(seqs, m), whole, strict=True):
            assert np.allclose(a, b, rtol=1e-10, atol=1e-13)
    one = [op11.expected([s], m) for s in seqs]
    for k in range(4):
        assert np.allclose(sum(x[k] for x in one), whole[k], rtol=1e-10, atol=1e-13)


def test_long_texts_run_together():
    """The positions that few texts reach are gone through once, not once for each group of texts."""
    sizes = [5000 if i % 100 == 7 else 40 + i % 30 for i in range(1000)]
    seqs = [np.full(n, i % 9, dtype=np.uint16) for i, n in enumerate(sizes)]
    groups = list(op11.grouped(iter(seqs), 60_000))
    assert sorted(i for numbers, _ in groups for i in numbers) == list(range(1000))
    assert all(len(x) == sizes[i] and x[0] == i % 9 for numbers, group in groups for i, x in zip(numbers, group, strict=True))
    assert sum(len(op11.Lockstep(group).active) for _, group in groups) < 6000
    assert all(sum(map(len, group)) <= 60_000 for _, group in groups)
    assert sorted(i for i, _ in op11.grouped(iter(seqs[:9]), 10)) == [[i] for i in range(9)]  # longer than the limit: alone


def test_words_are_hashed_by_pieces():
    """The same hashes as of each text by itself, in little memory for each byte."""
    r = np.random.default_rng(3)
    texts = ["", "a", " ", "Ab\x0bab", "x" * 70_000, *("".join(r.choice(list("abcDE \n"), n)) for n in r.integers(0, 900, 2000)), "", "end"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    op11.words(buf[:10], np.array([0, 10]))
    tracemalloc.start()
    h1, h2, g, first = op11.words(buf, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(buf)
    assert np.array_equal(np.diff(first), [len(tokens(t)) - 1 for t in texts])
    for i in (0, 1, 2, 3, 4, 5, 1000, 2004, 2005, 2006):
        a, b = first[i], first[i + 1]
        for x, y in zip(op11.words(np.frombuffer(raw[i], dtype=np.uint8), np.array([0, len(raw[i])]))[:3], (h1, h2, g), strict=True):
            assert np.array_equal(x, y[a:b])
    assert [len(x) for x in op11.words(buf[:0], np.zeros(1, dtype=np.int64))] == [0, 0, 0, 1]


def test_words_meet_and_are_found():
    """Equal words become one and are found in the list, also where different ones share h1 or its leading bits."""
    r = np.random.default_rng(4)
    for keys in (r.integers(-(2**63), 2**63 - 1, 300), np.arange(-150, 150), np.array([-(2**63), -1, 0, 2**63 - 1])):
        for other in (lambda h: h ^ 5, lambda h: r.integers(0, 2, len(h))):
            h1 = r.choice(keys, 5000)
            h2 = other(h1)
            want = Counter(zip(h1.tolist(), h2.tolist(), strict=True))
            a, b, g, c = op11._merged(h1, h2, h1 % 7, np.ones(5000, dtype=np.int64))
            assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), c.tolist(), strict=True)) == want and np.array_equal(g, a % 7)
        order = np.unique(keys)[::2]
        listed = op11.Listed(order, order ^ 5, *(np.zeros(0, dtype=np.int64),) * 4)
        at, hit = listed.finder()(h := np.concatenate((keys, keys, keys + 1)), np.concatenate((keys ^ 5, keys ^ 4, (keys + 1) ^ 5)))
        assert np.array_equal(hit, np.isin(h, order) & np.repeat([True, False, True], len(keys))) and np.array_equal(order[at[hit]], h[hit])
    none = np.zeros(0, dtype=np.int64)
    assert not op11.Listed(*(none,) * 6).finder()(keys, keys)[1].any() and not len(listed.finder()(none, none)[0])


def test_rounds_raise_the_likelihood_and_parts_do_not_matter(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 200").select("doc_id", "text")
    train = ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = []
    for parts in (1, 5):
        where, log = scratch_dir(spark), []
        d = docs.repartition(parts)
        v = op11.count_words(d, train, where)
        s = op11.sequences(d, v, train, where, carry=["doc_id"])
        op11.baum_welch(s, v, rounds=3, log=log)
        assert log[0] < log[1] < log[2]
        found.append((v.n, v.v, log[0]))
    assert found[0][:2] == found[1][:2] and found[0][2] == pytest.approx(found[1][2], rel=1e-6)


def test_first_rounds_go_through_all_texts(spark):
    """All of every training text has its turn in the first rounds; a turn without texts changes nothing."""
    r = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in r.zipf(1.4, 700) % 300)) for i in range(7)], "doc_id long, text string")
    where = scratch_dir(spark)
    v = op11.count_words(docs, F.lit(True), where)
    s = op11.sequences(docs, v, F.lit(True), where)
    got = op11.baum_welch(s, v, states=3, warm_rounds=5, rounds=0)
    rows = s.select("ids", F.pmod(F.xxhash64("ids"), F.lit(5)).alias("turn")).collect()
    share = (v.listed.tokens + 1.0) / (v.listed.tokens.sum() + op11.CLASSES)
    m, sums, tokens_ = op11.first_model(share, 3), [0, 0, 0], 0
    for k in range(5):
        if turn := [np.frombuffer(x["ids"], dtype=np.uint16)[i : i + op11.PIECE] for x in rows if x["turn"] == k for i in range(0, 701, op11.PIECE)]:
            sums = [a + b for a, b in zip(sums, op11.expected(turn, m), strict=False)]
            m = op11.maximised(*sums, share)
            tokens_ += sum(map(len, turn))
    assert tokens_ == 7 * 701 == pytest.approx(sums[2].sum())
    assert np.allclose(got.step, m.step, rtol=1e-4) and np.allclose(got.emit, m.emit, rtol=1e-3, atol=1e-7)


def test_scores(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    clash = edge.selectExpr("*", "doc_id as rid", "doc_id as carried", "'x' as ids", "1 as h1", "2 as train", "3 as base", "4 as rare", "5 as base_score", "6 as `a.b`")
    hold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    got = op11.language_model(clash, ~hold).join(edge.select("doc_id", "text").distinct().withColumnRenamed("doc_id", "d2"), F.col("d2").eqNullSafe(F.col("doc_id")), "left_semi")
    assert set(clash.columns) - {"text"} <= set(got.columns)
    key = lambda r: (r[0] or -1, *r[1:])
    want = sorted(((i, *b) for (i, _), b in zip(rows, base_of(rows))), key=lambda r: (r[0] or -1, r[1]))
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got.collect()), key=lambda r: (r[0] or -1, r[1]))
    assert [x[:4] for x in have] == [x[:4] for x in want] and key(have[0])
    assert np.allclose([x[4] for x in have], [x[4] for x in want], rtol=1e-9)
    assert op11.language_model(edge.where("false"), ~hold).count() == 0
    none = op11.language_model(edge.select("doc_id", "text"), F.lit(False)).collect()
    assert len(none) == len(rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in none)


def test_rare_words_are_joined(spark, sf, monkeypatch):
    """The same sums, whether words are sent or joined; scores of whole texts against a plain loop."""
    docs = table(spark, sf, "documents").where("doc_id < 60").select("doc_id", "text")
    train = ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = []
    for listed in (op11.LISTED, 64):
        monkeypatch.setattr(op11, "LISTED", listed)
        where = scratch_dir(spark)
        v = op11.count_words(docs, train, where)
        s = op11.sequences(docs, v, train, where)
        m = op11.baum_welch(s, v, rounds=1)
        out.append({r["doc_id"]: r for r in op11.score(s, v, m).collect()})
    joined = s.where(F.size("rare") > 0).count()
    assert joined > 0
    for i, r in out[0].items():
        assert out[1][i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9) and out[1][i]["score"] == pytest.approx(r["score"], rel=1e-9) and out[1][i]["n_known"] == r["n_known"]
    # by hand: the path's likelihood, and every word's share of its class
    count = Counter(t for r in docs.collect() if not held(r["doc_id"]) for t in tokens(r["text"]))
    for r in s.where("n_tokens < 60").limit(10).collect():
        ids = np.frombuffer(r["ids"], dtype=np.uint16)
        ts = tokens(docs.where(F.col("doc_id") == r["carried"]["doc_id"]).first()["text"])
        inside = sum(math.log10((count[t] + 1) / (v.listed.tokens[c] + v.listed.sizes[c - op11.OWN] + 1)) for t, c in zip(ts, ids) if op11.OWN <= c < op11.END)
        assert out[1][r["carried"]["doc_id"]]["score"] == pytest.approx(plain(ids, m) + inside, rel=1e-9)


def test_score_beats_the_base_on_held_out_texts(spark, sf):
    got = op11.query(spark, sf)
    assert got.columns == ["doc_id", "held_out", *op11.RESULT]
    total = {r["held_out"]: r for r in got.groupBy("held_out").agg(F.count("*").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).collect()}
    assert total[True]["n"] + total[False]["n"] == 1000
    assert total[True]["s"] > total[True]["b"] * 0.92 and got.where("score >= 0").count() == 0


def brute(rows):
    """n, deviations, covariance (exact) and mean of vectors as lists of x."""
    n, d = len(rows), len(rows[0])
    s = [sum(r[j] for r in rows) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in rows]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in rows), n**3) for j in range(d)] for i in range(d)]
    return n, dev, v, [Fraction(x, n) for x in s]


def test_digits_are_exact():
    r = np.random.default_rng(3)
    for scale in (3, 2**20, 2**40, 2**61):
        u = r.integers(-scale, scale, (37, 5))
        assert (sum(s.astype(object) << (op12.DIGIT * k) for k, s in enumerate(op12.slices(u))) == u.astype(object)).all()
        got = sum(s.astype(object) << (op12.DIGIT * k) for k, s in enumerate(op12.products(u)))
        assert (got == u.astype(object).T @ u.astype(object)).all()
        twice = op12.added(op12.products(u), op12.products(u))
        assert (sum(s.astype(object) << (op12.DIGIT * k) for k, s in enumerate(twice)) == 2 * got).all()


@pytest.mark.parametrize("scale", [0.3, 1e5, 1e9])
def test_whitening(spark, scale):
    r = np.random.default_rng(7)
    raw = (r.normal(size=(60, 6)) @ r.normal(size=(6, 6)) * scale).astype(np.float32).tolist()
    rows = [(i, x) for i, x in enumerate(raw)] + [(None, raw[0]), (5, raw[5]), (70, None), (71, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (72, [float("nan")] * 6), (73, [float("inf")] * 6), (74, []), (75, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "c", 1, 2.0) for x in rows], "vec_id long, embedding array<float>, carried string, n long, whitened double").repartition(3)
    got = op12.whiten(df, components=32).collect()
    used = [(i, x) for i, x in rows if x and len(x) == 6 and all(c is not None and math.isfinite(c) for c in x)]
    n, dev, v, mean = brute([[math.floor(64 * float(c)) + 1000000 for c in x] for _, x in used])
    assert len(got) == n * 6 and {g["component"] for g in got} == set(range(1, 7)) and all(g["n"] == n for g in got)
    first = [g for g in got if g["component"] == 1]
    assert Counter((g["vec_id"], int(g["deviation"])) for g in first) == Counter((i, x) for (i, _), x in zip(used, dev)) and {g["carried"] for g in got} == {"c"}
    e, basis = np.linalg.eigh(np.array([[float(x) for x in row] for row in v]))
    e, basis = e[::-1], basis[:, ::-1]
    for k in range(6):
        mine = {(g["vec_id"], g["deviation"]): g for g in got if g["component"] == k + 1}
        z = [float(sum((Fraction(math.floor(64 * float(c)) + 1000000) - m) * Fraction(float(b)) for c, m, b in zip(x, mean, basis[:, k]))) / math.sqrt(e[k]) for _, x in used]
        have = [mine[i, str(d_)]["whitened"] for (i, _), d_ in zip(used, dev)]
        sign = np.sign(np.dot(z, have))
        assert np.allclose(have, sign * np.array(z), atol=1e-6)
        assert have and mine[used[0][0], str(dev[0])]["explained"] == pytest.approx(e[k] / sum(e), rel=1e-6)
    assert all(g["identity_error"] < 1e-6 for g in got)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert op12.whiten(spark.createDataFrame([], schema)).count() == 0
    assert op12.whiten(spark.createDataFrame([(1, None)], schema)).columns == ["vec_id", *op12.RESULT]
    one = op12.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert [(g["whitened"], g["deviation"], g["explained"]) for g in one] == [(0.0, "0", 0.0)] * 4
    huge = op12.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 5.0])], schema)).collect()
    assert len(huge) == 6 and all(int(g["deviation"]) > 2**63 for g in huge if g["vec_id"] != 3)


def test_whitening_query(spark, sf):
    got = op12.query(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = table(spark, sf, "embeddings").select("embedding").toPandas()["embedding"]
    x = np.floor(64 * np.stack(rows.tolist()).astype(np.float64)) + 1000000
    c = x - x.mean(axis=0)
    e = np.linalg.eigvalsh(c.T @ c / len(x))[::-1]
    have = {r["component"]: r["e"] for r in got.groupBy("component").agg(F.max("explained").alias("e")).collect()}
    assert len(have) == 32 and np.allclose([have[k + 1] for k in range(32)], e[:32] / e.sum(), rtol=1e-8)
    assert got.count() == len(x) * 32 and got.where("deviation is null or identity_error > 1e-4").count() == 0
