"""Language ID by nearest centroid.

Texts are TF-IDF vectors of hashed byte n-grams, normalised to length one. Each language has several
centroids, found by spherical k-means over its labelled rows; the nearest by cosine decides. A text
that is farther from its centroid than nearly all of that centroid's own rows is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import hashing
from strata.llm.common import apart, bounded_batches, chunks, fold, table, text_buffers

DIMENSIONS = 4096
SIZES = (2, 3)
#: Labelled rows that the classifier is fitted on, at most: those of the smallest hash of their id.
FIT_ROWS = 2000
CENTROIDS = 3
#: Share of a centroid's own rows that its limit of distance leaves out.
REJECT_SHARE = 0.005
UNKNOWN = "und"
#: A-Z as a-z, every other ASCII byte that is no letter as a space.
_PLAIN = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], dtype=np.uint8)


def plain(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (Latin-1 too) with single spaces between runs of them."""
    out = _PLAIN[buf]
    wide = np.flatnonzero(out[:-1] == 0xC3) + 1
    upper = wide[(out[wide] >= 0x80) & (out[wide] <= 0x9E) & (out[wide] != 0x97)]
    out[upper] += 0x20
    first = np.zeros(len(out) + 1, dtype=bool)
    first[offsets] = True
    keep = out != 32
    keep[1:] |= out[:-1] != 32
    keep |= first[:-1]
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, DIMENSIONS) counts of the byte n-grams of each text's letters."""
    n = len(offsets) - 1
    low, offsets = plain(buf, offsets)
    low = low.astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * DIMENSIONS
    out = np.zeros(n * DIMENSIONS, dtype=np.int64)
    for size in SIZES:
        if len(low) < size:
            continue
        code = low[: len(low) - size + 1].copy()
        for k in range(1, size):
            code = code * np.uint32(257) + low[k : len(low) - size + 1 + k]
        inside = doc[: len(code)] == doc[size - 1 :]
        cell = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((doc[: len(code)] + cell)[inside], minlength=len(out))
    return out.reshape(n, DIMENSIONS)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    nearest: np.ndarray  # the least cosine that is not rejected, for each centroid

    def vectors(self, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, rejected) of each row."""
        cosine = self.vectors(count) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
        return best, score, score < self.nearest[best]


def train(count: np.ndarray, labels: list[str], k: int = CENTROIDS, rounds: int = 12) -> Model:
    """Deterministic: the first centroid of a language is its mean, each next one its farthest row."""
    df = (count > 0).sum(axis=0)
    model = Model(np.log((1 + len(count)) / (1 + df)).astype(np.float32) + 1, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    v, label = model.vectors(count), np.array(labels)
    centroids, nearest = [], []
    for name in sorted(set(labels)):
        rows = v[label == name]
        c = rows.mean(axis=0, keepdims=True)
        while len(c) < min(k, len(rows)):
            c = np.vstack([c, rows[(rows @ c.T).max(axis=1).argmin()]])
        for _ in range(rounds):
            own = (rows @ c.T).argmax(axis=1)
            c = np.vstack([rows[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        cosine = rows @ c.T
        own = cosine.argmax(axis=1)
        for i in range(len(c)):
            mine = cosine[own == i, i]
            nearest.append(float(np.quantile(mine, REJECT_SHARE)) if len(mine) else 1.0)
            centroids.append(c[i])
            model.languages.append(name)
    model.centroids, model.nearest = np.array(centroids, dtype=np.float32).reshape(-1, DIMENSIONS), np.array(nearest)
    return model


def sample(rows: DataFrame, key: str, most: int, text: str | None = None) -> DataFrame:
    """The ``most`` rows of the smallest hashes of ``key``, where those tie of ``text``; only hashes are sorted,
    not rows. Of rows that are equal in both, no more are taken than there is room for."""
    h, t = F.xxhash64(F.col(key).cast("string")), F.xxhash64(F.lit(7), F.col(text)) if text else F.lit(0).cast("long")
    least = rows.select(h.alias("h"), t.alias("t")).orderBy("h", "t").limit(most)
    last = least.groupBy("h", "t").agg(F.count("*").alias("n")).orderBy(F.desc("h"), F.desc("t")).first()
    if last is None:
        return rows.where(F.lit(False))
    under = rows.where((h < last["h"]) | ((h == last["h"]) & (t < last["t"])))
    return under.unionByName(rows.where((h == last["h"]) & (t == last["t"])).limit(last["n"]))


def fit(docs: DataFrame, train_rows: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = FIT_ROWS) -> Model:
    """Fit on at most ``most`` rows that ``train_rows`` selects and that have text and a language."""
    rows = docs.where(train_rows & F.col(lang).isNotNull() & F.col(text).isNotNull())

    def run(batches):
        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            for i, j in chunks(off):
                c = counts(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array([x.astype(np.uint16 if x.max() < 65536 else np.uint32).astype(np.float32).tobytes() for x in c], pa.binary())], ["lang", "counts"])

    found = sample(rows, key, most, text).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, counts binary").toArrow()
    raw = found.column("counts").to_pylist()
    count = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, DIMENSIONS)
    labels = found.column("lang").to_pylist()
    # the order in which rows arrive must not matter to sums
    order = sorted(range(len(labels)), key=lambda i: (labels[i], raw[i]))
    return train(count[order], [labels[i] for i in order])


@apart(["lang_pred", "score", "rejected"], "text")
def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred string, score double, rejected boolean.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; a model without a
    language says ``und`` of all. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.drop("lang_pred", "score", "rejected").withColumns({"_text": F.col(text), "_letter": F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))})
    kept = [c for c in base.columns if c not in ("_text", "_letter")]
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            buf, off = text_buffers(batch.column("_text"))
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            n = batch.num_rows
            lang, score, far = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
            for i, j in chunks(off) if len(m.languages) else ():
                for a in range(i, j, 256):
                    b = min(a + 256, j)
                    best, s, f = m.predict(counts(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
                    ok = letter[a:b]
                    lang[a:b][ok] = np.array(m.languages, dtype=object)[best[ok]]
                    score[a:b][ok], far[a:b][ok] = s[ok], f[ok]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], [*kept, "lang_pred", "score", "rejected"])

    schema = base.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return base.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bounded_batches(spark)
    model = fit(docs, fold(F.col("doc_id")) != 1)
    held = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text")
    return identify(held, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
