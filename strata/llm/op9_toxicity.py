"""Toxicity by non-negative positive-unlabelled learning.

Positives are rows confirmed as toxic, the unlabelled rows are texts of which nothing is used but
their words. With class prior p, the risk of a classifier is
``p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)])``; the second term estimates the risk on negatives,
and where a batch makes it negative, the step goes the other way, so that it can't be overfitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import hashing
from strata.llm.common import apart, bounded_batches, chunks, fold, table, text_buffers
from strata.llm.op3_language import sample

BITS = 22
#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Rows that the classifier is fitted on, at most: those of the smallest hash of their id.
FIT_POSITIVE, FIT_UNLABELLED = 2500, 5000
#: Features that take part: those of the largest log ratio of positives to unlabelled rows.
FEATURES = 4096
THRESHOLD = 0.7
_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.frombuffer(hashing.LOWER, dtype=np.uint8)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word and word beginning, repeats included."""
    low = _LOWER[buf]
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    solid = _LETTER[low]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (np.append(True, ~solid[:-1]) | first[:-1]))
    ends = np.flatnonzero(solid & (np.append(~solid[1:], True) | first[1:])) + 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(np.searchsorted(starts, offsets)))
    h = hashing.prefix(low)
    out = [hashing.mix(hashing.spans(h, starts, ends) + np.uint64(99))]
    docs = [doc]
    for size in BEGINNINGS:
        long = ends - starts >= size
        out.append(hashing.mix(hashing.spans(h, starts[long], starts[long] + size) + np.uint64(size)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    ids: np.ndarray  # features, ascending
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text: the logistic function of the weights of its distinct features."""
        doc, f = features(buf, offsets)
        if not len(self.ids):
            return np.full(len(offsets) - 1, self.prior)
        at = np.searchsorted(self.ids, f)
        at[at == len(self.ids)] = 0
        hit = self.ids[at] == f
        cell = np.unique(doc[hit] * len(self.ids) + at[hit])
        z = np.bincount(cell // len(self.ids), weights=self.weights[cell % len(self.ids)], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many rows have each feature. Rows are counted one by one, since this is the driver's memory."""
    out = np.zeros(1 << BITS, dtype=np.int32)
    for f in rows:
        np.add.at(out, f, 1)
    return out


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 600, rate: float = 0.05, decay: float = 1.5e-4) -> Model:
    """Fit on the distinct features of each row; full batches with Adam, in a fixed order."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0, prior)
    np_, nu = len(positive), len(unlabelled)
    cp, cu = counts(positive), counts(unlabelled)
    able = np.flatnonzero(cp >= max(3, int(0.003 * np_)))
    cp, cu = cp[able], cu[able]
    ratio = np.log((cp + 0.1) / (np_ + 0.2)) - np.log((cu + 0.1 + 0.5 * np.sqrt(cu)) / (nu + 0.2))
    able, gain = able[ratio > 1.5], (cp * ratio)[ratio > 1.5]
    ids = np.sort(able[np.lexsort((able, -gain))[:FEATURES]])
    if not len(ids):
        return Model(ids, np.zeros(0), 0.0, prior)

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, col = [], []
        for i, f in enumerate(rows):
            at = np.searchsorted(ids, f)
            at[at == len(ids)] = 0
            at = at[ids[at] == f]
            row.append(np.full(len(at), i, dtype=np.int32))
            col.append(at.astype(np.int32))
        return np.concatenate(row), np.concatenate(col)

    (rp, kp), (ru, ku) = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(ids)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for t in range(1, rounds + 1):
        zp = np.bincount(rp, weights=w[kp], minlength=np_) + b
        zu = np.bincount(ru, weights=w[ku], minlength=nu) + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dn_p, dn_u = -prior * sp / np_, su / nu
        if negative >= 0:
            dp, du = prior * (sp - 1) / np_ + dn_p, dn_u
        else:
            dp, du = -dn_p, -dn_u
        g = np.append(np.bincount(kp, weights=dp[rp], minlength=len(ids)) + np.bincount(ku, weights=du[ru], minlength=len(ids)) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0.0), b - step[-1]
    return Model(ids, w, float(b), prior)


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", positives: int = FIT_POSITIVE, unlabelled: int = FIT_UNLABELLED) -> Model:
    """Fit on rows that ``train_rows`` (of the key column) selects; the prior is the share of toxic
    among their labels. Null labels are no labels; no positive row gives the prior for all."""
    marked = labels.where(train_rows & F.col(label).isNotNull() & F.col(key).isNotNull())
    share = marked.agg(F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0))).first()[0]
    prior = min(max(share or 0.05, 0.01), 0.5)

    def run(batches):
        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            for i, j in chunks(off):
                doc, f = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                cell = np.unique(doc << BITS | f)
                ends = np.searchsorted(cell >> BITS, np.arange(j - i + 1))
                small = (cell & ((1 << BITS) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([small[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["f"])

    def rows(found: DataFrame) -> list[np.ndarray]:
        raw = sorted(found.select(F.col(text).alias("text")).mapInArrow(run, "f binary").toArrow().column("f").to_pylist())
        return [np.frombuffer(x, dtype=np.uint32) for x in raw]

    toxic = sample(marked.where(F.col(label) == 1).select(key).distinct(), key, positives)
    full = docs.where(train_rows & F.col(text).isNotNull())
    found = full.join(F.broadcast(toxic), key, "left_semi")
    return train(rows(sample(found, key, positives, text)), rows(sample(full, key, unlabelled, text)), prior)


@apart(["score", "predicted"], "text")
def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and score double (0 to 1), predicted int (1 from ``threshold`` on).

    Null and empty texts have no feature and get the bias's score. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.drop("score", "predicted").withColumn("_text", F.col(text))
    kept = [c for c in base.columns if c != "_text"]
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            buf, off = text_buffers(batch.column("_text"))
            parts = [m.score(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return base.mapInArrow(run, base.select(*kept).schema.add("score", "double").add("predicted", "integer"))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    bounded_batches(spark)
    return fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(spark, docs, sf_dir)
    held = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text")
    return score(held, model).select("doc_id", "held_out", "score", "predicted")
