"""Quality rules: rules on one text, and line frequency across the documents of a host.

Normalised lines (words lower-cased A-Z, one space between) are hashed; for each host the distinct
documents of every line are counted; lines over the limit are removed, and a document that loses more
than a share of its words is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import hashing
from strata.llm.common import apart, bounded_batches, chunks, keep, scratch_dir, table, text_buffers

#: A line is removed if it is in at least this many documents of its host ...
MIN_DOCS = 20
#: ... and in at least this share of them.
MIN_SHARE = 0.01
#: A document is rejected if less than this share of its words is left.
LEFT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Frequent lines that may be sent to every task (16 bytes each); above it they are joined.
MAX_SENT = 1 << 19
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.frombuffer(hashing.LOWER, dtype=np.uint8)


def _lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each \\n-split line, and its document."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    ends[last] = offsets[doc[last] + 1]
    return starts, ends, doc


def _repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to another of its group, equal to an earlier one of its group)."""
    order = np.lexsort((np.arange(len(value)), value, group))
    g, v = group[order], value[order]
    same = np.append(False, (g[1:] == g[:-1]) & (v[1:] == v[:-1])) if len(v) else np.zeros(0, dtype=bool)
    any_, earlier = np.empty(len(v), dtype=bool), np.empty(len(v), dtype=bool)
    earlier[order] = same
    any_[order] = same | np.append(same[1:], False) if len(v) else same
    return any_, earlier


class Measured:
    """What one chunk of texts has: base figures for each document, and its lines with a word."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        starts, ends, first = hashing.words(buf, offsets)
        counts = np.diff(first)
        doc = np.repeat(np.arange(n), counts)
        solid = ~hashing.SPACE[buf] & ((buf & 0xC0) != 0x80)
        run = np.concatenate([[0], np.cumsum(solid)])
        self.n_words, self.word_chars = counts, np.diff(run[offsets])
        self.n_symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[buf])])[offsets])
        exact = hashing.word_hashes(buf, starts, ends)
        # three-word windows that are in the text twice or more, then the words they cover
        g = hashing.grams(exact, 3)
        inside = np.append(doc[2:] == doc[:-2], [False] * min(2, len(doc))) if len(doc) > 2 else np.zeros(len(doc), dtype=bool)
        at = np.flatnonzero(inside)
        twice, _ = _repeated(doc[at], g[at])
        covered = np.zeros(len(doc) + 3, dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        self.n_repeat_words = np.bincount(doc[covered[: len(doc)]], minlength=n)
        ls, le, ld = _lines(buf, offsets)
        a, b = np.searchsorted(starts, ls), np.searchsorted(starts, le)
        has = b > a
        ls, le, ld, a, b = ls[has], le[has], ld[has], a[has], b[has]
        raw = hashing.mix(hashing.spans(hashing.prefix(buf), ls, le) + (le - ls).astype(np.uint64))
        _, earlier = _repeated(ld, raw)
        self.n_dup_lines = np.bincount(ld[earlier], minlength=n)
        # a normalised line is its sequence of lower-cased words
        low = hashing.word_hashes(_LOWER[buf], starts, ends)
        p, q = hashing.powers(len(low) + 1)
        run = np.concatenate([[np.uint64(0)], np.cumsum(low * p[: len(low)])])
        self.line = hashing.mix((run[b] - run[a]) * q[a] + (b - a).astype(np.uint64)).view(np.int64)
        self.line_doc, self.line_words = ld, b - a


def _host_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, line, docs): each task's count of documents that hold a line, equal ones of a chunk joined."""

    def run(batches):
        for batch in batches:
            hosts = batch.column("host")
            buf, off = text_buffers(batch.column("text"))
            for i, j in chunks(off):
                m = Measured(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                names = hosts.slice(i, j - i).dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[m.line_doc]
                _, earlier = _repeated(m.line_doc, m.line)
                code, line = code[~earlier], m.line[~earlier]
                order = np.lexsort((line, code))
                code, line = code[order], line[order]
                at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (line[1:] != line[:-1]))) if len(code) else np.zeros(0, dtype=np.int64)
                count = np.diff(np.append(at, len(code)))
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[at])), pa.array(line[at]), pa.array(count.astype(np.int64))], ["host", "line", "docs"])

    rows = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "host string, line long, docs long")


def frequent_lines(docs: DataFrame, min_docs: int, min_share: float, text: str = "text", host: str = "source") -> DataFrame:
    """(host, line) over both limits; a row of ``docs`` is a document."""
    sums = _host_lines(docs, text, host).groupBy("host", "line").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    sizes = docs.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("of"))
    return sums.join(sizes, "host").where(F.col("docs") >= F.col("of") * min_share).select("host", "line")


@apart(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept", "clean_text"], "text", "host")
def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, left_share: float = LEFT_SHARE, text: str = "text", host: str = "source") -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_removed_words (long), base_failed, kept (boolean), clean_text (the text without removed lines).

    Null and empty texts have no words and fail the base rules; null hosts are the host ``''``. Rows
    with equal ids are documents of their own. Columns of these names are replaced. Frequent lines are
    at most (lines of a document) / ``min_share`` a host; up to MAX_SENT they go to every task, beyond
    it each document gets its own by join.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    where = scratch_dir(spark)
    frequent = keep(frequent_lines(docs, min_docs, min_share, text, host), where, "frequent")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words"]
    out = [*names, "base_failed", "kept", "clean_text"]
    base = docs.drop(*out, "_host", "_text", "_bad").withColumns({"_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_text": F.col(text)})
    if frequent.count() <= MAX_SENT:
        sent: dict[str, list] = {}
        for r in frequent.toLocalIterator():
            sent.setdefault(r["host"], []).append(r["line"])
        bad = {k: np.unique(np.array(v, dtype=np.int64)) for k, v in sent.items()}
        base = base.withColumn("_bad", F.lit(None).cast("array<bigint>"))
    else:
        bad = None
        base = base.withColumn("_key", F.xxhash64("_text"))
        pairs = _document_lines(base).join(frequent, ["host", "line"], "left_semi")
        own = keep(pairs.groupBy("host", "key").agg(F.collect_set("line").alias("_bad")), where, "own")
        base = base.join(own.withColumnsRenamed({"host": "_host", "key": "_key"}), ["_host", "_key"], "left").drop("_key")
    kept_columns = [c for c in base.columns if c not in ("_host", "_text", "_bad")]

    def run(batches):
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            hosts, own = batch.column("_host").to_pylist(), batch.column("_bad")
            buf, off = text_buffers(batch.column("_text"))
            parts: dict[str, list] = {k: [] for k in names}
            clean = []
            for i, j in chunks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                m = Measured(part, o)
                removed = np.zeros(len(m.line), dtype=bool)
                ends = np.searchsorted(m.line_doc, np.arange(j - i + 1))
                for d in range(j - i):
                    s = slice(ends[d], ends[d + 1])
                    lines = bad.get(hosts[i + d], none) if bad is not None else np.array(own[i + d].as_py() or [], dtype=np.int64)
                    if len(lines):
                        removed[s] = np.isin(m.line[s], lines)
                    clean.append(_without(part[o[d] : o[d + 1]].tobytes(), removed[s]) if removed[s].any() else None)
                for k in names[:-1]:
                    parts[k].append(getattr(m, k))
                parts[names[-1]].append(np.bincount(m.line_doc[removed], weights=m.line_words[removed], minlength=j - i))
            v = {k: np.concatenate(x).astype(np.int64) if x else none for k, x in parts.items()}
            failed = (v["n_words"] < MIN_WORDS) | (100 * v["n_repeat_words"] > MAX_REPEAT_PERCENT * v["n_words"])
            ok = ~failed & (v["n_words"] - v["n_removed_words"] >= left_share * v["n_words"])
            texts = batch.column("_text").to_pylist()
            cleaned = [t if c is None else c for t, c in zip(texts, clean, strict=True)]
            columns = [*(batch.column(c) for c in kept_columns), *(pa.array(v[k]) for k in names), pa.array(failed), pa.array(ok), pa.array(cleaned, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept_columns, *out])

    schema = base.select(*kept_columns).schema
    for k in names:
        schema = schema.add(k, "long")
    return base.mapInArrow(run, schema.add("base_failed", "boolean").add("kept", "boolean").add("clean_text", "string"))


def _without(text: bytes, removed: np.ndarray) -> str:
    """The text without its removed lines; ``removed`` is for the lines that hold a word."""
    out, k = [], 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            k += 1
            if removed[k - 1]:
                continue
        out.append(line)
    return b"\n".join(out).decode()


def _document_lines(base: DataFrame) -> DataFrame:
    """(host, key, line) of each distinct line of each text."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffers(batch.column("_text"))
            for i, j in chunks(off):
                m = Measured(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                _, earlier = _repeated(m.line_doc, m.line)
                at = pa.array(m.line_doc[~earlier] + i)
                yield pa.RecordBatch.from_arrays([batch.column("_host").take(at), batch.column("_key").take(at), pa.array(m.line[~earlier])], ["host", "key", "line"])

    return base.select("_host", "_key", "_text").mapInArrow(run, "host string, key long, line long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select r, doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d),
win as (select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2) x),
dup as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from win) x where n > 1),
rep as (select r, count(distinct i + k) as n from dup, (select unnest([0, 1, 2]) as k) z group by r),
line as (select r, host, pos, t, array_to_string(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') as norm
  from (select r, host, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as pos from d) x),
solid as (select * from line where norm <> ''),
dl as (select r, count(*) - count(distinct t) as n from solid group by r),
hosts as (select host, count(*) as n from d group by host),
freq as (select s.host, s.norm from solid s join hosts h on h.host = s.host group by s.host, s.norm, h.n
  having count(distinct s.r) >= {MIN_DOCS} and count(distinct s.r) >= h.n * {MIN_SHARE}),
gone as (select s.r, sum(len(string_split(s.norm, ' '))) as n from solid s join freq f on f.host = s.host and f.norm = s.norm group by s.r),
o as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(coalesce(dl.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as n_removed_words
  from w left join rep on rep.r = w.r left join dl on dl.r = w.r left join gone on gone.r = w.r)
select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and n_words - n_removed_words >= {LEFT_SHARE} * n_words as kept from o
"""
