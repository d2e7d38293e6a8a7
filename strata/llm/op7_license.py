"""Licence scan: cosine of licence texts and statements to templates, then inheritance down directories.

Every sentence or line of every file is a sparse TF-IDF vector and is compared with each template; the
best one from a threshold on is the file's own licence. A file without one takes that of the licence
file in its nearest ancestor directory, found by joins on paths. SQL functions only.

Before that, the head of every file and the whole of a licence file are searched for an SPDX line, for
a standard header or the beginning of a licence text (windows of a template's length, as sets of terms,
by cosine), and for a licence's title on a line of its own. What is found there goes before a sentence, and
any named licence before "All rights reserved.".

Inverse document frequencies of the templates' terms are counted over all files; any other term weighs
as one that no file has. A sentence is looked at only if it has one of the templates' heavy terms: by the
Cauchy-Schwarz inequality, the light ones alone can't reach the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import apart, keep, scratch_dir, table
from strata.llm.licence_texts import TEXTS

# Short statements by which public licences are declared.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistributed under the BSD 3-Clause License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "proprietary": "All rights reserved.",
}
THRESHOLD = 0.7
#: Characters of a file that is no licence file in which headers are looked for.
HEAD = 4096
#: Words that licence texts are not compared by.
STOP = frozenset("a all an and any are as at be by for in is it its not of on or shall that the this to which with you".split())
#: A name that no named licence loses to.
UNNAMED = "proprietary"
SPDX = r"SPDX-License-Identifier:[\x20\t(]*([A-Za-z0-9][A-Za-z0-9.-]*)"
#: Titles that stand on lines of their own, in lower case.
TITLES = {
    "MIT": r"(?:the )?mit licen[cs]e(?: \(mit\))?",
    "ISC": r"(?:the )?isc licen[cs]e(?: \(isc\))?",
    "BSD-2-Clause": r"(?:the )?bsd 2-clause licen[cs]e",
    "BSD-3-Clause": r"(?:the )?bsd 3-clause licen[cs]e",
    "Apache-2.0": r"apache license,?\s+version 2\.0(?:, january 2004)?",
    "GPL-2.0": r"gnu general public license,?\s+version 2(?:, june 1991)?",
    "GPL-3.0": r"gnu general public license,?\s+version 3(?:, 29 june 2007)?",
    "LGPL-3.0": r"gnu lesser general public license,?\s+version 3(?:, 29 june 2007)?",
    "AGPL-3.0": r"gnu affero general public license,?\s+version 3(?:, 19 november 2007)?",
    "MPL-2.0": r"mozilla public license,?\s+version 2\.0",
}
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), "")


def sentences(text: Column) -> Column:
    """Lines, cut on after ``.``, ``!`` or ``?`` and white space."""
    return F.split(F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\n"), "\n")


class Weights:
    """IDF of the templates' terms and the templates' vectors, from counts over ``n`` files."""

    def __init__(self, templates: dict[str, str], count: dict[str, int], n: int):
        self.tf = {name: Counter(terms_of(text)) for name, text in templates.items()}
        vocabulary = sorted({t for tf in self.tf.values() for t in tf})
        self.other = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + count.get(t, 0))) + 1 for t in vocabulary}
        self.norm = {name: math.sqrt(sum((k * self.idf[t]) ** 2 for t, k in tf.items())) for name, tf in self.tf.items()}

    def heavy(self, threshold: float) -> list[str]:
        """Terms of which every sentence that reaches the threshold has one."""
        out = set()
        for name, tf in self.tf.items():
            light = 0.0
            for t in sorted(tf, key=lambda t: (self.idf[t] * tf[t], t)):
                light += (tf[t] * self.idf[t]) ** 2
                if light >= (threshold * self.norm[name]) ** 2 * 0.999:
                    out.add(t)
        return sorted(out)


def template_counts(texts: Column, docs: DataFrame, templates: dict[str, str]) -> tuple[dict[str, int], int]:
    """For each term of the templates the files that hold it, and the number of files."""
    vocabulary = sorted({t for text in templates.values() for t in terms_of(text)})
    held = docs.select(F.explode(F.array_intersect(terms(texts), F.array(*map(F.lit, vocabulary)))).alias("t"))
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}, docs.count()


def _scores(words: Column, w: Weights) -> Column:
    """(score, licence) of the best template for an array of terms; ties: the first name."""
    idf = F.create_map(*[F.lit(x) for t, v in w.idf.items() for x in (t, v)])
    # equal words stand together once they are sorted: one pass adds up the squares of their runs
    square = lambda s: F.pow(s["run"] * F.coalesce(F.try_element_at(idf, s["word"]), F.lit(w.other)), F.lit(2.0))
    state = lambda word, run, total: F.struct(word.alias("word"), run.alias("run"), total.alias("total"))
    step = lambda s, x: F.when(x == s["word"], state(s["word"], s["run"] + 1.0, s["total"])).otherwise(state(x, F.lit(1.0), s["total"] + square(s)))
    norm = F.sqrt(F.aggregate(F.array_sort(words), state(F.lit(""), F.lit(0.0), F.lit(0.0)), step, lambda s: s["total"] + square(s)))
    known = F.filter(words, lambda x: F.try_element_at(idf, x).isNotNull())
    # each of these arrays and numbers is made once, not wherever it is used
    return F.get(F.transform(F.array(F.struct(known.alias("words"), norm.alias("norm"))), lambda x: _best(x["words"], x["norm"], w)), 0)


def _best(words: Column, norm: Column, w: Weights) -> Column:
    tf = lambda t: F.size(F.filter(words, lambda x: x == t))
    options = []
    for name, own in w.tf.items():
        dot = F.lit(0.0)
        for t, k in own.items():
            dot = dot + tf(F.lit(t)) * F.lit(k * w.idf[t] ** 2)
        options.append(F.struct(F.round(dot / (norm * w.norm[name]), 6).alias("score"), F.lit(name).alias("licence")))
    return F.aggregate(F.array(*options), F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("licence")), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))


def _found_texts(words: Column, texts: list[tuple[str, str]], count: dict[str, int], n: int, threshold: float) -> Column:
    """(score, licence) of the best window of ``words`` for one of the texts, or null below ``threshold``.

    Terms count once and without STOP. By the Cauchy-Schwarz inequality, no window reaches the threshold
    if the terms of the template that the file has weigh too little; only other templates' windows are made.
    Of several templates that reach it, the one counts of which the most is there and the least is missing.
    """
    kinds = [(name, sorted({t for t in terms_of(x) if t not in STOP}), len(terms_of(x))) for name, x in texts]
    idf = {t: math.log((1 + n) / (1 + count.get(t, 0))) + 1 for _, own, _ in kinds for t in own}
    square = F.create_map(*[F.lit(x) for t, v in sorted(idf.items()) for x in (t, v * v)])
    other = F.lit((math.log(1 + n) + 1) ** 2)
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(square, t), other))
    stop = F.array(*map(F.lit, sorted(STOP)))
    heavy, options = set(), []
    for name, own, wide in kinds:
        whole, light = sum(idf[t] ** 2 for t in own), 0.0
        for t in sorted(own, key=lambda t: (idf[t], t)):
            light += idf[t] ** 2
            if light >= threshold**2 * whole * 0.999:
                heavy.add(t)
        options.append(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("own"), F.lit(whole).alias("whole"), F.lit(wide).alias("wide")))
    likely = F.filter(F.array(*options), lambda t: mass(F.array_intersect(t["own"], words)) >= threshold**2 * 0.999 * t["whole"])

    def score(t, at):
        window = F.array_except(F.slice(words, at, t["wide"]), stop)
        return F.coalesce(F.round(mass(F.array_intersect(window, t["own"])) / F.sqrt(F.nullif(mass(window), F.lit(0.0)) * t["whole"]), 6), F.lit(0.0))

    starts = lambda t: F.sequence(F.lit(1), F.greatest(F.size(words) - t["wide"] + 1, F.lit(1)) + F.floor(t["wide"] / 8).cast("int"), F.floor(t["wide"] / 8).cast("int"))
    tops = F.transform(likely, lambda t: F.struct(t.alias("t"), F.array_max(F.transform(starts(t), lambda at: F.struct(score(t, at).alias("score"), at.alias("at")))).alias("m")))

    def gain(t, at):  # around the best window, which may be off by a step
        step = F.floor(t["wide"] / 8).cast("int")
        near = F.slice(words, F.greatest(at - step, F.lit(1)), t["wide"] + 2 * step)
        return F.round(2 * mass(F.array_intersect(near, t["own"])) - t["whole"], 6)

    reached = F.filter(tops, lambda x: x["m"]["score"] >= threshold)
    best = F.array_max(F.transform(reached, lambda x: F.struct(gain(x["t"], x["m"]["at"]).alias("gain"), x["m"]["score"].alias("score"), x["t"]["name"].alias("licence"))))
    found = F.transform(F.array(best), lambda b: F.when(b.isNotNull(), F.struct(b["score"].alias("score"), b["licence"].alias("licence"))))
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, sorted(heavy)))), F.get(found, F.lit(0)))


def _marked(text: Column) -> tuple[Column, Column]:
    """(score, licence) of an SPDX line and of a title, or null."""
    tag = F.regexp_replace(F.regexp_extract(text, SPDX, 1), "-(only|or-later)$|[.]$", "")
    low = F.translate(text, _UPPER, _LOWER)
    title = F.lit(None).cast("string")
    for name, r in reversed(TITLES.items()):
        title = F.when(low.rlike(rf"(?m)^[^a-z0-9\n]*{r}[^a-z0-9\n]*$"), name).otherwise(title)
    one = lambda name: F.struct(F.lit(1.0).alias("score"), name.alias("licence"))
    return F.when(text.contains("SPDX-License-Identifier:") & (tag != ""), one(tag)), F.when(low.rlike("licen[cs]e") & title.isNotNull(), one(title))


@apart(["own_licence", "own_score", "licence", "licence_from"], "text", "path")
def scan_licences(files: DataFrame, text: str = "text", path: str = "path", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, license_file: str = LICENSE_FILE) -> DataFrame:
    """All columns of ``files`` and own_licence, own_score (0 without one), licence (own or inherited),
    licence_from (the directory it is inherited from, else null).

    A file's own licence is that of an SPDX line (of an expression the first), else of a licence text or
    header, else of a title, else of a statement; without a path only the head is searched for the first three. Texts and headers need THRESHOLD at least.
    A path's directories end at each ``/``; the root is ``''``. Of several licence files in a directory
    the one of the smallest path counts, of several statements in a file the best, the first name
    on a tie. Null and empty texts have no licence of their own; null paths inherit nothing. Columns of
    these names are replaced.
    """
    where = scratch_dir(files.sparkSession)
    base = files.drop("own_licence", "own_score", "licence", "licence_from", "_path", "_text", "_dir")
    names = base.columns
    base = base.withColumns({"_path": F.col(path), "_text": F.coalesce(F.col(text), F.lit(""))})
    known = {**templates, **{f"text {i}": t for i, (_, t) in enumerate(TEXTS)}}
    count, n = template_counts(F.col("_text"), base.select("_text"), known)
    w = Weights(templates, count, n)
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, w.heavy(threshold))) + ")(?![a-z0-9])"
    able = F.filter(sentences(F.col("_text")), lambda s: s.rlike(pattern))
    scored = F.transform(F.transform(able, terms), lambda words: _scores(words, w))
    rank = lambda x: x["score"] + F.when((x["score"] >= threshold) & (x["licence"] != UNNAMED), 1.0).otherwise(0.0)
    best = F.aggregate(scored, F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("licence")), lambda a, b: F.when((rank(b) > rank(a)) | ((rank(b) == rank(a)) & (b["licence"] < a["licence"])), b).otherwise(a))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("licence"))
    name = F.regexp_extract("_path", "([^/]*)$", 1)
    head = F.when(name.rlike(license_file), F.col("_text")).otherwise(F.substring("_text", 1, HEAD))
    tag, title = _marked(head)
    stated = F.when(F.col("_text").rlike(pattern), best).otherwise(none)
    marked = base.withColumn("_best", F.coalesce(tag, _found_texts(terms(head), TEXTS, count, n, max(threshold, THRESHOLD)), title, stated))
    marked = marked.withColumns({
        "own_licence": F.when(F.col("_best.score") >= threshold, F.col("_best.licence")),
        "own_score": F.when(F.col("_best.score") >= threshold, F.col("_best.score")).otherwise(0.0),
        "_dir": F.regexp_extract("_path", "^(.*/)?[^/]*$", 1),
    })
    marked = keep(marked.drop("_best", "_text"), where, "own") if text not in names else marked.drop("_best", "_text")
    # from here on only paths and licences: a pass of its own over the small columns
    small = keep(marked.select("_path", "_dir", "own_licence"), where, "paths")
    licensed = small.where(name.rlike(license_file) & F.col("own_licence").isNotNull() & F.col("_path").isNotNull())
    licensed = keep(licensed.groupBy("_dir").agg(F.min(F.struct("_path", "own_licence"))["own_licence"].alias("inherited")), where, "licensed")
    dirs = small.where("own_licence is null and _dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    above = keep(dirs.select("_dir", F.explode(up).alias("up")), where, "above")
    found = above.join(licensed.withColumnRenamed("_dir", "up"), "up")
    nearest = found.groupBy("_dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "inherited")).alias("m")).select("_dir", "m.up", "m.inherited")
    nearest = keep(nearest, where, "nearest")
    out = marked.join(nearest, "_dir", "left")
    own = F.col("own_licence")
    return out.select(*names, own, "own_score", F.coalesce(own, "inherited").alias("licence"), F.when(own.isNull(), F.col("up")).alias("licence_from"))


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files: a folder for each source, below it one for 64 ids, below it one
    for 8. The first document of a folder is its licence file."""
    d = F.col("doc_id")
    outer = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), (F.floor(d / 64)).cast("string"), F.lit("/"))
    inner = F.concat(outer, (F.floor(d / 8)).cast("string"), F.lit("/"))
    path = F.when(d % 64 == 0, F.concat(outer, F.lit("LICENSE"))).when(d % 8 == 0, F.concat(inner, F.lit("LICENSE"))).otherwise(F.concat(inner, d.cast("string"), F.lit(".txt")))
    return docs.withColumn("path", path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return scan_licences(files).select("doc_id", "path", "own_licence", "own_score", "licence", "licence_from")


_TEMPLATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with t(name, body) as (values {_TEMPLATE_ROWS}),
f as (select doc_id, coalesce(text, '') as text, coalesce(source, '') || '/' || (doc_id // 64) || '/' as outer_dir,
    coalesce(source, '') || '/' || (doc_id // 64) || '/' || (doc_id // 8) || '/' as inner_dir from documents),
p as (select doc_id, text, case when doc_id % 64 = 0 then outer_dir else inner_dir end as dir,
    case when doc_id % 8 = 0 then 'LICENSE' else doc_id || '.txt' end as name, inner_dir, outer_dir from f),
tt as (select name, term, count(*) as k from (select name, unnest(string_split_regex({_LOW.format("body")}, '[^a-z0-9]+')) as term from t) x where term <> '' group by 1, 2),
voc as (select distinct term from tt),
total as (select count(*) as n from documents),
df as (select term, count(distinct doc_id) as n from (select doc_id, unnest(string_split_regex({_LOW.format("text")}, '[^a-z0-9]+')) as term from p) x join voc using (term) group by term),
idf as (select voc.term, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 as w from voc cross join total left join df on df.term = voc.term),
tn as (select name, sqrt(sum(pow(k * w, 2))) as norm from tt join idf using (term) group by name),
s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10))) as body from p),
sr as (select row_number() over () as r, doc_id, body from s where regexp_matches({_LOW.format("body")}, 'licen|reserved|rights|cc|mit|gnu|apache|bsd|mozilla|public')),
sw as (select r, doc_id, term, count(*) as k from (select r, doc_id, unnest(string_split_regex({_LOW.format("body")}, '[^a-z0-9]+')) as term from sr) x where term <> '' group by all),
sn as (select r, sqrt(sum(pow(k * coalesce(w, ln(1 + total.n) + 1), 2))) as norm from sw cross join total left join idf on idf.term = sw.term group by r),
sc as (select sw.r, sw.doc_id, tt.name, round(sum(sw.k * tt.k * pow(w, 2)) / (any_value(sn.norm) * any_value(tn.norm)), 6) as score
  from sw join tt on tt.term = sw.term join idf on idf.term = sw.term join sn on sn.r = sw.r join tn on tn.name = tt.name group by 1, 2, 3),
o as (select doc_id, name as licence, score from sc where score >= {THRESHOLD} qualify row_number() over (partition by doc_id order by score desc, name) = 1),
d as (select p.*, o.licence, o.score from p left join o using (doc_id)),
l as (select dir, licence from d where name = 'LICENSE' and licence is not null),
j as (select d.*, i.licence as li, u.licence as lu from d left join l i on i.dir = d.dir and d.dir = d.inner_dir left join l u on u.dir = d.outer_dir)
select doc_id, dir || name as path, licence as own_licence, coalesce(score, 0.0) as own_score,
  coalesce(licence, li, lu) as licence, case when licence is null then case when li is not null then inner_dir when lu is not null then outer_dir end end as licence_from
from j
"""
