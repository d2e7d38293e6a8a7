"""Whatever a caller's columns are called, rows and columns come back as they were."""

import time

import pytest
from pyspark.sql import functions as F

from strata.llm import op1_url_filter as op1
from strata.llm import op2_quality as op2
from strata.llm import op3_language as op3
from strata.llm import op4_jaccard as op4
from strata.llm import op5_substrings as op5
from strata.llm import op7_license as op7
from strata.llm import op8_decontaminate as op8
from strata.llm import op9_toxicity as op9

PRIVATE = "_listed _found _host _text _bad _key _letter _no _id _t1 _t2 _rows _s1 _s2 _size _spans _path _dir _best _h1 _h2 _leaks id t1 t2 n node comp token key h rows row rep seed item line docs of host2 up inherited m b c text2 f".split()
TEXTS = [
    "some words of a text that is long enough to be a document of its own " * 5, "some words of a text that is long enough to be a document of its own " * 5,
    "les mots de ce texte sont encore des mots, et la suite aussi " * 6, None, "", "MIT License\nPermission is hereby granted", "// SPDX-License-Identifier: MIT",
]


def models(spark):
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(TEXTS * 3) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    return op3.fit(docs, F.lit(True)), op9.fit(docs, labels, F.lit(True))


@pytest.fixture(scope="module")
def cases(spark):
    from strata.llm.common import bounded_batches

    bounded_batches(spark)
    language, toxic = models(spark)
    items = spark.createDataFrame([(1, "a text that is long enough to be a document of its own")], "item_id long, text string")
    return {
        "op1": lambda d: op1.filter_urls(d), "op2": lambda d: op2.quality_rules(d, min_docs=2), "op3": lambda d: op3.identify(d, language),
        "op4": lambda d: op4.one_of_each(d), "op5": lambda d: op5.remove_repeats(d, span=40, kgram=8), "op7": lambda d: op7.scan_licences(d),
        "op8": lambda d: op8.mark_leaks(d, items), "op9": lambda d: op9.score(d, toxic),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op8", "op9"])
def test_private_names(spark, cases, name):
    rows = [(i, t, "s", f"d/{i}", f"http://x{i}.org/a") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, path string, url string")
    docs = docs.drop("path") if name == "op1" else docs  # a result there
    plain = cases[name](docs)
    more = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in PRIVATE), F.lit("x").alias("a.b c"))
    got = cases[name](more)
    new = [c for c in plain.columns if c not in docs.columns]
    assert got.columns == [*more.columns, *new]
    rows = got.collect()
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in PRIVATE) and all(r["a.b c"] == "x" for r in rows)
    # columns that are called like results are replaced
    if new:
        assert cases[name](docs.withColumn(new[-1], F.lit("mine"))).columns == plain.columns


def test_a_line_of_many_words(spark):
    long = "this license line has " + " ".join(f"word{i}" for i in range(100_000)) + " under the license"
    files = spark.createDataFrame([(1, "a/x", long), (2, "a/y", "All rights reserved.")], "doc_id long, path string, text string")
    began = time.time()
    got = {r["doc_id"]: r["own_licence"] for r in op7.scan_licences(files).collect()}
    assert got[1] is None and got[2] is not None and time.time() - began < 60
