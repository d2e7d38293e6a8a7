"""The two jobs: runs over growing input, broken-off and repeated runs, reruns, the command line."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import line_origins, responsibility

DIR = os.environ.get("STRATA_TEST_DIR", "/root/testdata/sf0.001")
BLOCK = ["the first line of a block", "and its second line, longer", "", "a third line after a gap"]
FIRST = [(10, "\n".join(["only of document ten", *BLOCK]), "repo"), (11, "\n".join([*BLOCK, *BLOCK, "x"]), "repo"), (12, "\n".join(BLOCK), None), (13, None, "repo"), (None, "a line of no document", "repo")]
SECOND = [(20, "\n".join(["new in document twenty", *BLOCK[:2], "only of document ten"]), "repo"), (5, "\n".join(["new in document twenty", BLOCK[1], "new in document five!"]), "repo"), (21, "", "other"), (22, "\n".join(BLOCK), None)]


def brute(batches, least=12):
    """Spans by a loop over batches in the order of arrival."""
    place, out = {}, []
    for rows in batches:
        lines = sorted((d, i + 1, s or "", x) for d, t, s in rows if d is not None and t is not None for i, x in enumerate(t.split("\n")))
        for d, i, s, x in lines:
            if len(x.strip(" ")) >= least:
                place.setdefault((s, x), (d, i))
        last = None
        for d, i, s, x in lines:
            o = place[s, x] if len(x.strip(" ")) >= least else (d, i)
            if last and last[0] == d and last[4] == o[0] and last[5] + last[3] == o[1] and last[2] + last[3] == i:
                last[3] += 1
            else:
                last = [d, s, i, 1, *o]
                out.append(last)
    return sorted(map(tuple, out))


def spans(spark, out):
    return sorted(tuple(r) for r in line_origins.read(spark, out).select("doc_id", "source", "final_start_line", "line_count", "origin_doc", "origin_start_line").collect())


def files(out):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for top in ("spans", "origins") for d, _, names in os.walk(f"{out}/{top}") for f in names if f.startswith("part-")}


def add(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).coalesce(1).write.mode("append").parquet(folder)


def test_growing_input(spark, tmp_path):
    docs, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    add(spark, FIRST, docs)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    line_origins.run(spark, docs, out)
    assert spans(spark, out) == brute([FIRST])
    held = files(out)
    line_origins.run(spark, docs, out)  # nothing new: nothing is written
    assert files(out) == held
    add(spark, SECOND, docs)
    line_origins.run(spark, docs, out)
    assert spans(spark, out) == brute([FIRST, SECOND])
    assert held.items() <= files(out).items()  # what was written stays
    new = spark.read.parquet(f"{out}/spans").where("batch = 1").select("doc_id").distinct().collect()
    assert {r[0] for r in new} == {20, 5, 21, 22}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_a_batch_that_was_broken_off_is_taken_again(spark, tmp_path):
    docs, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    add(spark, FIRST, docs)
    line_origins.run(spark, docs, out)
    add(spark, SECOND, docs)
    line_origins.run(spark, docs, out)
    want = spans(spark, out)
    # the second batch wrote, but was not marked as done
    for name in ("1", ".1.crc"):
        os.remove(f"{out}/checkpoint/commits/{name}")
    line_origins.run(spark, docs, out)
    assert spans(spark, out) == want
    assert {r[0] for r in spark.read.parquet(f"{out}/origins").select("batch").distinct().collect()} == {0, 1}


def test_parts_and_config(spark, tmp_path):
    docs, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    for rows in (FIRST, SECOND):
        add(spark, rows, docs)
    line_origins.run(spark, docs, out, {"max_files_per_trigger": 1, "min_chars": 3, "buckets": 2})
    assert spans(spark, out) in (brute([FIRST, SECOND], 3), brute([SECOND, FIRST], 3))
    line_origins.run(spark, docs, out, {"max_files_per_trigger": 1, "min_chars": 3, "buckets": 2})
    assert spark.read.parquet(f"{out}/spans").select("batch").distinct().count() == 2
    empty = f"{tmp_path}/none"
    spark.createDataFrame([], line_origins.DOCUMENTS).write.parquet(empty)
    line_origins.run(spark, empty, f"{tmp_path}/nothing")
    assert spans(spark, f"{tmp_path}/nothing") == []


def test_random_histories(spark, tmp_path):
    import random

    r = random.Random(4)
    pool = [f"line number {k} of the pool" for k in range(30)] + ["", "}"]
    batches, docs, out = [], f"{tmp_path}/documents", f"{tmp_path}/out"
    for b in range(3):
        rows = []
        for d in range(8):
            text, at = [], 0
            while len(text) < 25:
                at = r.randrange(len(pool)) if r.random() < 0.3 else (at + 1) % len(pool)
                text.append(pool[at])
            rows.append((b * 100 + d, "\n".join(text), r.choice(["a", "b", None])))
        batches.append(rows)
        add(spark, rows, docs)
        line_origins.run(spark, docs, out)
    assert spans(spark, out) == brute(batches)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_report_is_replaced_as_a_whole(spark, tmp_path):
    tables, out = f"{tmp_path}/tables", f"{tmp_path}/out"
    orders = spark.read.parquet(f"{DIR}/orders.parquet")
    orders.write.parquet(f"{tables}/orders.parquet")
    spark.read.parquet(f"{DIR}/lineitem.parquet").write.parquet(f"{tables}/lineitem.parquet")
    rows = lambda: sorted(map(tuple, responsibility.read(spark, out).collect()))
    responsibility.run(spark, tables, out)
    full = rows()
    responsibility.run(spark, tables, out)
    assert rows() == full and full
    orders.where("o_orderdate < '1997-01-01'").write.parquet(f"{tables}/fewer.parquet")
    os.rename(f"{tables}/orders.parquet", f"{tables}/old.parquet")
    os.rename(f"{tables}/fewer.parquet", f"{tables}/orders.parquet")
    responsibility.run(spark, tables, out)
    found = rows()
    assert found and found != full and all(r[-1] < "1997" for r in found)
    responsibility.run(spark, tables, out, {"max_depth": 0})
    assert all(r[5] == 0 and r[6] == 0 for r in rows())


def test_report_of_spans(spark):
    spans = spark.createDataFrame([(1, 0, 7, 3), (1, 2, 7, 4), (2, 1, 8, 5)], "commit long, depth int, blamed long, line_count long")
    edges = spark.createDataFrame([(7, "recurse_to_parent"), (7, "max_depth"), (7, "introduced_here"), (7, "root_commit")], "blamed long, edge_type string")
    commits = spark.sql("select * from values (7L, 1L, date '2020-02-03'), (8L, 2L, null) as c(sha, author, committed_on)")
    got = sorted(tuple(r) for r in responsibility.report(spans, edges, commits).drop("committed_on").collect())
    assert got == [(7, 1, 2, 7, 0, 1, 1, 2, "2020-02"), (8, 2, 1, 5, 1, 0, 0, 0, "unknown")]


def test_command_line(spark, tmp_path):
    docs, out, config = f"{tmp_path}/documents", f"{tmp_path}/out", f"{tmp_path}/config.json"
    add(spark, FIRST, docs)
    with open(config, "w") as f:
        json.dump({"min_chars": 12, "buckets": 4, "max_files_per_trigger": 10}, f)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.line_origins", docs, out, "--config", config], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read" in done.stderr
    assert spans(spark, out) == brute([FIRST])
