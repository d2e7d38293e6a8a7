"""Steps that must not shuffle, join or repeat more than their input needs."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strata import fixtures as fx
from strata.operators import blame, diff, graph, intervals

DIR = os.environ.get("STRATA_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["added_ranges", "diff_hunks", "edit_script", "patch_text", "patch_by_id", "seed_branch"])
def test_scripts_shuffle_texts_once(spark, name):
    p = plan(entry.queries()[name](spark, DIR))
    assert p.count("Exchange") == 1 and "Join" not in p


@pytest.mark.parametrize("name", ["carried_lines", "lcs_diff", "blame_lines", "blame_spans"])
def test_versions_shuffle_texts_once(spark, name):
    p = plan(entry.queries()[name](spark, DIR))
    assert p.count("Exchange") == 1 and "Join" not in p


def test_lines_that_come_back(spark):
    """A line that was gone for a version is a new one; nulls and repeated lines are as a join has them."""
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 2, 1, "a"), (1, 2, 2, "b"), (1, 3, 1, "a"), (None, 0, 1, "a"), (None, 1, 1, "a"), (2, 0, 1, None), (2, 1, 1, None), (3, 0, 1, "x"), (3, 0, 2, "x"), (3, 1, 1, "x")]
    lines = spark.createDataFrame(rows, "f int, v int, line_no long, line string")
    got = {(r.f, r.v, r.line_no, r.parent_line) for r in blame.carried(lines, ["f"]).collect()}
    assert got == {(1, 1, 1, 2), (1, 2, 2, 1), (1, 3, 1, 1), (3, 1, 1, 1), (3, 1, 1, 2)}
    came = {(r.v, r.line_no, r.blamed, r.origin_line) for r in blame.origins(lines.where("f = 1"), ["f"]).collect()}
    assert came == {(0, 1, 0, 1), (0, 2, 0, 2), (1, 1, 0, 2), (2, 1, 2, 1), (2, 2, 0, 2), (3, 1, 2, 1)}
    made = blame.script(lines.where("f = 1"), ["f"], 0, 3).orderBy("v", "segment", "kind", F.coalesce("old_line", "new_line"))
    assert [(r.v, r.kind, r.segment, r.old_line, r.new_line, r.line) for r in made.collect()] == [
        (1, 1, 0, 1, None, "a"), (1, 0, 1, 2, 1, "b"), (2, 2, 0, None, 1, "a"), (2, 0, 1, 1, 2, "b"), (3, 0, 1, 1, 1, "a"), (3, 1, 1, 2, None, "b")]


def test_small_tables_meet_dealt_ones(spark):
    """What a level of a trace asks for is brought to the tables of commits, which stay where they are."""
    from strata.plans import lineages

    run = lineages.Run(spark, DIR)
    run.parts = 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = run.table("seeds").select("commit").distinct()
        for df in run.diffs(asked):
            p = plan(df)
            assert p.count("Bucketed: true") == 1 and "Exchange hashpartitioning(sha" not in p
        blamed = fx.blame_asked(run.table("seeds"), run.table("touches"), run.info())
        assert plan(blamed).count("Bucketed: true") == 3  # the questions' commits are looked up for both sides
        want = run.table("blame").join(run.table("seeds").select("commit", "path").distinct(), ["commit", "path"])
        assert sorted(blamed.collect()) == sorted(want.select(*blamed.columns).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("strata_")]


def test_steps_are_not_gathered_at_each_level(spark):
    steps = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")], "node string, next string")
    start = spark.createDataFrame([(1, "a")], "root int, node string")
    assert sorted(tuple(r) for r in graph.reach(start, steps).collect()) == [(1, "a", 0), (1, "b", 1), (1, "c", 2)]
    p = plan(graph.walk(spark.createDataFrame([(1, 2)], "from_request_id int, next_request_id int"), start.selectExpr("root", "1 as node")))
    assert "Aggregate" not in p


def test_points_in_spans(spark):
    rng = random.Random(3)
    points = [(k, rng.randrange(900)) for k in (1, 2) for _ in range(60)]
    spans = [(k, b, None if rng.random() < 0.2 else b + rng.choice([0, 1, 5, 64, 300])) for k in (1, 2, 3) for b in (rng.randrange(950) for _ in range(40))]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "i int, k int, at long")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "j int, k int, b long, e long")
    want = sorted((i, j) for i, (k, at) in enumerate(points) for j, (l, b, e) in enumerate(spans) if k == l and b <= at and (e is None or at < e))
    for width in (1, 8, 64):
        assert sorted((r.i, r.j) for r in intervals.holding(p, s, ["k"], "at", ("b", "e"), width).collect()) == want


def test_copies_of_similar_files_meet_once(spark):
    """The old files of a set of lines stand for one, the new ones all have its row; pairs don't grow with copies."""
    old = [(1, f"a/{k}", x) for k in range(1, 31) for x in "uvwxyz"] + [(1, "a/9b", x) for x in "uvwxy"]
    new = [(1, f"b/{k}", x) for k in range(40) for x in "vwxyz"]
    sides = [spark.createDataFrame(x, "commit int, path string, line string") for x in (old, new)]
    got = diff.similar_files(*sides, ["commit"], 50)
    assert sorted(tuple(r) for r in got.collect()) == sorted((1, "a/1", f"b/{k}", 83) for k in range(40))


def test_similar_files_read_texts_once(spark):
    """What is compared are hashes that were kept; files whose sizes don't allow the score never meet, those at the bound do."""
    p = plan(entry.queries()["rename_similarity"](spark, DIR))
    assert "FileScan" in p and "documents.parquet" not in p and "split(" not in p
    old = [(1, "a/1", x) for x in "abcdef"] + [(1, "a/2", x) for x in "abcdefg"]
    sides = [spark.createDataFrame(x, "commit int, path string, line string") for x in (old, [(1, "b/1", x) for x in "abc"])]
    assert [tuple(r) for r in diff.similar_files(*sides, ["commit"], 50).collect()] == [(1, "a/1", "b/1", 50)]
    assert "least" in diff.similar_files(*sides, ["commit"], 50)._jdf.queryExecution().optimizedPlan().toString()
