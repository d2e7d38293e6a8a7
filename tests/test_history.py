"""Chains, reachability, trees over time and blame of what is asked for, against brute force and git."""

import datetime
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from strata.operators import chains, graph, temporal
from strata.plans.history import History
from strata.plans.scope import Scope
from strata.storage import scratch_dir
from tests.test_git import Repo, hunks_of, lines

SINCE = datetime.date(2000, 1, 1)
needs_git = pytest.mark.skipif(shutil.which("git") is None, reason="git is not here")


def dag(seed, n=40, merges=0.3):
    """{commit: parents}; commits are numbered in a topological order, their names are not."""
    r = random.Random(seed)
    names = [f"{r.randrange(16**6):06x}{i}" for i in range(n)]
    return {names[i]: [] if i == 0 or r.random() < 0.05 else list(dict.fromkeys(names[max(0, i - 1 - int(r.expovariate(0.4)))] for _ in range(2 if r.random() < merges else 1))) for i in range(n)}


def tables(spark, g):
    commits = spark.createDataFrame([(c,) for c in g], "sha string")
    return commits, spark.createDataFrame([(c, k, p) for c, ps in g.items() for k, p in enumerate(ps)], "sha string, parent_position int, parent_sha string")


def above(g, c):
    out, todo = set(), [c]
    while todo:
        x = todo.pop()
        if x not in out:
            out.add(x)
            todo += g[x]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_and_reach(spark, seed):
    g = dag(seed)
    commits, parents = tables(spark, g)
    where = scratch_dir(spark)
    found = chains.chains(commits, parents, where)
    rows = {r["sha"]: r for r in found.collect()}
    assert set(rows) == set(g)
    at = {(r["chain"], r["pos"]): c for c, r in rows.items()}
    assert len(at) == len(g)
    for c, r in rows.items():
        if r["pos"]:  # the one before it is its first parent
            assert at[r["chain"], r["pos"] - 1] == g[c][0]
        else:
            assert r["chain"] == c and r["fork"] == (g[c][0] if g[c] else None)
    tips = random.Random(seed).sample(sorted(g), 5)
    labels = chains.reach(spark.createDataFrame([(t, t) for t in tips], "root string, sha string"), found, parents, where)
    got = {}
    for r in chains.ancestors(labels, found).collect():
        got.setdefault(r["root"], set()).add(r["sha"])
    assert got == {t: above(g, t) for t in tips}
    for a, b in [(tips[0], tips[1]), (tips[2], tips[3]), (tips[4], tips[4])]:
        common = above(g, a) & above(g, b)
        best = {c for c in common if not any(c != d and c in above(g, d) for d in common)}
        assert {r["sha"] for r in chains.merge_bases(a, b, found, parents, where).collect()} == best
        assert {r["sha"] for r in graph.merge_bases(a, b, parents).collect()} == best


def test_criss_cross_and_unrelated(spark):
    g = {"r": [], "a": ["r"], "b": ["r"], "x": ["a", "b"], "y": ["b", "a"], "z": [], "lone": ["gone"]}
    commits, parents = tables(spark, g)
    found = chains.chains(commits, parents, scratch_dir(spark))
    bases = lambda a, b: {r["sha"] for r in chains.merge_bases(a, b, found, parents, scratch_dir(spark)).collect()}
    assert bases("x", "y") == {"a", "b"} and bases("x", "z") == set() and bases("r", "y") == {"r"}
    assert {r["sha"]: r["fork"] for r in found.where("sha = 'lone'").collect()} == {"lone": None}


def test_a_long_history_takes_few_rounds(spark, monkeypatch):
    made, keep = [], chains.keep
    monkeypatch.setattr(chains, "keep", lambda df, where, name: made.append(name) or keep(df, where, name))
    n = 1_000_000
    commits = spark.range(n).select(F.col("id").alias("sha"))
    parents = spark.range(1, n).select(F.col("id").alias("sha"), F.lit(0).alias("parent_position"), (F.col("id") - 1).alias("parent_sha"))
    found = chains.chains(commits, parents, scratch_dir(spark))
    assert found.where("chain = 0 and pos = sha").count() == n
    assert [r["sha"] for r in chains.merge_bases(n - 1, n // 2, found, parents, scratch_dir(spark)).collect()] == [n // 2]
    assert len(made) < 32


@pytest.mark.parametrize("seed", [4, 5])
def test_trees_over_time(spark, seed):
    r, g = random.Random(seed), dag(seed, 30)
    trees = {}
    for c, ps in g.items():
        tree = dict(trees[ps[0]]) if ps else {}
        for _ in range(r.randrange(4)):
            path = f"p{r.randrange(8)}"
            if r.random() < 0.25:
                tree.pop(path, None)
            else:
                tree[path] = f"b{r.randrange(50)}"
        trees[c] = tree
    commits, parents = tables(spark, g)
    found = chains.chains(commits, parents, scratch_dir(spark))
    changes = []
    for c, ps in g.items():
        old = trees[ps[0]] if ps else {}
        changes += [(c, p, trees[c].get(p)) for p in old.keys() | trees[c].keys() if old.get(p) != trees[c].get(p)]
    places = temporal.placed(spark.createDataFrame(changes, "commit string, path string, blob string"), found)
    held = temporal.intervals(places)
    assert held.count() == len(changes)
    segs = temporal.segments(commits.select(F.col("sha").alias("commit")), found, scratch_dir(spark))
    got = {c: {} for c in g}
    for x in temporal.tree_at(segs, held).collect():
        got[x["commit"]][x["path"]] = x["blob"]
    assert got == trees
    asked = spark.createDataFrame([(c, f"p{k}") for c in g for k in range(9)], "commit string, path string")
    assert {(x["commit"], x["path"]): x["blob"] for x in temporal.file_at(asked, segs, places).collect()} == {(c, p): b for c in g for p, b in trees[c].items()}


def blame_of(repo, rev, path):
    out = {}
    for x in repo.git("blame", "--line-porcelain", rev, "--", path).splitlines():
        if m := re.match(r"([0-9a-f]{40}) (\d+) (\d+)", x):
            out[int(m[3])] = (m[1], int(m[2]))
    return out


def expanded(rows):
    return {(r["commit"], r["path"], r["final_start"] + k): (r["blamed"], r["origin_start"] + k) for r in rows for k in range(r["line_count"])}


@needs_git
def test_only_what_is_visited_is_diffed(spark, tmp_path):
    r = Repo(tmp_path)
    shas = [r.commit(f"{i}", {f"f{i}.txt": lines(*range(i * 10, i * 10 + 5))}) for i in range(6)]
    h = History.from_git(spark, r.path)
    t = h.trace("f5.txt:1", since=SINCE)
    assert t.tables["blame_requests"].count() == 1 and {x["edge_type"] for x in t.tables["lineage_edges"].collect()} == {"introduced_here"}
    assert [tuple(x) for x in h.diffed["events"].collect()] == [tuple(x) for x in h.diffed["hunks"].collect()] == [(shas[5], 0)]
    assert [x["path"] for x in t.scope.covered.collect()] == ["f5.txt"] and [x["line_count"] for x in t.scope.spans.collect()] == [5]
    assert t.tables["file_events"].count() == 1 and t.tables["diff_hunks"].count() == 1
    h.trace("f5.txt:2", since=SINCE).tables  # known already
    assert h.diffed["events"].count() == h.diffed["hunks"].count() == 1
    # a file that was moved, and edited by a commit that no line of the request leads to
    last = r.commit("edit f0", {"f0.txt": lines(0, 1, "two", 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)})
    r.git("mv", "f0.txt", "g.txt")
    moved = r.commit("move")
    r.commit("edit the end", {"g.txt": lines(0, 1, "two", 3, 4, 5, 6, 7, 8, 9, 10, 11, "end")})
    h = History.from_git(spark, r.path)
    t = h.trace("g.txt:3", since=SINCE)
    edges = {(x["edge_type"], x["parent_sha"]) for x in t.tables["lineage_edges"].collect()}
    assert ("recurse_to_parent", shas[5]) in edges and ("root_commit", None) in edges
    assert {tuple(x) for x in h.diffed["hunks"].collect()} == {(last, 0)}  # the move is followed, its lines aren't diffed
    assert {tuple(x) for x in h.diffed["events"].collect()} == {(last, 0), (moved, 0)}
    assert {x["path"] for x in t.scope.covered.collect()} == {"f0.txt", "g.txt"}
    assert all(x["broken"] == 0 for x in t.validate().collect())


@needs_git
@pytest.mark.parametrize("seed", [1, 2])
def test_random_repositories(spark, tmp_path, seed):
    """Branches, merges, moves and edits of files with lines that never repeat."""
    rng, r, n = random.Random(seed), Repo(tmp_path), [0]

    def fresh(k):
        n[0] += k
        return [f"unique line {i} {rng.random()}" for i in range(n[0] - k, n[0])]

    trees = {"main": {f"d/{i}.txt": fresh(12) for i in range(4)}}
    write = lambda m, t, gone=(): r.commit(m, {p: "\n".join(x) + "\n" for p, x in t.items()}, remove=gone)
    write("root", trees["main"])
    here = "main"
    for step in range(14):
        t, kind = trees[here], rng.random()
        if kind < 0.2 and len(trees) < 3:
            new = f"b{step}"
            r.git("checkout", "-q", "-b", new)
            trees[new], here = {p: list(x) for p, x in t.items()}, new
            t = trees[here]
        elif kind < 0.35 and len(trees) > 1:
            other = rng.choice([b for b in trees if b != here])
            try:
                r.git("merge", "-q", "--no-ff", "-m", f"merge {step}", other)
                for p in r.git("ls-files").split():
                    t[p] = r.git("show", f"HEAD:{p}").splitlines()
                for p in set(t) - set(r.git("ls-files").split()):
                    del t[p]
            except Exception:
                r.git("merge", "--abort")
            continue
        elif kind < 0.5:
            p = rng.choice(sorted(t))
            q = f"m{step}.txt"
            r.git("mv", p, q)
            t[q] = t.pop(p)
        elif kind < 0.6 and len(trees) > 1:
            here = rng.choice(sorted(trees))
            r.git("checkout", "-q", here)
            continue
        for p in rng.sample(sorted(t), min(2, len(t))):
            x, at = t[p], rng.randrange(len(t[p]))
            x[at : at + rng.randrange(2)] = fresh(rng.randrange(3))
            if not x:
                x += fresh(1)
        write(f"step {step}", t)
    h = History.from_git(spark, r.path)
    # trees
    revs = r.git("rev-list", "--all").split()
    got = {}
    for x in h.tree(*revs).collect():
        got.setdefault(x["commit"], {})[x["path"]] = x["blob"]
    want = {}
    for c in revs:
        for e in r.git("ls-tree", "-r", c).splitlines():
            meta, path = e.split("\t")
            want.setdefault(c, {})[path] = meta.split()[2]
    assert got == want
    # blame of the head's files, of two of them first
    head = h.resolve("HEAD")
    scope = Scope(h, spark.createDataFrame([(head,)], "sha string"))
    paths, lines_ = sorted(got[head]), {}
    for p in paths:
        for k, v in blame_of(r, head, p).items():
            lines_[head, p, k] = v
    for some in (paths[:2], paths):
        asked = spark.createDataFrame([(head, p, 1, 10_000) for p in some], "commit string, path string, s long, e long")
        assert expanded(scope.blame(asked).collect()) == {k: v for k, v in lines_.items() if k[1] in some}
    # the two ways to make a history
    from strata.sources import gitrepo

    other = History.from_trees(h.commits, gitrepo.read(spark, r.path, "trees"), h.blobs)
    assert sorted(map(str, other.changes.collect())) == sorted(map(str, h.changes.collect()))
    for x in h.commits.where(F.size("parents") == 1).limit(4).collect():
        rows = h.steps_of(spark.createDataFrame([(x["sha"],)], "commit string"))[1].where(F.col("commit") == x["sha"]).collect()
        assert sorted((y["new_path"], y["old_start"], y["old_lines"], y["new_start"], y["new_lines"]) for y in rows) == hunks_of(r, x["parents"][0], x["sha"])


def test_intervals_of_one_file(spark):
    """100,000 hunks and 100,000 spans of one path, without meeting each other all."""
    from strata.operators import intervals

    n = 100_000
    hunks = spark.range(n).select(F.lit("p").alias("path"), (F.col("id") * 10).alias("hs"), (F.col("id") * 10 + F.col("id") % 7).alias("he"), F.col("id").alias("h"))
    spans = spark.range(n).select(F.lit("p").alias("path"), (F.col("id") * 10 + 3).alias("ss"), (F.col("id") * 10 + 12).alias("se"), F.col("id").alias("s"))
    got = intervals.overlaps(hunks, spans, ["path"], ("hs", "he"), ("ss", "se"))
    # a span meets its own hunk from 4 lines on, and the two first lines of the next, if it has any
    assert got.count() == sum(k % 7 > 3 for k in range(n)) + sum(k % 7 > 0 for k in range(1, n))
    assert got.where("not (hs < se and ss < he)").count() == 0


def test_intervals_against_all_pairs(spark):
    from strata.operators import intervals

    r = random.Random(3)
    make = lambda n: [(r.choice("ab"), s := r.randrange(300), s + r.choice([0, 1, 5, 64, 200]), i) for i in range(n)]
    a, b = make(80), make(80)
    da, db = spark.createDataFrame(a, "k string, s long, e long, i long"), spark.createDataFrame(b, "k string, t long, f long, j long")
    for width in (1, 16, 64, 1000):
        got = sorted((x["i"], x["j"]) for x in intervals.overlaps(da, db, ["k"], ("s", "e"), ("t", "f"), width).collect())
        assert got == sorted((i, j) for k, s, e, i in a for q, t, f, j in b if k == q and max(s, t) < min(e, f))


def test_stretches(spark):
    """Versions as random edits, two parents now and then, against pointers of single lines."""
    from strata.operators import blame

    r = random.Random(8)
    versions, blocks = {0: [(0, i + 1) for i in range(20)]}, []
    for v in range(1, 9):
        lines, rows = [], []
        for pos, p in enumerate([v - 1] if v % 3 else [v - 1, max(v - 3, 0)]):
            at = 1
            while at <= len(versions[p]):
                size = r.randrange(1, 6)
                rows.append((pos, p, at, min(size, len(versions[p]) + 1 - at)))
                at += size + r.randrange(3)
        used, owner = [], {}
        start = 1
        for pos, p, old, size in sorted(rows, key=lambda x: (x[2], x[0])):
            start += r.randrange(2) if pos == 0 else -r.randrange(2)  # blocks of the second parent may overlap
            start = max(start, 1)
            used.append((v, pos, start, size, p, old))
            for k in range(size):
                if (start + k) not in owner or pos < owner[start + k][0]:
                    owner[start + k] = (pos, p, old + k)
            start += size
        first = [x for x in used if x[1] == 0]
        ok = all(x[2] + x[3] <= y[2] for x, y in zip(first, first[1:]))
        second = [x for x in used if x[1] == 1]
        ok = ok and all(x[2] + x[3] <= y[2] for x, y in zip(second, second[1:]))
        if not ok:
            used = first = [x for x in used if x[1] == 0 and x is used[0]]
            owner = {x[2] + k: (0, x[4], x[5] + k) for x in first for k in range(x[3])}
        n = max(owner, default=0) + r.randrange(3)
        for i in range(1, n + 1):
            lines.append(versions[owner[i][1]][owner[i][2] - 1] if i in owner else (v, i))
        versions[v] = lines
        blocks += used
    b = spark.createDataFrame(blocks, "node int, parent_position int, start long, size long, to int, to_start long")
    sizes = spark.createDataFrame([(v, len(x)) for v, x in versions.items()], "node int, n long")
    end = blame.jump_segments(blame.segments(b, sizes, ["node"]), scratch_dir(spark))
    got = {(x["node"], x["start"] + k): (x["root"], x["root_start"] + k) for x in end.collect() for k in range(x["size"])}
    assert got == {(v, i + 1): o for v, x in versions.items() for i, o in enumerate(x)}
    spans = blame.merged(end.select("node", "start", "size", F.col("root").alias("blamed"), F.lit("p").alias("origin_path"), F.col("root_start").alias("origin_start")), ["node"])
    assert {(x["node"], x["final_start_line"] + k): (x["blamed"], x["origin_start_line"] + k) for x in spans.collect() for k in range(x["line_count"])} == got


def test_moved_blocks():
    from strata.operators import diff

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcdef") * 3 for _ in range(r.randrange(12))] for _ in range(2))
        free = [r.random() < 0.7 for _ in b]
        want, j = [], 0
        while j < len(b):
            size, at = 0, 0
            # the longest match of the whole rest, of its first place, cut to the free lines
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                size, at = (k, i) if k > size else (size, at)
            size = min(size, next((k for k, f in enumerate(free[j:]) if not f), len(b) - j))
            if size and 3 * size >= 6:
                want.append((at, j, size))
                j += size
            else:
                j += 1
        got = diff.moves(a, b, free, 6)
        assert [x[1:] for x in got] == [x[1:] for x in want] and all(a[i : i + n] == b[j : j + n] for i, j, n in got)
    assert diff.moves([None, "x" * 30], [None, "x" * 30], [True, True], 20) == [(1, 1, 1)] and diff.moves([], ["a"], [True], 1) == []
    many = ["}"] * 20_000
    assert diff.moves(many, many, [True] * len(many), 20)[0][2] == 20_000


@needs_git
def test_moves_within_a_file(spark, tmp_path):
    r = Repo(tmp_path)
    body = [f"line {k} with a number of its own {k * 7919}" for k in range(30)]
    text = lambda x: "\n".join(x) + "\n"
    r.commit("one", {"f": text(body)})
    r.commit("two", {"f": text([*body[:3], "an edit in between, of the second commit", *body[4:]])})
    now = [*body[:3], "an edit in between, of the second commit", *body[4:]]
    last = r.commit("three", {"f": text([*now[22:27], *now[:22], "something that is new here", *now[27:]])})
    for moved, flag in ((0, []), (20, ["-M"])):
        h = History.from_git(spark, r.path, moved=moved)
        t = h.trace("f:1-31", since=SINCE, max_depth=0)
        got = {x["final_start_line"] + k: (x["blamed_commit_sha"], x["origin_start_line"] + k) for x in t.tables["blame_spans"].collect() for k in range(x["line_count"])}
        want = {}
        for x in r.git("blame", *flag, "--line-porcelain", last, "--", "f").splitlines():
            if m := re.match(r"([0-9a-f]{40}) (\d+) (\d+)", x):
                want[int(m[3])] = (m[1], int(m[2]))
        assert got == want and len({c for c, _ in got.values()}) == 3


def test_texts_take_no_part_in_counting_lines(spark, monkeypatch):
    """The sizes of versions come from a join with a number for each content, not with its lines."""
    from strata.operators import blame

    commits = spark.createDataFrame([("a", []), ("b", ["a"])], "sha string, parents array<string>")
    trees = spark.createDataFrame([("a", "f", "x"), ("b", "f", "y")], "commit string, path string, blob string")
    blobs = spark.createDataFrame([("x", False, ["1", "2"]), ("y", False, ["1", "3", "2"])], "blob string, is_binary boolean, lines array<string>")
    seen, real = [], blame.segments
    monkeypatch.setattr(blame, "segments", lambda blocks, sizes, by: seen.append(sizes) or real(blocks, sizes, by))
    asked = spark.createDataFrame([("b", "f", 1, 3)], "commit string, path string, s long, e long")
    found = Scope(History.from_trees(commits, trees, blobs)).blame(asked)
    got = {(r["final_start"], r["line_count"], r["blamed"], r["origin_start"]) for r in found.collect()}
    assert got == {(1, 1, "a", 1), (2, 1, "b", 2), (3, 1, "a", 2)}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "size(lines" in plan and "size(lines" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("moved", [0, 20])
def test_versions_are_compared_by_digests(spark, monkeypatch, moved):
    """Texts don't take part in the joins of versions; where moved lines are measured, they have to."""
    from strata.operators import diff

    old, new = ["1" * 99, None, "2", "2"], ["2", "1" * 99, None, "3", "2"]
    commits = spark.createDataFrame([("a", []), ("b", ["a"])], "sha string, parents array<string>")
    trees = spark.createDataFrame([("a", "f", "x"), ("b", "f", "y")], "commit string, path string, blob string")
    blobs = spark.createDataFrame([("x", False, old), ("y", False, new)], "blob string, is_binary boolean, lines array<string>")
    seen, real = [], diff.lcs_blocks
    monkeypatch.setattr(diff, "lcs_blocks", lambda pairs, *a: seen.append(pairs) or real(pairs, *a))
    asked = spark.createDataFrame([("b", "f", 1, 5)], "commit string, path string, s long, e long")
    found = Scope(History.from_trees(commits, trees, blobs), moved=moved).blame(asked)
    lines = {r["final_start"] + k: (r["blamed"], r["origin_start"] + k) for r in found.collect() for k in range(r["line_count"])}
    assert lines == {1: ("b", 1), 2: ("a", 1), 3: ("a", 2), 4: ("b", 4), 5: ("a", 4)}
    assert dict(seen[0].dtypes)["old"] == dict(seen[0].dtypes)["new"] == ("array<string>" if moved else "array<binary>")
