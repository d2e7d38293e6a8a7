"""Queries over fixture B: the commit graph, the planner, the lineage and what is asked of it."""

from __future__ import annotations

import os
import shutil
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import fixtures as fx
from strata.functions.summary import summary as run_summary
from strata.operators import chains, graph, planner, temporal, validate
from strata.schema import RECURSE
from strata.sources import gitrepo
from strata.storage import keep, keep_dealt, scratch_dir

KEY = planner.KEY
#: Commits in a part of a table that is dealt by commit.
PART = 50_000
#: How tables that small ones are joined with are dealt.
DEALT = {"commits": ["sha"], "parents": ["sha"], "hunks": ["sha"], "events": ["commit"], "info": ["commit"], "touches": ["author", "path"]}
_runs: dict[tuple, Run] = {}


class Run:
    """Fixture B's tables and lineage; each part is made once, when first asked for, and kept as a table."""

    def __init__(self, spark: SparkSession, sf_dir: str, since: str = fx.SINCE, max_depth: int = fx.MAX_DEPTH, exact_ranges: bool = False):
        self.spark, self.sf_dir, self.where, self.made = spark, sf_dir, scratch_dir(spark), {}
        self.since, self.max_depth, self.exact_ranges = since, max_depth, exact_ranges

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Run:
        key = (spark.sparkContext.applicationId, sf_dir, *(fx.state(spark, sf_dir, t) for t in ("orders", "lineitem")))
        if key not in _runs:
            _runs.clear()
            _runs[key] = cls(spark, sf_dir)
        return _runs[key]

    def table(self, name: str) -> DataFrame:
        if name in ("requests", "spans", "edges"):
            return getattr(self.trace, name).drop("span")
        if name not in self.made:
            df = getattr(self, f"_{name}")()
            self.made[name] = keep_dealt(df, self.where, name, DEALT[name], self.parts) if name in DEALT else keep(df, self.where, name)
        return self.made[name]

    @cached_property
    def parts(self) -> int:
        return max(1, -(-fx.read(self.spark, self.sf_dir, "orders").count() // PART))

    def _commits(self):
        return fx.commits(self.spark, self.sf_dir)

    def _parents(self):
        return fx.commit_parents(self.table("commits"))

    def _hunks(self):
        return fx.hunks(self.spark, self.sf_dir, self.table("parents"), self.parts)

    def _events(self):
        return planner.first_events(fx.events(self.table("hunks")).select(F.col("sha").alias("commit"), "pos", "parent_sha", "new_path", "old_path", "event_type", F.lit(False).alias("is_binary")), ["old_path"])

    def _blame(self):
        return fx.blame_table(self.table("commits"), self.table("hunks"))

    def _seeds(self):
        return fx.seeds(self.table("commits"), self.table("hunks"))

    def links(self) -> DataFrame:
        return self.table("parents").select("sha", F.col("pos").alias("parent_position"), "parent_sha")

    def _chains(self):
        return chains.chains(self.table("commits").select("sha"), self.links(), f"{self.where}/chain")

    def _places(self):
        touched = self.table("hunks").where("pos = 0").select(F.col("sha").alias("commit"), F.col("new_path").alias("path"), F.col("sha").alias("blob")).distinct()
        return temporal.placed(touched, self.table("chains"))

    def _touches(self):
        return fx.touches(self.table("commits"), self.table("hunks"))

    def _info(self):
        n = self.table("parents").groupBy("sha").agg(F.count("*").alias("np"))
        first = self.table("commits").groupBy("author").agg(F.min_by("sha", "at").alias("first"))
        c = self.table("commits").join(n, "sha", "left").join(first, "author")
        return c.select(F.col("sha").alias("commit"), "author", "committed_on", "at", "first", F.coalesce("np", F.lit(0)).alias("parents"))

    def info(self) -> DataFrame:
        return self.table("info")

    def blame(self, requests: DataFrame) -> DataFrame:
        """One span for each request, as long as its range."""
        found = requests.join(fx.blame_asked(requests, self.table("touches"), self.info()), ["commit", "path"])
        return found.select(*KEY, F.struct(*KEY).alias("span"), "blamed", F.col("path").alias("origin_path"), F.col("s").alias("origin_start"), (F.col("e") - F.col("s") + 1).alias("line_count"), F.col("s").alias("final_start"))

    def diffs(self, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The first events and the hunks of commits (commit), which are dealt as these tables are."""
        commits = commits.repartition(self.parts, "commit")
        hunks = self.table("hunks").select(F.col("sha").alias("commit"), "pos", "new_path", "old_start", "old_lines", "new_start", "new_lines")
        return tuple(df.join(commits, "commit", "left_semi") for df in (self.table("events"), hunks))

    def planner(self) -> planner.Planner:
        parents = self.table("parents").select(F.col("sha").alias("commit"), "pos", F.col("parent_sha").alias("parent"))
        return planner.Planner(self.info(), parents, self.diffs, self.blame, F.lit(self.since).cast("date"), self.max_depth, self.exact_ranges)

    @cached_property
    def trace(self) -> planner.Trace:
        return self.planner().trace(self.table("seeds"), f"{self.where}/trace")


def forget() -> None:
    """Drop what queries have made for each other."""
    _runs.clear()


def _named(df: DataFrame) -> DataFrame:
    """Keys by their names in SQL."""
    return df.withColumnsRenamed({"commit": "c", "path": "p"})


_EDGE = ["c", "p", "s", "e", "depth", "blamed", "parent_sha", "pos", "edge_type", "next_path", "next_s", "next_e"]


def _edges(run: Run) -> DataFrame:
    return _named(run.table("edges")).withColumnRenamed("parent", "parent_sha").select(*_EDGE)


def parents_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Run.of(spark, sf_dir).table("parents")
    arrays = p.groupBy("sha").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "parent_sha"))), lambda x: x["parent_sha"]).alias("parents"))
    return graph.expand_parents(arrays)


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    roots = run.table("commits").orderBy(F.desc("at")).limit(2).select(F.col("sha").alias("root"))
    return graph.ancestors(roots, run.table("parents")).select("root", F.col("node").alias("ancestor"), "depth")


def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best common ancestors of the two parents' sides of the newest merge."""
    run = Run.of(spark, sf_dir)
    p = run.table("parents").where("pos = 1").join(run.table("commits").select("sha", "at"), "sha")
    last = p.orderBy(F.desc("at")).select("sha", "parent_sha").first()
    return graph.merge_bases(last["sha"], last["parent_sha"], run.table("parents"))


def commit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's chain of first parents and its position there."""
    return Run.of(spark, sf_dir).table("chains").select("sha", "chain", "pos", "fork")


def ancestor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every head, how far its ancestors go on each chain."""
    run = Run.of(spark, sf_dir)
    heads = fx.heads(run.table("commits")).select(F.col("sha").alias("root"), "sha")
    return chains.reach(heads, run.table("chains"), run.links(), f"{run.where}/reach")


def tree_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of a chain between which a file stays as a commit left it."""
    return temporal.intervals(Run.of(spark, sf_dir).table("places")).select("chain", "path", F.col("commit").alias("sha"), F.col("begin").alias("begin_pos"), F.col("end").alias("end_pos"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of every commit, and the commit that left each as it is."""
    run = Run.of(spark, sf_dir)
    segs = temporal.segments(run.table("commits").select(F.col("sha").alias("commit")), run.table("chains"), f"{run.where}/segments")
    return temporal.tree_at(segs, temporal.intervals(run.table("places"))).select(F.col("commit").alias("sha"), "path", "at_commit")


def classify_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Run.of(spark, sf_dir).info().withColumn("depth", (F.col("commit") % 7).cast("int"))
    c = planner.cutoff(F.col("parents"), F.col("committed_on"), F.col("depth"), F.lit(fx.SINCE).cast("date"), fx.MAX_DEPTH)
    return i.select(F.col("commit").alias("sha"), "depth", F.coalesce(c, F.lit("recurse")).alias("cutoff"))


def event_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    b = run.table("blame")
    e = run.table("events").select(F.col("commit").alias("blamed"), F.col("new_path").alias("path"), "pos", "parent_sha", "old_path")
    return b.join(e, ["blamed", "path"]).select(F.col("commit").alias("req_sha"), "path", "blamed", "pos", "parent_sha", "old_path")


def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    s = run.blame(run.table("seeds")).alias("r")
    h = run.table("hunks").alias("h")
    on = (F.col("r.blamed") == F.col("h.sha")) & (F.col("r.path") == F.col("h.new_path")) & planner.overlap(F.col("r.s"), F.col("r.e") + 1, F.col("h.new_start"), F.col("h.new_lines"))
    return s.join(h, on).select(F.col("commit").alias("c"), F.col("path").alias("p"), "s", "e", "blamed", "h.pos", "h.new_start", "h.new_lines", "h.old_start", "h.old_lines")


def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner says of the seeds."""
    run = Run.of(spark, sf_dir)
    p = run.planner()
    e = p.edges(p.spans(run.table("seeds").withColumn("depth", F.lit(0))))
    return _named(e).withColumnRenamed("parent", "parent_sha").select(*_EDGE)


def request_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(Run.of(spark, sf_dir).table("requests"))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(Run.of(spark, sf_dir))


def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(Run.of(spark, sf_dir)).groupBy("edge_type", "depth").agg(F.count("*").alias("edges"))


def spans_without_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    return _named(run.table("spans").join(run.table("edges"), KEY, "left_anti").select(*KEY, "blamed"))


def _discovered(run: Run) -> DataFrame:
    heads = run.table("seeds").select(F.col("commit").alias("sha"))
    return run.table("spans").select(F.col("blamed").alias("sha")).unionByName(heads).repartition(run.parts, "sha").distinct()


def commits_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    return run.table("commits").join(_discovered(run), "sha", "left_semi").select("sha", "author", "committed_on")


def dangling_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of discovered commits that are not discovered themselves."""
    run = Run.of(spark, sf_dir)
    d = keep(_discovered(run), run.where, "discovered")
    return run.table("parents").join(d, "sha", "left_semi").join(d.withColumnRenamed("sha", "parent_sha"), "parent_sha", "left_anti").select("sha", "pos", "parent_sha")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    return run_summary(run.table("seeds"), run.table("requests"), _discovered(run), run.table("edges"))


def files_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Run.of(spark, sf_dir).table("seeds").select("path").distinct().orderBy("path")


def ranges_for_file(spark: SparkSession, sf_dir: str, path: str = "f3") -> DataFrame:
    s = Run.of(spark, sf_dir).table("seeds").where(F.col("path") == path)
    return s.select(F.col("commit").alias("c"), F.col("s").alias("start_line"), F.col("e").alias("end_line")).orderBy("start_line", "end_line", "c")


def top_commits(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    run = Run.of(spark, sf_dir)
    n = run.table("spans").groupBy(F.col("blamed").alias("sha")).agg(F.count("*").alias("spans"))
    return n.join(run.table("commits").select("sha", "author", "committed_on"), "sha").select("sha", "author", "committed_on", "spans").orderBy(F.desc("spans"), "sha").limit(limit)


def seed_covering_line(spark: SparkSession, sf_dir: str, path: str = "f3", line: int = 22) -> DataFrame:
    s = Run.of(spark, sf_dir).table("seeds")
    return s.where((F.col("path") == path) & (F.col("s") <= line) & (F.col("e") >= line)).select(F.col("commit").alias("c"), F.col("s").alias("start_line"), F.col("e").alias("end_line"))


def _first_seed(run: Run) -> DataFrame:
    return run.table("seeds").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")


def lineage_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the first seed."""
    run = Run.of(spark, sf_dir)
    return _named(run.table("edges").join(_first_seed(run), KEY, "left_semi")).withColumnRenamed("parent", "parent_sha").select(*_EDGE).orderBy("s", F.asc_nulls_first("pos"))


def lineage_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that the first seed leads to, with the number of steps."""
    run = Run.of(spark, sf_dir)
    e = run.table("edges").where(F.col("edge_type") == RECURSE).select(F.struct(*KEY).alias("from_request_id"), F.struct(F.col("parent").alias("commit"), F.col("next_path").alias("path"), F.col("next_s").alias("s"), F.col("next_e").alias("e")).alias("next_request_id"))
    start = _first_seed(run).select(F.lit(1).alias("root"), F.struct(*KEY).alias("node"))
    return _named(graph.walk(e, start).select("node.*", F.col("depth").alias("steps")))


def renames_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(Run.of(spark, sf_dir).table("hunks"))
    return e.where(F.col("event_type").isin("renamed", "copied")).select("sha", "pos", "parent_sha", "event_type", "old_path", "new_path").orderBy("sha")


def commit_parent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    found = run.table("commits").join(_discovered(run), "sha", "left_semi").join(run.table("parents"), "sha", "left")
    return found.groupBy("sha", "author", "committed_on").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("parent_sha").cast("string").alias("p")))), lambda x: x["p"]), ",").alias("joined"), F.count("parent_sha").alias("n_parents")).select("sha", "author", "committed_on", F.when(F.col("n_parents") > 0, F.col("joined")).alias("parents"), "n_parents").orderBy(F.desc("committed_on"), "sha")


def file_dossier(spark: SparkSession, sf_dir: str, path: str = "f3") -> DataFrame:
    """Seeds of a file, their spans and edges, and the commits blamed; spans without edges stay."""
    run = Run.of(spark, sf_dir)
    s = run.table("spans").join(run.table("seeds").where(F.col("path") == path), KEY, "left_semi").select(*KEY, "blamed")
    e = run.table("edges").select(*KEY, "edge_type", "pos", F.col("parent").alias("parent_sha"))
    c = run.table("commits").select(F.col("sha").alias("blamed"), "author", "committed_on")
    return _named(s.join(e, KEY, "left").join(c, "blamed")).select("c", "p", "s", "e", "blamed", "author", "committed_on", "edge_type", "pos", "parent_sha")


def validate_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run.of(spark, sf_dir)
    c, r, e = run.table("commits"), run.table("requests"), run.table("edges")
    rules = {
        "parents: sha": validate.broken_references(run.table("parents"), ["sha"], c, ["sha"]),
        "parents: parent_sha": validate.broken_references(run.table("parents"), ["parent_sha"], c, ["sha"]),
        "hunks: sha": validate.broken_references(run.table("hunks"), ["sha"], c, ["sha"]),
        "edges: request": validate.broken_references(e, KEY, r, KEY),
        "edges: next request": validate.broken_references(e, ["parent", "next_path", "next_s", "next_e"], r, KEY),
        "edges: parent is discovered": validate.broken_references(e, ["parent"], _discovered(run), ["sha"]),
    }
    out = [df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, df in rules.items()]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


def validate_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the requests and edges of a run, with requests known by their four columns."""
    run = Run.of(spark, sf_dir)
    text = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    depth = F.col("depth")
    requests = run.table("requests").select(text(*KEY).alias("id"), F.lit(1).alias("scan_id"), F.col("commit").alias("commit_sha"), "path", F.col("s").alias("start_line"), F.col("e").alias("end_line"), "depth", F.when(depth == 0, "seed").otherwise("parent_recurse").alias("reason"))
    nxt = F.when(F.col("next_path").isNotNull(), text("parent", "next_path", "next_s", "next_e"))
    edges = run.table("edges").select(text(*KEY).alias("from_request_id"), nxt.alias("next_request_id"), "edge_type")
    return validate.validate({"blame_requests": requests, "lineage_edges": edges})


def validate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that an order has more than once."""
    return validate.repeated_keys(fx.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def validate_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.read(spark, sf_dir, "orders")
    return validate.outside_domain(o, "o_orderstatus", ["O", "F"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def git_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits of the repository that this code lies in; none where there is no git repository."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if shutil.which("git") is None or not os.path.isdir(os.path.join(root, ".git")):
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in gitrepo.SCHEMAS["commits"].split(", "))])
    return gitrepo.read(spark, root, "commits")


QUERIES = {f.__name__: f for f in (git_source, parents_expand, ancestors, merge_base, commit_chains, ancestor_chains, tree_intervals, trees, classify_cutoff, event_first_match, hunk_overlap, plan_actions, request_fixpoint, lineage_edges, edge_type_counts, spans_without_edges, commits_discovered, dangling_parents, summary, files_touched, ranges_for_file, top_commits, seed_covering_line, lineage_step, lineage_walk, renames_copies, commit_parent_list, file_dossier, validate_lineage, validate_fk, validate_unique, validate_enum)}

_B, _L = f"with {fx.B_SQL}", f"with recursive {fx.LINEAGE_SQL}"
_D = "disc as (select blamed as sha from sp union select c from h_seed)"
_FS = "fs as (select * from h_seed order by c, p, s, e limit 1)"
_COLUMNS = ", ".join(_EDGE)
_WALK = """an as (select sha as root, sha as node, 0 as depth from roots union select an.root, p.parent_sha, an.depth + 1 from an join h_commit_parents p on p.sha = an.node)"""
#: In these tables a chain is an author's commits, and none branches off another.
_CHAIN = f"""{fx.B_SQL}, ch as (select sha, first_value(sha) over (partition by author order by ord) as chain, row_number() over (partition by author order by ord) - 1 as pos, cast(null as bigint) as fork from h_commits),
      tc as (select distinct ch.chain, ch.pos, h.new_path as path, ch.sha from h_hunks h join ch on ch.sha = h.sha where h.pos = 0)"""
ORACLES = {
    "parents_expand": f"{_B} select sha, pos as parent_position, parent_sha from h_commit_parents",
    "ancestors": f"with recursive {fx.B_SQL}, roots as (select sha from h_commits order by ord desc limit 2), {_WALK} select root, node as ancestor, min(depth) as depth from an group by 1, 2",
    "merge_base": f"""with recursive {fx.B_SQL}, last as (select p.sha, p.parent_sha from h_commit_parents p join h_commits c on c.sha = p.sha where p.pos = 1 order by c.ord desc limit 1),
      roots as (select sha from last union select parent_sha from last), an as (select sha as root, sha as node from roots union select an.root, p.parent_sha from an join h_commit_parents p on p.sha = an.node),
      cm as (select node from an group by node having count(distinct root) = 2) select node as sha from cm where node not in (select p.parent_sha from h_commit_parents p join cm on cm.node = p.sha)""",
    "commit_chains": f"with {_CHAIN} select sha, chain, pos, fork from ch",
    "ancestor_chains": f"with recursive {_CHAIN}, roots as (select sha from h_head), {_WALK} select an.root, ch.chain, max(ch.pos) as upto from an join ch on ch.sha = an.node group by 1, 2",
    "tree_intervals": f"with {_CHAIN} select chain, path, sha, pos as begin_pos, lead(pos) over (partition by chain, path order by pos) as end_pos from tc",
    "trees": f"with {_CHAIN} select c.sha, t.path, t.sha as at_commit from ch c join tc t on t.chain = c.chain and t.pos <= c.pos qualify row_number() over (partition by c.sha, t.path order by t.pos desc) = 1",
    "classify_cutoff": f"""{_B} select c.sha, cast(c.sha % 7 as integer) as depth, case when n.np is null then 'root_commit' when c.committed_on < date '{fx.SINCE}' then 'older_than_since' when c.sha % 7 >= {fx.MAX_DEPTH} then 'max_depth' else 'recurse' end as cutoff
      from h_commits c left join h_np n on n.sha = c.sha""",
    "event_first_match": f"{_B} select b.req_sha, b.path, b.blamed, e.pos, e.parent_sha, e.old_path from h_b b join h_pe e on e.sha = b.blamed and e.new_path = b.path",
    "hunk_overlap": f"""{_B} select r.c, r.p, r.s, r.e, b.blamed, h.pos, h.new_start, h.new_lines, h.old_start, h.old_lines from h_seed r join h_b b on b.req_sha = r.c and b.path = r.p
      join h_hunks h on h.sha = b.blamed and h.new_path = r.p and h.new_lines > 0 and h.new_start <= r.e and r.s < h.new_start + h.new_lines""",
    "plan_actions": f"{_L} select {_COLUMNS} from ed where depth = 0",
    "request_fixpoint": f"{_L} select * from req",
    "lineage_edges": f"{_L} select {_COLUMNS} from ed",
    "edge_type_counts": f"{_L} select edge_type, depth, count(*) as edges from ed group by 1, 2",
    "spans_without_edges": f"{_L} select c, p, s, e, blamed from sp where (c, p, s, e) not in (select (c, p, s, e) from ed)",
    "commits_discovered": f"{_L}, {_D} select sha, author, committed_on from h_commits where sha in (select sha from disc)",
    "dangling_parents": f"{_L}, {_D} select sha, pos, parent_sha from h_commit_parents where sha in (select sha from disc) and parent_sha not in (select sha from disc)",
    "summary": f"""{_L}, {_D} select (select count(distinct p) from h_seed) as seed_files, (select count(*) from h_seed) as seed_ranges, (select count(*) from req) as requests_processed,
      (select count(*) from disc) as commits_discovered, (select count(*) from ed where edge_type <> 'recurse_to_parent') as terminal_spans""",
    "files_touched": f"{_B} select distinct p as path from h_seed order by 1",
    "ranges_for_file": f"{_B} select c, s as start_line, e as end_line from h_seed where p = 'f3'",
    "top_commits": f"{_L} select c.sha, c.author, c.committed_on, count(*) as spans from sp join h_commits c on c.sha = sp.blamed group by 1, 2, 3 order by spans desc, sha limit 20",
    "seed_covering_line": f"{_B} select c, s as start_line, e as end_line from h_seed where p = 'f3' and s <= 22 and e >= 22",
    "lineage_step": f"{_L}, {_FS} select {_COLUMNS} from ed where (c, p, s, e) in (select (c, p, s, e) from fs)",
    "lineage_walk": f"""{_L}, {_FS}, wk as (select c, p, s, e, 0 as steps from fs union select ed.parent_sha, ed.next_path, ed.next_s, ed.next_e, wk.steps + 1 from wk join ed on ed.c = wk.c and ed.p = wk.p and ed.s = wk.s and ed.e = wk.e and ed.edge_type = 'recurse_to_parent')
      select c, p, s, e, min(steps) as steps from wk group by 1, 2, 3, 4""",
    "renames_copies": f"{_B} select distinct sha, pos, parent_sha, 'renamed' as event_type, old_path, new_path from h_hunks where old_path <> new_path",
    "commit_parent_list": f"""{_L}, {_D} select c.sha, c.author, c.committed_on, string_agg(cast(p.parent_sha as varchar), ',' order by p.pos) as parents, count(p.parent_sha) as n_parents
      from h_commits c left join h_commit_parents p on p.sha = c.sha where c.sha in (select sha from disc) group by 1, 2, 3""",
    "file_dossier": f"""{_L} select sp.c, sp.p, sp.s, sp.e, sp.blamed, h.author, h.committed_on, ed.edge_type, ed.pos, ed.parent_sha from sp join h_seed d on d.c = sp.c and d.p = sp.p and d.s = sp.s and d.e = sp.e and d.p = 'f3'
      left join ed on ed.c = sp.c and ed.p = sp.p and ed.s = sp.s and ed.e = sp.e join h_commits h on h.sha = sp.blamed""",
    "validate_lineage": f"""{_L}, rq as (select concat_ws(':', c, p, s, e) as id, c, p, s, e, depth from req),
      eg as (select concat_ws(':', c, p, s, e) as f, case when next_path is not null then concat_ws(':', parent_sha, next_path, next_s, next_e) end as n, edge_type from ed)
      select 'not null: id, scan_id, commit_sha, path, start_line, end_line, depth, reason' as rule, 'blame_requests' as table_name, (select count(*) from rq where c is null or p is null or s is null or e is null or depth is null) as broken
      union all select 'domain: reason', 'blame_requests', (select count(*) from rq where depth < 0)
      union all select 'not null: from_request_id, edge_type', 'lineage_edges', (select count(*) from eg where f is null or edge_type is null)
      union all select 'domain: edge_type', 'lineage_edges', (select count(*) from eg where edge_type not in ('recurse_to_parent', 'root_commit', 'older_than_since', 'max_depth', 'binary_skipped', 'introduced_here'))
      union all select 'next request: edge_type', 'lineage_edges', (select count(*) from eg where (edge_type = 'recurse_to_parent') <> (n is not null))
      union all select 'unique: id', 'blame_requests', (select count(*) from (select id from rq group by 1 having count(*) > 1))
      union all select 'unique: scan_id, commit_sha, path, start_line, end_line', 'blame_requests', (select count(*) from (select 1 from rq group by c, p, s, e having count(*) > 1))
      union all select 'refers to blame_requests: from_request_id', 'lineage_edges', (select count(*) from eg where f not in (select id from rq))
      union all select 'refers to blame_requests: next_request_id', 'lineage_edges', (select count(*) from eg where n is not null and n not in (select id from rq))""",
    "validate_fk": f"""{_L}, {_D} select 'parents: sha' as rule, (select count(*) from h_commit_parents where sha not in (select sha from h_commits)) as broken
      union all select 'parents: parent_sha', (select count(*) from h_commit_parents where parent_sha not in (select sha from h_commits))
      union all select 'hunks: sha', (select count(*) from h_hunks where sha not in (select sha from h_commits))
      union all select 'edges: request', (select count(*) from ed where (c, p, s, e) not in (select (c, p, s, e) from req))
      union all select 'edges: next request', (select count(*) from ed where next_path is not null and (parent_sha, next_path, next_s, next_e) not in (select (c, p, s, e) from req))
      union all select 'edges: parent is discovered', (select count(*) from ed where parent_sha is not null and parent_sha not in (select sha from disc))""",
    "validate_unique": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "validate_enum": "select o_orderstatus, count(*) as n from orders where o_orderstatus not in ('O', 'F') group by 1",
}
