"""Queries over fixture A: diffs, hunks, blame, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata import fixtures as fx
from strata.functions.targets import target_columns
from strata.operators import blame, diff
from strata.storage import keep, scratch_dir

BY = ["doc_id", "v"]
LAST = 5


def _script(lines: DataFrame) -> DataFrame:
    return blame.script(lines, ["doc_id"], 0, LAST)


def _branch(lines: DataFrame) -> DataFrame:
    """The edit script from version 0, the merge base, to the last version, the head."""
    ends = lines.where(F.col("v").isin(0, LAST)).withColumn("v", F.when(F.col("v") == 0, 0).otherwise(1))
    return blame.script(ends, ["doc_id"], 0, 1).drop("v")


def carried_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame.carried(fx.file_lines(spark, sf_dir), ["doc_id"])


def lcs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general line differ over the versions of each file."""
    lines = fx.file_lines(spark, sf_dir)
    files = lines.groupBy(*BY).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("new"))
    before = W.partitionBy("doc_id").orderBy("v")
    pairs = files.withColumn("old", F.when(F.lag("v").over(before) == F.col("v") - 1, F.lag("new").over(before))).where("old is not null")
    m = diff.lcs_matches(pairs, BY)
    return m.select(*BY, F.col("new_line").alias("line_no"), F.col("old_line").alias("parent_line"))


def edit_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == 0, "match").when(F.col("kind") == 1, "delete").otherwise("insert")
    return _script(fx.file_lines(spark, sf_dir)).select(*BY, kind.alias("kind"), "old_line", "new_line", F.col("segment").cast("long").alias("segment"))


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hunks(diff.hunk_rows(_script(fx.file_lines(spark, sf_dir)), BY), BY)


def patch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hunks(diff.hunk_rows(_script(fx.file_lines(spark, sf_dir)), BY), BY, patch=True).select(*BY, "hunk", "patch_text")


def added_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.hunk_rows(_script(fx.file_lines(spark, sf_dir)), BY)
    return diff.added_ranges(rows.where("kind = 2"), [*BY, "hunk"])


def seed_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.hunk_rows(_branch(fx.file_lines(spark, sf_dir)), ["doc_id"])
    return diff.added_ranges(rows.where("kind = 2"), ["doc_id", "hunk"]).select(F.col("doc_id").cast("string").alias("path"), "hunk", "start_line", "end_line")


def patch_for_file(spark: SparkSession, sf_dir: str, path: str = "7") -> DataFrame:
    """Patches of a file's seed ranges (by inner join: a trace's seeds have none)."""
    lines = fx.file_lines(spark, sf_dir).where(F.col("doc_id") == int(path))
    rows = diff.hunk_rows(_branch(lines), ["doc_id"])
    h = diff.hunks(rows, ["doc_id"], patch=True)
    s = diff.added_ranges(rows.where("kind = 2"), ["doc_id", "hunk"])
    return s.join(h, ["doc_id", "hunk"]).select("hunk", "start_line", "new_start", "new_lines", "patch_text").orderBy("new_start", "start_line")


def patch_by_id(spark: SparkSession, sf_dir: str, hunk: int = 1) -> DataFrame:
    """The patch of one hunk of every file's last version."""
    lines = fx.file_lines(spark, sf_dir).where(F.col("v") >= LAST - 1)
    rows = diff.hunk_rows(_script(lines).where(F.col("v") == LAST), BY)
    return diff.hunks(rows, BY, patch=True).where(F.col("hunk") == hunk).select("doc_id", "patch_text")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.file_lines(spark, sf_dir)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id", "v").agg(F.md5(body).alias("blob")).select("v", F.col("doc_id").cast("string").alias("path"), "blob")


def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = keep(_trees(spark, sf_dir), scratch_dir(spark), "trees")
    old = t.where(F.col("v") < LAST).withColumn("v", F.col("v") + 1)
    return diff.tree_diff(old, t.where("v > 0"), ["v"]).select("v", "path", "status", "old_blob", "new_blob")


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of a commit that renames every fifth file, drops every seventh, edits every eleventh and
    copies every thirteenth."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("blob"))
    old = d.select(F.lit(1).alias("commit"), F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), "blob")
    here = F.when(F.col("doc_id") % 5 == 0, "b/").otherwise("a/")
    edited = F.when(F.col("doc_id") % 11 == 0, F.md5(F.concat("blob", F.lit("x")))).otherwise(F.col("blob"))
    new = d.where("doc_id % 5 = 0 or doc_id % 7 <> 0").select(F.lit(1).alias("commit"), F.concat(here, F.col("doc_id").cast("string")).alias("path"), edited.alias("blob"))
    copy = d.where("doc_id % 13 = 0").select(F.lit(1).alias("commit"), F.concat(F.lit("c/"), F.col("doc_id").cast("string")).alias("path"), "blob")
    return diff.tree_diff(old, new.unionByName(copy), ["commit"])


def rename_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.rename_exact(_moved(spark, sf_dir), ["commit"]).select("old_path", "new_path", "blob")


def copy_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.copies(_moved(spark, sf_dir), ["commit"]).select("old_path", "new_path", "blob")


def rename_similarity(spark: SparkSession, sf_dir: str, threshold: int = 50) -> DataFrame:
    lines = fx.file_lines(spark, sf_dir).where(F.col("v").isin(2, LAST))
    hashes = keep(diff.line_hashes(lines, ["doc_id", "v"]), scratch_dir(spark), "hashes")  # of both versions at once
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("path")
    old = hashes.where("v = 2").select(F.lit(1).alias("commit"), name("a/"), "_h")
    new = hashes.where(F.col("v") == LAST).select(F.lit(1).alias("commit"), name("b/"), "_h")
    return diff.similar_sets(old, new, ["commit"], threshold).select("old_path", "new_path", "score")


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Added", "Deleted", "Modified", "Typechange", "Renamed", "Copied", "Conflicted", "Unreadable"]
    i = fx.read(spark, sf_dir, "lineitem").select(F.get(F.array(*map(F.lit, names)), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 8).cast("int")).alias("status"), (F.col("l_partkey") % 11 == 0).alias("is_binary"))
    kind, binary = diff.event_type(F.col("status")), F.col("is_binary")
    collected = diff.collected_event_type(F.col("status"), binary)
    out = i.select("status", "is_binary", kind.alias("event_type"), collected.alias("collected_type"), diff.effective_event_type(kind, binary, False).alias("stored_type"), diff.effective_event_type(collected, binary, True).alias("stored_with_binary"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def _blamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, final_line, blamed, origin_line, origin_path) of the last version's lines."""
    found = blame.origins(fx.file_lines(spark, sf_dir), ["doc_id"]).where(F.col("v") == LAST)
    return found.select("doc_id", F.col("line_no").alias("final_line"), F.col("blamed").cast("long").alias("blamed"), "origin_line", F.col("doc_id").cast("string").alias("origin_path"))


def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blamed(spark, sf_dir).select("doc_id", F.col("final_line").alias("line_no"), "blamed", "origin_line")


def blame_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame.spans(_blamed(spark, sf_dir), ["doc_id"]).select("doc_id", "blamed", "final_start_line", "origin_start_line", "line_count")


def history_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as ``blame_lines``, by a history of six commits: trees, renames, the general line differ
    and a blame of the head's files."""
    from strata.plans.history import History
    from strata.plans.scope import Scope

    where = scratch_dir(spark)
    lines = fx.file_lines(spark, sf_dir)
    files = lines.groupBy("doc_id", "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    files = keep(files.select(F.col("v").cast("string").alias("commit"), F.col("doc_id").cast("string").alias("path"), F.md5(F.array_join("lines", "\n")).alias("blob"), "lines"), where, "files")
    parents = F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    commits = spark.range(LAST + 1).select(F.col("id").cast("string").alias("sha"), parents.alias("parents"))
    h = History.from_trees(commits, files.select("commit", "path", "blob"), files.select("blob", F.lit(False).alias("is_binary"), "lines"))
    asked = files.where(F.col("commit") == str(LAST)).select("commit", "path", F.lit(1).cast("long").alias("s"), F.size("lines").cast("long").alias("e"))
    found = Scope(h).blame(asked).select("path", "blamed", "line_count", "origin_start", "final_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("line_count") - 1)).alias("k"))
    return found.select(F.col("path").cast("long").alias("doc_id"), (F.col("final_start") + F.col("k")).alias("line_no"), F.col("blamed").cast("long").alias("blamed"), (F.col("origin_start") + F.col("k")).alias("origin_line"))


def blame_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans cut to a range of each file that depends on its number."""
    found = blame.spans(_blamed(spark, sf_dir), ["doc_id"])
    asked = fx.read(spark, sf_dir, "documents").select("doc_id", (1 + F.col("doc_id") % 7).alias("start_line"), (10 + F.col("doc_id") % 12).alias("end_line"))
    return blame.clip(found, asked, ["doc_id"]).select("doc_id", "start_line", "end_line", "blamed", "final_start_line", "origin_start_line", "line_count")


def parse_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of every form, right and wrong, from order keys."""
    k = "cast(o_orderkey as string)"
    text = F.expr(f"""case o_orderkey % 8 when 0 then concat('src/f', {k}, '.rs:', {k}) when 1 then concat('a:b/', {k}, ':', {k}, '-', cast(o_orderkey + 5 as string))
      when 2 then concat('noline', {k}) when 3 then concat(':', {k}) when 4 then 'x.rs:0' when 5 then concat('x.rs:', cast(o_orderkey + 9 as string), '-', {k})
      when 6 then concat('x:', {k}, '-') else concat('x.rs:500000000', {k}) end""")
    o = fx.read(spark, sf_dir, "orders").select("o_orderkey", text.alias("target"))
    return o.withColumns(target_columns(F.col("target")))


def seed_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of a trace for every target that parses: one range and one request at the head."""
    t = parse_target(spark, sf_dir).where("path is not null")
    ref = F.concat(F.lit("trace:"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return t.select("o_orderkey", ref.alias("base_ref"), "path", "start_line", "end_line", F.lit(0).alias("depth"), F.lit("seed").alias("reason"), F.lit(None).cast("long").alias("diff_hunk_id"))


def run_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs told apart by their base: a branch run for each customer, a trace for each of its orders."""
    o = fx.read(spark, sf_dir, "orders")
    sha = F.col("o_orderkey").cast("string")
    scans = o.groupBy("o_custkey").agg(F.min("o_orderkey").cast("string").alias("base_sha"), F.max("o_orderkey").cast("string").alias("head_sha")).select(F.lit("origin/main").alias("base_ref"), "base_sha", "base_sha", "head_sha").toDF("base_ref", "base_sha", "merge_base_sha", "head_sha")
    traces = o.select(F.concat(F.lit("trace:f"), sha, F.lit(":1-1")).alias("base_ref"), sha.alias("base_sha"), sha.alias("merge_base_sha"), sha.alias("head_sha"))
    runs = scans.unionByName(traces)
    trace = F.col("base_ref").startswith("trace:") & (F.col("base_sha") == F.col("head_sha")) & (F.col("merge_base_sha") == F.col("head_sha"))
    stale = ~trace & (F.col("merge_base_sha") == F.col("head_sha"))
    return runs.groupBy(F.when(trace, "trace").otherwise("scan").alias("kind"), stale.alias("is_empty")).agg(F.count("*").alias("runs"))


_SCRIPT = f"""{fx.A_SQL},
nw as (select doc_id, v, line_no as new_line, line from h_file_lines where v > 0),
od as (select doc_id, v + 1 as v, line_no as old_line, line from h_file_lines where v < 5),
sc as (select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.v, o.v) as v, old_line, new_line, coalesce(n.line, o.line) as line,
  case when old_line is not null and new_line is not null then 0 when new_line is null then 1 else 2 end as kind
  from nw n full join od o on n.doc_id = o.doc_id and n.v = o.v and n.line = o.line),
-- the number of matches at or before a row of its own side
seg as (select *, case when kind = 2 then (sum(case when kind = 0 then 1 else 0 end) over (partition by doc_id, v, (new_line is not null) order by new_line rows unbounded preceding))
  else (sum(case when kind = 0 then 1 else 0 end) over (partition by doc_id, v, (old_line is not null) order by old_line rows unbounded preceding)) end as segment from sc),
ix as (select *, row_number() over (partition by doc_id, v order by segment, kind, coalesce(old_line, new_line)) as i,
  count(old_line) over (partition by doc_id, v order by segment, kind, coalesce(old_line, new_line) rows unbounded preceding) as ob,
  count(new_line) over (partition by doc_id, v order by segment, kind, coalesce(old_line, new_line) rows unbounded preceding) as nb from seg),
nr as (select *, max(case when kind > 0 then i end) over (partition by doc_id, v order by i rows unbounded preceding) as la,
  min(case when kind > 0 then i end) over (partition by doc_id, v order by i rows between current row and unbounded following) as ne from ix),
kp as (select * from nr where i - la <= 3 or ne - i <= 3),
gr as (select *, i - row_number() over (partition by doc_id, v order by i) as g from kp),
hk as (select *, dense_rank() over (partition by doc_id, v order by g) as hunk from gr),
hh as (select doc_id, v, cast(hunk as bigint) as hunk,
  cast(case when count(old_line) > 0 then min(old_line) else min(ob) end as bigint) as old_start, cast(count(old_line) as bigint) as old_lines,
  cast(case when count(new_line) > 0 then min(new_line) else min(nb) end as bigint) as new_start, cast(count(new_line) as bigint) as new_lines,
  string_agg(case kind when 0 then ' ' when 1 then '-' else '+' end || line || chr(10), '' order by i) as body from hk group by doc_id, v, hunk),
pt as (select *, '@@ -' || old_start || case when old_lines = 1 then '' else ',' || old_lines end || ' +' || new_start || case when new_lines = 1 then '' else ',' || new_lines end || ' @@' || chr(10) || body as patch_text from hh),
ar as (select doc_id, v, cast(hunk as bigint) as hunk, min(new_line) as start_line, max(new_line) as end_line
  from (select *, new_line - row_number() over (partition by doc_id, v, hunk order by new_line) as k from hk where kind = 2) x group by doc_id, v, hunk, k)
"""
#: The same steps between version 0 and the last one.
_BRANCH = _SCRIPT.replace("where v > 0)", "where v = 5)", 1).replace("v + 1 as v, line_no as old_line, line from h_file_lines where v < 5", "5 as v, line_no as old_line, line from h_file_lines where v = 0", 1)
_BLAMED = f"""{fx.A_SQL},
bl as (select l.doc_id, l.line_no, l.truth_v as blamed, o.line_no as origin_line from h_file_lines l
  join h_file_lines o on o.doc_id = l.doc_id and o.v = l.truth_v and o.key_ln = l.key_ln where l.v = 5),
sp as (select doc_id, blamed, min(line_no) as final_start_line, min(origin_line) as origin_start_line, count(*) as line_count from (
  select *, line_no - row_number() over (partition by doc_id, blamed, line_no - origin_line order by line_no) as g from bl) x group by doc_id, blamed, line_no - origin_line, g)
"""
_MOVED = """
d as (select doc_id, md5(coalesce(text, '')) as blob from documents),
o as (select 'a/' || doc_id as path, blob from d),
n as (select case when doc_id % 5 = 0 then 'b/' else 'a/' end || doc_id as path, case when doc_id % 11 = 0 then md5(blob || 'x') else blob end as blob from d where doc_id % 5 = 0 or doc_id % 7 <> 0
  union all select 'c/' || doc_id, blob from d where doc_id % 13 = 0),
gone as (select blob, path, row_number() over (partition by blob order by path) as k from o where path not in (select path from n)),
came as (select blob, path, row_number() over (partition by blob order by path) as k from n where path not in (select path from o)),
edited as (select o.blob, min(o.path) as path from o join n on n.path = o.path and n.blob <> o.blob group by o.blob)
"""
_TARGET = """
t as (select o_orderkey, case o_orderkey % 8 when 0 then 'src/f' || o_orderkey || '.rs:' || o_orderkey when 1 then 'a:b/' || o_orderkey || ':' || o_orderkey || '-' || (o_orderkey + 5)
  when 2 then 'noline' || o_orderkey when 3 then ':' || o_orderkey when 4 then 'x.rs:0' when 5 then 'x.rs:' || (o_orderkey + 9) || '-' || o_orderkey
  when 6 then 'x:' || o_orderkey || '-' else 'x.rs:500000000' || o_orderkey end as target from orders),
u as (select *, string_split(target, ':') as f from t),
w as (select o_orderkey, target, case when len(f) > 1 then array_to_string(f[:-2], ':') end as p, string_split(f[-1], '-') as r from u),
x as (select *, try_cast(r[1] as bigint) as s, try_cast(r[len(r)] as bigint) as e from w),
y as (select o_orderkey, target, case when p <> '' and s >= 1 and e >= s and e <= 4294967295 and len(r) <= 2 then 1 end as ok, p, s, e from x),
z as (select o_orderkey, target, case when ok = 1 then p end as path, case when ok = 1 then s end as start_line, case when ok = 1 then e end as end_line from y)
"""

QUERIES = {f.__name__: f for f in (carried_lines, lcs_diff, edit_script, diff_hunks, patch_text, added_ranges, seed_branch, patch_for_file, patch_by_id, tree_diff, rename_exact, rename_similarity, copy_detect, event_types, blame_lines, blame_spans, history_blame, blame_clip, parse_target, seed_trace, run_kind)}

_CARRIED = f"with {fx.A_SQL} select n.doc_id, n.v, n.line_no, o.line_no as parent_line from h_file_lines n join h_file_lines o on o.doc_id = n.doc_id and o.v = n.v - 1 and o.line = n.line"
ORACLES = {
    "carried_lines": _CARRIED,
    "lcs_diff": _CARRIED,
    "edit_script": f"with {_SCRIPT} select doc_id, v, case kind when 0 then 'match' when 1 then 'delete' else 'insert' end as kind, old_line, new_line, cast(segment as bigint) as segment from seg",
    "diff_hunks": f"with {_SCRIPT} select doc_id, v, hunk, old_start, old_lines, new_start, new_lines from hh",
    "patch_text": f"with {_SCRIPT} select doc_id, v, hunk, patch_text from pt",
    "added_ranges": f"with {_SCRIPT} select doc_id, v, hunk, start_line, end_line from ar",
    "seed_branch": f"with {_BRANCH} select cast(doc_id as varchar) as path, hunk, start_line, end_line from ar",
    "patch_for_file": f"with {_BRANCH} select ar.hunk, ar.start_line, pt.new_start, pt.new_lines, pt.patch_text from ar join pt on pt.doc_id = ar.doc_id and pt.hunk = ar.hunk where ar.doc_id = 7 order by pt.new_start, ar.start_line",
    "patch_by_id": f"with {_SCRIPT} select doc_id, patch_text from pt where v = 5 and hunk = 1",
    "tree_diff": f"""with {fx.A_SQL}, t as (select v, cast(doc_id as varchar) as path, md5(string_agg(line, chr(10) order by line_no)) as blob from h_file_lines group by v, doc_id),
      o as (select v + 1 as v, path, blob from t where v < 5), n as (select * from t where v > 0)
      select coalesce(n.v, o.v) as v, coalesce(n.path, o.path) as path, case when o.v is null then 'Added' when n.v is null then 'Deleted' else 'Modified' end as status, o.blob as old_blob, n.blob as new_blob
      from n full join o on o.v = n.v and o.path = n.path where n.blob is distinct from o.blob""",
    "rename_exact": f"with {_MOVED} select gone.path as old_path, came.path as new_path, gone.blob from gone join came on came.blob = gone.blob and came.k = gone.k",
    "copy_detect": f"with {_MOVED} select edited.path as old_path, came.path as new_path, came.blob from came join edited on edited.blob = came.blob",
    "rename_similarity": f"""with {fx.A_SQL}, o as (select distinct 'a/' || doc_id as path, line from h_file_lines where v = 2), n as (select distinct 'b/' || doc_id as path, line from h_file_lines where v = 5),
      c as (select o.path as old_path, n.path as new_path, count(*) as c from o join n using (line) group by 1, 2),
      s as (select old_path, new_path, cast(floor(100 * c / greatest((select count(*) from o where path = old_path), (select count(*) from n where path = new_path))) as bigint) as score from c)
      select old_path, new_path, score from s where score >= 50 qualify row_number() over (partition by new_path order by score desc, old_path) = 1""",
    "event_types": """with i as (select ['Added', 'Deleted', 'Modified', 'Typechange', 'Renamed', 'Copied', 'Conflicted', 'Unreadable'][1 + (l_orderkey * 7 + l_linenumber) % 8] as status, l_partkey % 11 = 0 as is_binary from lineitem),
      e as (select *, case status when 'Added' then 'added' when 'Deleted' then 'deleted' when 'Renamed' then 'renamed' when 'Copied' then 'copied' else 'modified' end as event_type from i)
      select status, is_binary, event_type, case when is_binary then 'binary_skipped' else event_type end as collected_type,
      case when is_binary and event_type not in ('renamed', 'copied') then 'binary_skipped' else event_type end as stored_type,
      case when is_binary then 'binary_skipped' else event_type end as stored_with_binary, count(*) as n from e group by all""",
    "blame_lines": f"with {_BLAMED} select doc_id, line_no, blamed, origin_line from bl",
    "history_blame": f"with {_BLAMED} select doc_id, line_no, blamed, origin_line from bl",
    "blame_spans": f"with {_BLAMED} select doc_id, blamed, final_start_line, origin_start_line, line_count from sp",
    "blame_clip": f"""with {_BLAMED}, q as (select doc_id, 1 + doc_id % 7 as start_line, 10 + doc_id % 12 as end_line from documents),
      j as (select q.*, blamed, greatest(start_line, final_start_line) as a, least(end_line + 1, final_start_line + line_count) as b, final_start_line, origin_start_line from q join sp using (doc_id))
      select doc_id, start_line, end_line, blamed, a as final_start_line, origin_start_line + a - final_start_line as origin_start_line, b - a as line_count from j where b > a""",
    "parse_target": f"with {_TARGET} select * from z",
    "seed_trace": f"with {_TARGET} select o_orderkey, 'trace:' || path || ':' || start_line || '-' || end_line as base_ref, path, start_line, end_line, 0 as depth, 'seed' as reason, cast(null as bigint) as diff_hunk_id from z where path is not null",
    "run_kind": """with r as (select 'origin/main' as base_ref, cast(min(o_orderkey) as varchar) as b, cast(min(o_orderkey) as varchar) as m, cast(max(o_orderkey) as varchar) as h from orders group by o_custkey
      union all select 'trace:f' || o_orderkey || ':1-1', cast(o_orderkey as varchar), cast(o_orderkey as varchar), cast(o_orderkey as varchar) from orders),
      k as (select *, starts_with(base_ref, 'trace:') and b = h and m = h as t from r)
      select case when t then 'trace' else 'scan' end as kind, not t and m = h as is_empty, count(*) as runs from k group by all""",
}
