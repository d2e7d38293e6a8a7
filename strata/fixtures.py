"""Histories built from the driver's tables: DataFrames here, the same as SQL text for DuckDB below.

A: each document is a file with versions 0 to 5 whose correct blame is arithmetic in (doc_id, line).
B: orders are commits, lineitems are hunks; blame is the author's last commit that touched the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SINCE = "1996-06-01"
MAX_DEPTH = 5
#: Bytes of text in a part of fixture A: six versions of them are sorted in a task.
PART = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """(time of change, bytes) of a table: another one means that what was made from it is stale."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return found.getModificationTime(), found.getLen()


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, v, line_no, key_ln, line, truth_v) of fixture A.

    Texts are dealt by doc_id before they become versions, into parts of PART bytes. Windows and groupings by doc_id
    and anything else find their rows in place, so that what is shuffled is the texts, once.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    parts = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // PART)
    base = docs.repartition(parts, "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "txt"))
    base = base.select("doc_id", (F.col("pos") + 1).cast("long").alias("ln"), "txt")
    states = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("v")).withColumns({
        "birth": F.expr("(ln * 13 + doc_id) % 3"),
        "death": F.expr("case when (ln * 7 + doc_id) % 9 = 0 then 3 + (ln % 3) else 99 end"),
        "edited": F.expr("case when v >= 4 and (ln * 31 + doc_id) % 5 = 0 then 4 when v >= 3 and (ln * 17 + doc_id) % 7 = 0 then 3 else 0 end"),
    }).where("birth <= v and v < death")
    number = F.row_number().over(W.partitionBy("doc_id", "v").orderBy("ln")).cast("long")
    line = F.concat(F.col("ln").cast("string"), F.lit(":"), "txt", F.lit("~"), F.col("edited").cast("string"))
    return states.select("doc_id", "v", number.alias("line_no"), F.col("ln").alias("key_ln"), line.alias("line"), F.greatest("birth", "edited").cast("long").alias("truth_v"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, author, committed_on, at): ``at`` orders all commits."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("committed_on"), F.struct("o_orderdate", "o_orderkey").alias("at"))


def commit_parents(c: DataFrame) -> DataFrame:
    """(sha, pos, parent_sha). The commit before in the order of all is found day by day: within a day by
    window, and for a day's first commit it is the last one of the day before, of which there are few."""
    own = W.partitionBy("author").orderBy("at")
    with_own = c.withColumn("p0", F.lag("sha").over(own))
    day = W.partitionBy("committed_on").orderBy("at")
    here = with_own.withColumns({"_ps": F.lag("sha").over(day), "_pa": F.lag("author").over(day), "_first": F.row_number().over(day) == 1})
    last = c.groupBy("committed_on").agg(F.max(F.struct("at", "sha", "author")).alias("l"))
    days = W.orderBy("committed_on")  # a row for each day
    last = last.select("committed_on", F.lag("l.sha").over(days).alias("_ds"), F.lag("l.author").over(days).alias("_da"))
    all_ = here.join(last, "committed_on", "left").withColumns({"p1": F.when(F.col("_first"), F.col("_ds")).otherwise(F.col("_ps")), "pa": F.when(F.col("_first"), F.col("_da")).otherwise(F.col("_pa"))})
    first = all_.where("p0 is not null").select("sha", F.lit(0).alias("pos"), F.col("p0").alias("parent_sha"))
    second = all_.where("p0 is not null and pa <> author and sha % 5 = 0").select("sha", F.lit(1).alias("pos"), F.col("p1").alias("parent_sha"))
    return first.unionByName(second)


def hunks(spark: SparkSession, sf_dir: str, parents: DataFrame, parts: int) -> DataFrame:
    """(sha, pos, parent_sha, new_path, old_path, new_start, new_lines, old_start, old_lines, flag), dealt by sha into
    ``parts``."""
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    items = read(spark, sf_dir, "lineitem").select(*columns).repartition(parts, "l_orderkey").groupBy("l_orderkey", F.expr("l_partkey % 8").alias("k"), "l_linenumber").agg(F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"), F.min("l_returnflag").alias("flag"))
    here = F.expr("concat('f', cast(k as string))")
    moved = F.expr("concat('f', cast((k + 1) % 8 as string))")
    start = F.expr("cast(l_linenumber * 10 as bigint)")
    h = items.select(F.col("l_orderkey").alias("sha"), here.alias("new_path"), F.when(F.col("flag") == "R", moved).otherwise(here).alias("old_path"), start.alias("new_start"), F.expr("cast(hi as bigint) % 13").alias("new_lines"), (start - 2).alias("old_start"), F.expr("cast(lo as bigint) % 7").alias("old_lines"), "flag")
    return parents.join(h, "sha")


def events(h: DataFrame) -> DataFrame:
    """Deltas (sha, pos, parent_sha, new_path, old_path, flag, event_type), several for one path."""
    e = h.select("sha", "pos", "parent_sha", "new_path", "old_path", "flag").distinct()
    return e.withColumn("event_type", F.when(F.col("old_path") == F.col("new_path"), "modified").otherwise("renamed"))


def blame_table(c: DataFrame, h: DataFrame) -> DataFrame:
    """(commit, path, blamed): an as-of join of every (commit, path) with the author's touches.

    Touches and questions are sorted together and the last touch is carried forward, so that the work
    is in proportion to both, whatever the number of an author's commits. Commits are dealt by author with the
    paths that they touched, and become a row for each path after that.
    """
    paths = h.select(F.col("new_path").alias("path")).distinct().agg(F.array_sort(F.collect_list("path")).alias("paths"))  # eight paths
    touch = h.groupBy("sha").agg(F.collect_set("new_path").alias("touched"))
    own = c.select("sha", "author", "at").join(touch, "sha", "left").repartition("author").crossJoin(F.broadcast(paths))
    marked = own.select("sha", "author", "at", "touched", F.explode("paths").alias("path")).withColumn("t", F.array_contains("touched", F.col("path")))
    order = W.partitionBy("author", "path").orderBy("at")
    newest = F.last(F.when(F.col("t"), F.col("sha")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    first = F.first("sha").over(order)
    return marked.select(F.col("sha").alias("commit"), "path", F.coalesce(newest, first).alias("blamed"))


def touches(c: DataFrame, h: DataFrame) -> DataFrame:
    """(author, path, at, sha): the commits that touched a path."""
    touch = h.select("sha", F.col("new_path").alias("path")).distinct()
    return touch.join(c.select("sha", "author", "at"), "sha").select("author", "path", "at", "sha")


def blame_asked(asked: DataFrame, touched: DataFrame, info: DataFrame) -> DataFrame:
    """The rows (commit, path) ``asked`` for of ``blame_table``. ``touched``: ``touches``; ``info``: (commit, author, at,
    first), ``first`` the author's first commit.

    Only touches of the authors and paths in question are sorted together with the questions.
    """
    q = asked.select("commit", "path").distinct().join(info.select("commit", "author", "at", "first"), "commit")
    near = touched.join(q.select("author", "path"), ["author", "path"], "left_semi")
    none = lambda t: F.lit(None).cast(t)
    rows = near.select("author", "path", "at", F.lit(0).alias("kind"), "sha", none("long").alias("commit"), none("long").alias("first"))
    rows = rows.unionByName(q.select("author", "path", "at", F.lit(1).alias("kind"), none("long").alias("sha"), "commit", "first"))
    order = W.partitionBy("author", "path").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("newest", F.last("sha", ignorenulls=True).over(order)).where("kind = 1")
    return found.select("commit", "path", F.coalesce("newest", "first").alias("blamed"))


def heads(c: DataFrame) -> DataFrame:
    return c.groupBy("author").agg(F.max_by("sha", "at").alias("sha")).where("sha % 10 = 0").select("sha")


def seeds(c: DataFrame, h: DataFrame) -> DataFrame:
    """Requests (commit, path, s, e) of the heads' hunks."""
    rows = h.where("new_lines > 0").join(heads(c), "sha", "left_semi")
    return rows.select(F.col("sha").alias("commit"), F.col("new_path").alias("path"), F.col("new_start").alias("s"), F.expr("new_start + new_lines - 1").alias("e")).distinct()


#: Fixture A as common table expressions of DuckDB.
A_SQL = """
base_lines as (select doc_id, ln, txt from (select doc_id, unnest(string_split(text, chr(10))) as txt, generate_subscripts(string_split(text, chr(10)), 1) as ln from documents) u),
h_line_states as (select b.doc_id, v.v, b.ln, (b.ln * 13 + b.doc_id) % 3 as birth,
  case when (b.ln * 7 + b.doc_id) % 9 = 0 then 3 + (b.ln % 3) else 99 end as death,
  case when v.v >= 4 and (b.ln * 31 + b.doc_id) % 5 = 0 then 4 when v.v >= 3 and (b.ln * 17 + b.doc_id) % 7 = 0 then 3 else 0 end as edited, b.txt
  from base_lines b cross join (select unnest([0, 1, 2, 3, 4, 5]) as v) v),
h_file_lines as (select doc_id, v, cast(row_number() over (partition by doc_id, v order by ln) as bigint) as line_no, cast(ln as bigint) as key_ln,
  cast(ln as varchar) || ':' || txt || '~' || cast(edited as varchar) as line, cast(greatest(birth, edited) as bigint) as truth_v
  from h_line_states where birth <= v and v < death)
"""

#: Fixture B as common table expressions of DuckDB.
B_SQL = f"""
h_commits as (select o_orderkey as sha, o_custkey as author, cast(o_orderdate as date) as committed_on, row_number() over (order by o_orderdate, o_orderkey) as ord from orders),
h_commit_parents as (
  select sha, 0 as pos, parent_sha from (select sha, lag(sha) over (partition by author order by ord) as parent_sha from h_commits) a where parent_sha is not null
  union all
  select sha, 1 as pos, parent_sha from (select sha, author, ord, lag(sha) over (order by ord) as parent_sha, lag(author) over (order by ord) as pa,
    lag(sha) over (partition by author order by ord) as p0 from h_commits) b where p0 is not null and pa <> author and sha % 5 = 0),
h_hunks as materialized (select c.sha, p.pos, p.parent_sha, 'f' || (l.l_partkey % 8) as new_path,
  case when min(l.l_returnflag) = 'R' then 'f' || ((l.l_partkey + 1) % 8) else 'f' || (l.l_partkey % 8) end as old_path,
  cast(l.l_linenumber * 10 as bigint) as new_start, cast(max(l.l_quantity) as bigint) % 13 as new_lines,
  cast(l.l_linenumber * 10 as bigint) - 2 as old_start, cast(min(l.l_quantity) as bigint) % 7 as old_lines, min(l.l_returnflag) as flag
  from h_commits c join h_commit_parents p on c.sha = p.sha join lineitem l on l.l_orderkey = c.sha
  group by c.sha, p.pos, p.parent_sha, l.l_partkey % 8, (l.l_partkey + 1) % 8, l.l_linenumber),
h_touch as (select distinct c.author, c.ord, c.sha, h.new_path as path from h_hunks h join h_commits c on c.sha = h.sha),
h_first as (select author, min(ord) as ord0 from h_commits group by author),
h_blame as (select c.sha as req_sha, f.path, coalesce(max(t.sha_ord), min(a.ord0)) as blamed_ord
  from h_commits c join h_first a on a.author = c.author cross join (select distinct new_path as path from h_hunks) f
  left join (select author, path, ord as sha_ord from h_touch) t on t.author = c.author and t.path = f.path and t.sha_ord <= c.ord group by c.sha, f.path),
h_np as (select sha, count(*) as np from h_commit_parents group by sha),
h_b as materialized (select b.req_sha, b.path, c.sha as blamed, c.committed_on, coalesce(n.np, 0) as np from h_blame b join h_commits c on c.ord = b.blamed_ord left join h_np n on n.sha = c.sha),
h_head as (select sha from (select sha, row_number() over (partition by author order by ord desc) as k from h_commits) x where k = 1 and sha % 10 = 0),
h_seed as (select distinct h.sha as c, h.new_path as p, h.new_start as s, h.new_start + h.new_lines - 1 as e from h_hunks h join h_head using (sha) where h.new_lines > 0),
h_pe as materialized (select sha, pos, parent_sha, new_path, min(old_path) as old_path from h_hunks group by all)
"""

#: The requests, their cutoffs and all edges of fixture B; needs ``with recursive``.
LINEAGE_SQL = f"""{B_SQL},
r as (select c, p, s, e, 0 as depth from h_seed
  union
  select pe.parent_sha, pe.old_path, coalesce(h.old_start, r.s), coalesce(h.old_start + h.old_lines - 1, r.e), r.depth + 1
  from r join h_b b on b.req_sha = r.c and b.path = r.p and b.np > 0 and not b.committed_on < date '{SINCE}' and r.depth < {MAX_DEPTH}
  join h_pe pe on pe.sha = b.blamed and pe.new_path = r.p
  left join h_hunks h on h.sha = pe.sha and h.pos = pe.pos and h.new_path = pe.new_path and h.new_lines > 0 and h.new_start <= r.e and r.s < h.new_start + h.new_lines
  where h.sha is null or h.old_lines > 0),
req as materialized (select c, p, s, e, min(depth) as depth from r group by all),
sp as materialized (select q.*, b.blamed, b.committed_on, case when b.np = 0 then 'root_commit' when b.committed_on < date '{SINCE}' then 'older_than_since' when q.depth >= {MAX_DEPTH} then 'max_depth' end as cutoff
  from req q join h_b b on b.req_sha = q.c and b.path = q.p),
ed as materialized (select c, p, s, e, depth, blamed, cast(null as bigint) as parent_sha, cast(null as integer) as pos, cutoff as edge_type, cast(null as varchar) as next_path, cast(null as bigint) as next_s, cast(null as bigint) as next_e from sp where cutoff is not null
  union all
  select sp.c, sp.p, sp.s, sp.e, sp.depth, sp.blamed, pe.parent_sha, pe.pos, case when h.old_lines = 0 then 'introduced_here' else 'recurse_to_parent' end,
    case when h.old_lines = 0 then null else pe.old_path end, case when h.old_lines = 0 then null else coalesce(h.old_start, sp.s) end, case when h.old_lines = 0 then null else coalesce(h.old_start + h.old_lines - 1, sp.e) end
  from sp join h_pe pe on pe.sha = sp.blamed and pe.new_path = sp.p
  left join h_hunks h on h.sha = pe.sha and h.pos = pe.pos and h.new_path = pe.new_path and h.new_lines > 0 and h.new_start <= sp.e and sp.s < h.new_start + h.new_lines
  where sp.cutoff is null)
"""
