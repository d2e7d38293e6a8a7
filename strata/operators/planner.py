"""The recursion planner: cutoffs, event lookup, hunk overlap, actions, and the fixpoint of requests.

A request is (commit, path, s, e). The planner works on whole levels: spans join their commit's parents,
the parents' events by path, and the events' hunks by an interval condition beside equal keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.operators import intervals
from strata.schema import RECURSE
from strata.storage import keep, scratch_dir

KEY = ["commit", "path", "s", "e"]


def cutoff(parents: Column, committed_on: Column, depth: Column, since: Column, max_depth: int) -> Column:
    """Null to go on. A root comes first, then the age (strictly before; unknown dates are not old), then
    the depth."""
    return F.when(parents == 0, "root_commit").when(F.coalesce(committed_on < since, F.lit(False)), "older_than_since").when(depth >= max_depth, "max_depth")


def parent_path(event_type: Column, old_path: Column) -> Column:
    return F.when(event_type != "added", old_path)


def first_events(events: DataFrame, order: list[str]) -> DataFrame:
    """Of the events (commit, pos, new_path, ...) of one parent with one new path, the first in delta order."""
    k = F.row_number().over(W.partitionBy("commit", "pos", "new_path").orderBy(*order))
    return events.where("new_path is not null").withColumn("_k", k).where("_k = 1").drop("_k")


def overlap(start: Column, end: Column, new_start: Column, new_lines: Column) -> Column:
    """Half-open intervals meet in a line: an empty hunk meets nothing."""
    return (new_lines > 0) & (new_start < end) & (start < new_start + new_lines)


def plan(spans: DataFrame, parents: DataFrame, events: DataFrame, hunks: DataFrame, exact_ranges: bool = False) -> DataFrame:
    """Edges of spans that go on, for each of their commit's parents.

    ``spans``: KEY columns, span, blamed, origin_path, origin_start, line_count. ``parents``: (commit, pos,
    parent). ``events``: first events (commit, pos, new_path, old_path, event_type, is_binary). ``hunks``:
    (commit, pos, new_path, old_start, old_lines, new_start, new_lines).

    Adds parent, pos, edge_type and, where it recurses, next_path, next_s, next_e. A span without an
    origin is introduced here; one whose path the parent's diff lacks has no edge for that parent. A hunk
    that overlaps hands on its whole old side; none overlapping hands on the same numbers.
    ``exact_ranges`` shifts those by the lines that earlier hunks added.
    """
    p = parents.select(F.col("commit").alias("blamed"), "pos", "parent")
    at = spans.join(p, "blamed")
    known = F.col("origin_path").isNotNull() & F.col("origin_start").isNotNull()
    columns = [*spans.columns, "pos", "parent"]
    lost = at.where(~known).select(*columns, F.lit("introduced_here").alias("edge_type"), *_next(None, None, None))
    e = events.select(F.col("commit").alias("blamed"), "pos", F.col("new_path").alias("origin_path"), "old_path", "event_type", "is_binary")
    met = at.where(known).join(e, ["blamed", "pos", "origin_path"])
    binary = F.coalesce("is_binary", F.lit(False))
    ended = F.when(binary, "binary_skipped").when(F.col("event_type") == "added", "introduced_here").when(F.col("old_path").isNull(), "introduced_here")
    met = met.withColumn("edge_type", ended)
    stop = met.where("edge_type is not null").select(*columns, "edge_type", *_next(None, None, None))
    go = met.where("edge_type is null").drop("edge_type")
    end = F.col("origin_start") + F.col("line_count")
    h = hunks.select(F.col("commit").alias("blamed"), "pos", F.col("new_path").alias("origin_path"), "old_start", "old_lines", "new_start", "new_lines")
    keys = ["blamed", "pos", "origin_path"]
    hits = intervals.overlaps(go.withColumn("_end", end), h.withColumn("_stop", F.col("new_start") + F.col("new_lines")), keys, ("origin_start", "_end"), ("new_start", "_stop"))
    hits = hits.select(*go.columns, "old_start", "old_lines", "new_start")
    missed = go.join(hits.select("span", "pos").distinct(), ["span", "pos"], "left_anti")
    joined = hits.unionByName(missed, allowMissingColumns=True)
    hit, gone = F.col("new_start").isNotNull(), F.col("old_lines") == 0
    shift = F.lit(0)
    if exact_ranges:
        # an as-of join: the running sum of what hunks before a span's start took away
        edits = h.select(*keys, (F.col("new_start") + F.col("new_lines")).alias("_at"), F.lit(0).alias("_kind"), (F.col("old_lines") - F.col("new_lines")).alias("_less"), F.lit(None).cast(go.schema["span"].dataType).alias("span"))
        asked = missed.select(*keys, F.col("origin_start").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_less"), "span")
        order = W.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
        before = edits.unionByName(asked).withColumn("_shift", F.sum("_less").over(order)).where("_kind = 1").select("span", "pos", "_shift")
        joined = joined.join(before, ["span", "pos"], "left")
        shift = F.coalesce("_shift", F.lit(0))
    kind = F.when(hit & gone, "introduced_here").otherwise(RECURSE)
    s = F.when(hit & gone, None).when(hit, F.col("old_start")).otherwise(F.col("origin_start") + shift)
    t = F.when(hit & gone, None).when(hit, F.col("old_start") + F.col("old_lines") - 1).otherwise(end - 1 + shift)
    on = joined.select(*columns, kind.alias("edge_type"), *_next(F.when(~(hit & gone), F.col("old_path")), s, t))
    return lost.unionByName(stop).unionByName(on)


def _next(path, s, e) -> list[Column]:
    none = F.lit(None)
    return [(none if c is None else c).cast(t).alias(n) for c, t, n in ((path, "string", "next_path"), (s, "long", "next_s"), (e, "long", "next_e"))]


@dataclass
class Trace:
    """What a traversal found: requests (KEY, depth), their spans (with depth and cutoff) and their edges."""

    requests: DataFrame
    spans: DataFrame
    edges: DataFrame


class Planner:
    """The tables that a traversal reads, and its bounds.

    ``commits``: (commit, committed_on, parents: their number). ``blame``: requests -> spans (KEY, span,
    blamed, origin_path, origin_start, line_count, final_start). ``diffs``: commits (commit) -> their first
    events and their hunks, as ``plan`` takes them; it is asked once a level, for the commits of spans that go on.
    """

    def __init__(self, commits: DataFrame, parents: DataFrame, diffs: Callable[[DataFrame], tuple[DataFrame, DataFrame]], blame: Callable[[DataFrame], DataFrame], since: Column, max_depth: int, exact_ranges: bool = False):
        self.commits, self.parents, self.diffs, self.blame = commits, parents, diffs, blame
        self.since, self.max_depth, self.exact_ranges = since, max_depth, exact_ranges

    def spans(self, requests: DataFrame) -> DataFrame:
        """Spans with their request's depth and the cutoff of their commit."""
        found = self.blame(requests.select(*KEY)).join(requests.select(*KEY, "depth"), KEY)
        info = self.commits.select(F.col("commit").alias("blamed"), "committed_on", "parents")
        found = found.join(info, "blamed")
        return found.withColumn("cutoff", cutoff(F.col("parents"), F.col("committed_on"), F.col("depth"), self.since, self.max_depth)).drop("committed_on", "parents")

    def edges(self, spans: DataFrame) -> DataFrame:
        """All edges of spans: cutoffs without a parent, then what the planner says."""
        cut = spans.where("cutoff is not null").withColumns({"pos": F.lit(None).cast("int"), "parent": F.lit(None).cast(dict(self.parents.dtypes)["parent"]), "edge_type": F.col("cutoff")})
        on = spans.where("cutoff is null")
        events, hunks = self.diffs(on.select(F.col("blamed").alias("commit")).distinct())
        on = plan(on, self.parents, events, hunks, self.exact_ranges)
        nothing = dict(zip(("next_path", "next_s", "next_e"), _next(None, None, None), strict=True))
        return cut.withColumns(nothing).unionByName(on).drop("cutoff")

    def trace(self, seeds: DataFrame, where: str | None = None) -> Trace:
        """Follow every request reachable from ``seeds`` (KEY); a request's depth is that it is first seen at.

        A level's spans and edges are made once and kept as tables. The requests of the next one are what its
        edges lead to, distinct and not among the earlier ones. Tables go to ``where``, or to a new scratch folder.
        """
        where = where or scratch_dir(seeds.sparkSession)
        level = keep(seeds.select(*KEY).distinct().withColumn("depth", F.lit(0)), where, "level-0")
        out: Trace | None = None
        for depth in range(self.max_depth + 1):
            if out is not None and level.isEmpty():
                break
            spans = keep(self.spans(level), where, f"spans-{depth}")
            edges = keep(self.edges(spans), where, f"edges-{depth}")
            out = Trace(level, spans, edges) if out is None else Trace(out.requests.unionByName(level), out.spans.unionByName(spans), out.edges.unionByName(edges))
            new = edges.where(F.col("edge_type") == RECURSE).select(F.col("parent").alias("commit"), F.col("next_path").alias("path"), F.col("next_s").alias("s"), F.col("next_e").alias("e")).distinct()
            level = keep(new.join(out.requests, KEY, "left_anti").withColumn("depth", F.lit(depth + 1)), where, f"level-{depth + 1}")
        return out
