"""The tables of a lineage database, their domains and keys."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _B, _T, _D = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType(), T.DateType()


def _table(*columns: tuple) -> T.StructType:
    """Columns as (name, type) where null is allowed, (name, type, 1) where not."""
    return T.StructType([T.StructField(c[0], c[1], len(c) < 3) for c in columns])


TABLES: dict[str, T.StructType] = {
    "repositories": _table(("id", _L, 1), ("worktree_path", _S, 1), ("git_dir_path", _S, 1), ("remote_url", _S), ("created_at", _T, 1)),
    "scans": _table(("id", _L, 1), ("repository_id", _L, 1), ("base_ref", _S, 1), ("base_sha", _S, 1), ("merge_base_sha", _S, 1), ("head_sha", _S, 1), ("max_depth", _I, 1), ("since_date", _D, 1), ("rename_policy", _S, 1), ("status", _S, 1), ("started_at", _T, 1), ("finished_at", _T)),
    "commits": _table(("repository_id", _L, 1), ("sha", _S, 1), ("tree_sha", _S), ("author_name", _S), ("author_email", _S), ("authored_at", _T), ("committer_name", _S), ("committer_email", _S), ("committed_at", _T), ("message", _S, 1)),
    "commit_parents": _table(("repository_id", _L, 1), ("commit_sha", _S, 1), ("parent_sha", _S, 1), ("parent_position", _I, 1)),
    "files": _table(("id", _L, 1), ("repository_id", _L, 1), ("first_seen_commit_sha", _S), ("first_seen_path", _S), ("created_at", _T, 1)),
    "file_versions": _table(("id", _L, 1), ("repository_id", _L, 1), ("file_id", _L), ("commit_sha", _S, 1), ("path", _S, 1), ("blob_sha", _S), ("byte_size", _L), ("line_count", _L), ("is_binary", _B, 1)),
    "file_events": _table(("id", _L, 1), ("repository_id", _L, 1), ("file_id", _L), ("commit_sha", _S, 1), ("parent_sha", _S), ("parent_position", _I), ("event_type", _S, 1), ("old_path", _S), ("new_path", _S), ("old_blob_sha", _S), ("new_blob_sha", _S), ("created_at", _T, 1)),
    "diff_hunks": _table(("id", _L, 1), ("repository_id", _L, 1), ("file_event_id", _L), ("commit_sha", _S, 1), ("parent_sha", _S), ("parent_position", _I), ("old_path", _S), ("new_path", _S), ("old_start", _L), ("old_lines", _L), ("new_start", _L), ("new_lines", _L), ("patch_text", _S, 1)),
    "seed_ranges": _table(("id", _L, 1), ("scan_id", _L, 1), ("commit_sha", _S, 1), ("path", _S, 1), ("start_line", _L, 1), ("end_line", _L, 1), ("diff_hunk_id", _L)),
    "blame_requests": _table(("id", _L, 1), ("scan_id", _L, 1), ("commit_sha", _S, 1), ("path", _S, 1), ("start_line", _L, 1), ("end_line", _L, 1), ("depth", _I, 1), ("reason", _S, 1), ("status", _S, 1), ("created_at", _T, 1)),
    "blame_spans": _table(("id", _L, 1), ("request_id", _L, 1), ("repository_id", _L, 1), ("blamed_commit_sha", _S, 1), ("final_commit_sha", _S, 1), ("final_path", _S, 1), ("final_start_line", _L, 1), ("origin_path", _S), ("origin_start_line", _L), ("line_count", _L, 1), ("boundary", _B, 1), ("diff_hunk_id", _L)),
    "lineage_edges": _table(("id", _L, 1), ("scan_id", _L, 1), ("from_request_id", _L, 1), ("to_span_id", _L, 1), ("parent_sha", _S), ("parent_position", _I), ("next_request_id", _L), ("edge_type", _S, 1)),
}

#: Written in this order, so that a key is there before what refers to it.
WRITTEN = ["repositories", "scans", "commits", "commit_parents", "file_events", "diff_hunks", "seed_ranges", "blame_requests", "blame_spans", "lineage_edges"]

# The domains of the enumerations.
EVENT_TYPES = ["added", "modified", "renamed", "copied", "deleted", "binary_skipped"]
REASONS = ["seed", "parent_recurse"]
RECURSE = "recurse_to_parent"
TERMINALS = ["introduced_here", "root_commit", "older_than_since", "max_depth", "binary_skipped"]
DOMAINS = {
    ("file_events", "event_type"): EVENT_TYPES,
    ("blame_requests", "reason"): REASONS,
    ("lineage_edges", "edge_type"): [RECURSE, *TERMINALS],
}
UNIQUE = [
    ("repositories", ["id"]),
    ("repositories", ["git_dir_path"]),
    ("scans", ["id"]),
    ("commits", ["repository_id", "sha"]),
    ("commit_parents", ["repository_id", "commit_sha", "parent_position"]),
    ("file_versions", ["repository_id", "commit_sha", "path"]),
    ("file_events", ["id"]),
    ("diff_hunks", ["id"]),
    ("seed_ranges", ["id"]),
    ("blame_requests", ["id"]),
    ("blame_requests", ["scan_id", "commit_sha", "path", "start_line", "end_line"]),
    ("blame_spans", ["id"]),
    ("lineage_edges", ["id"]),
]
#: (table, columns, referred table, its columns); nulls refer to nothing. Parents may dangle: no key.
REFERENCES = [
    ("scans", ["repository_id"], "repositories", ["id"]),
    ("commits", ["repository_id"], "repositories", ["id"]),
    ("commit_parents", ["repository_id", "commit_sha"], "commits", ["repository_id", "sha"]),
    ("file_events", ["repository_id"], "repositories", ["id"]),
    ("diff_hunks", ["file_event_id"], "file_events", ["id"]),
    ("seed_ranges", ["scan_id"], "scans", ["id"]),
    ("seed_ranges", ["diff_hunk_id"], "diff_hunks", ["id"]),
    ("blame_requests", ["scan_id"], "scans", ["id"]),
    ("blame_spans", ["request_id"], "blame_requests", ["id"]),
    ("lineage_edges", ["scan_id"], "scans", ["id"]),
    ("lineage_edges", ["from_request_id"], "blame_requests", ["id"]),
    ("lineage_edges", ["to_span_id"], "blame_spans", ["id"]),
    ("lineage_edges", ["next_request_id"], "blame_requests", ["id"]),
]


def ddl() -> str:
    """All tables as Spark DDL."""
    lines = []
    for name, schema in TABLES.items():
        columns = ",\n".join(f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in schema)
        lines.append(f"create table {name} (\n{columns}\n);")
    return "\n\n".join(lines)
