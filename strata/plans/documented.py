"""The documented questions to a lineage, as Spark SQL with named parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame

LATEST = "(select max(id) from scans)"

QUERIES = {
    "files_touched": f"select distinct path from seed_ranges where scan_id = {LATEST} order by path",
    "ranges_for_file": f"select start_line, end_line from seed_ranges where scan_id = {LATEST} and path = :path order by start_line",
    "top_commits": f"""select c.sha, c.author_name, c.committed_at, substr(c.message, 1, 80) as title, count(*) as spans
        from blame_spans b join blame_requests r on r.id = b.request_id join commits c on c.repository_id = b.repository_id and c.sha = b.blamed_commit_sha
        where r.scan_id = {LATEST} group by all order by spans desc, c.sha limit 20""",
    "seed_covering_line": f"""select id, commit_sha, start_line, end_line from blame_requests
        where scan_id = {LATEST} and path = :path and :line between start_line and end_line and reason = 'seed'""",
    "lineage_step": """select e.edge_type, b.blamed_commit_sha, b.final_path, b.final_start_line, b.line_count, b.origin_path, b.origin_start_line, e.parent_sha, e.parent_position, e.next_request_id
        from lineage_edges e join blame_spans b on b.id = e.to_span_id where e.from_request_id = :request_id order by b.final_start_line, e.parent_position""",
    "patch_for_file": f"""select h.id, h.new_start, h.new_lines, h.patch_text from seed_ranges s join diff_hunks h on h.id = s.diff_hunk_id
        where s.scan_id = {LATEST} and s.path = :path order by h.new_start""",
    "patch_by_id": "select patch_text from diff_hunks where id = :hunk_id",
    "renames_copies": "select commit_sha, parent_sha, event_type, old_path, new_path from file_events where event_type in ('renamed', 'copied') order by commit_sha, new_path",
    "commit_parent_list": """select c.sha, substr(c.message, 1, 60) as title, c.author_name, c.committed_at, listagg(p.parent_sha, ',') within group (order by p.parent_position) as parents
        from commits c left join commit_parents p on p.repository_id = c.repository_id and p.commit_sha = c.sha
        group by c.sha, c.message, c.author_name, c.committed_at order by c.committed_at desc, c.sha""",
    "file_dossier": f"""select s.start_line, s.end_line, r.id as request_id, b.id as span_id, b.final_start_line, b.line_count, e.edge_type, e.parent_position, c.sha, c.author_name, c.committed_at
        from seed_ranges s join blame_requests r on r.scan_id = s.scan_id and r.commit_sha = s.commit_sha and r.path = s.path and r.start_line = s.start_line and r.end_line = s.end_line
        join blame_spans b on b.request_id = r.id left join lineage_edges e on e.to_span_id = b.id
        join commits c on c.sha = b.blamed_commit_sha where s.scan_id = {LATEST} and s.path = :path order by s.start_line, b.final_start_line, e.parent_position""",
    "run_kind": f"select case when base_ref like 'trace:%' and base_sha = head_sha and merge_base_sha = head_sha then 'trace' else 'scan' end as kind from scans where id = {LATEST}",
    "seed_count": f"select count(*) as seeds from seed_ranges where scan_id = {LATEST}",
}


def run(tables: dict[str, DataFrame], name: str, **parameters) -> DataFrame:
    if name not in QUERIES:
        raise KeyError(f"{name}: one of {', '.join(QUERIES)}")
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        df.createOrReplaceTempView(table)
    return spark.sql(QUERIES[name], args=parameters)
