"""Explicit schemas of the store's tables; nothing is inferred."""

from __future__ import annotations

PARAMETERS = "array<struct<name:string,type_name:string,type_file_path:string,type_git_file_hash:string>>"

#: Spark DDL by table.
SCHEMAS: dict[str, str] = {
    "functions": f"name string, file_path string, git_file_hash string, line_start bigint, line_end bigint, return_type string, parameters {PARAMETERS}, body_hash string, calls array<string>, types array<string>",
    "types": "name string, file_path string, git_file_hash string, line bigint, kind string, size bigint, fields array<struct<name:string,type_name:string,offset:bigint>>, definition_hash string, types array<string>",
    "content": "hash string, content string, shard int",
    "symbol_filename": "symbol string, filename string",
    "processed_files": "file string, git_sha string, git_file_sha string",
    "git_commits": "git_sha string, parent_sha array<string>, author string, subject string, message string, tags map<string,array<string>>, diff string, symbols array<string>, files array<string>",
    "lore": "git_commit_sha string, `from` string, date string, date_timestamp bigint, message_id string, in_reply_to string, subject string, `references` string, recipients string, body string, symbols array<string>",
    "lore_indexed_commits": "git_commit_sha string",
    "indexed_branches": "branch_name string, tip_commit string, indexed_at bigint, remote string",
    "vectors": "content_hash string, vector array<float>",
    "commit_vectors": "git_commit_sha string, vector array<float>",
    "lore_vectors": "message_id string, vector array<float>",
    "lore_tokens": "token string, message_id string",
    "vector_index": "content_hash string, cluster int, code binary",
    "vector_model": "name string, dimension int, part int, data binary",
    "manifest": "commit_sha string, file_path string, git_file_hash string",
}

#: Columns that identify a row when tables are merged.
KEYS: dict[str, list[str]] = {
    "functions": ["name", "file_path", "git_file_hash"],
    "types": ["name", "kind", "file_path", "git_file_hash"],
    "content": ["hash"],
    "symbol_filename": ["symbol", "filename"],
    "git_commits": ["git_sha"],
    "lore": ["message_id"],
    "lore_indexed_commits": ["git_commit_sha"],
    "indexed_branches": ["branch_name"],
    "vectors": ["content_hash"],
    "commit_vectors": ["git_commit_sha"],
    "lore_vectors": ["message_id"],
    "lore_tokens": ["token", "message_id"],
    "vector_index": ["content_hash"],
    "vector_model": ["name", "part"],
    "manifest": ["commit_sha", "file_path"],
}

#: Columns whose hash tells a row's bucket, where these aren't all of its key: a lookup then reads one bucket.
BUCKETED_BY: dict[str, list[str]] = {"lore_tokens": ["token"], "functions": ["name"], "types": ["name"], "symbol_filename": ["symbol"]}
