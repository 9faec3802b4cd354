"""The schema of a page snapshot, the one table every job starts from."""

from __future__ import annotations

SNAPSHOT = (
    "page_id long, url string, final_url string, status int, content_type string, "
    "headers map<string,string>, html string, rendered_with string, escalated boolean, "
    "error string, fetched_at timestamp, took_ms long"
)
