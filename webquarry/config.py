"""Run options that affect data.  A limit of 0 means none."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SCOPES = ("page", "path", "domain", "subdomain", "all")


def split_list(raw: str | None) -> list[str]:
    """Items of a newline- or comma-separated list, trimmed, empties dropped."""
    return [item.strip() for item in re.split(r"[\n,]+", raw or "") if item.strip()]


@dataclass(frozen=True)
class CrawlConfig:
    scope: str = "domain"
    max_depth: int = 0
    max_pages: int = 0
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    respect_robots: bool = True
    robots_agent: str = "corpusbot"
    follow_sitemaps: bool = False
    categories: tuple[str, ...] = ("images", "documents", "media", "archives", "fonts")
    max_file_size: int = 0
    block_trackers: bool = True
    organize_by_extension: bool = False
    save_pages: bool = False
    extract_intel: bool = False
    audit_security: bool = False
    #: Snapshots taken later than this timestamp are not looked at; empty for the latest.
    as_of: str = ""
    extra_secret_patterns: tuple[tuple[str, str], ...] = field(default=())
    extra_tech_signatures: tuple[tuple[str, str], ...] = field(default=())
