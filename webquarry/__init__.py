"""Web-corpus analytics on Spark: page snapshots in, tables of findings out."""

from webquarry.config import CrawlConfig

__all__ = ["CrawlConfig"]
