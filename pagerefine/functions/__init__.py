"""Functions on columns of text: clean-up, scores, headers, links, and the article of a page."""

from .article import extract
from .clean import clean_content, clean_finish, clean_markdown, clean_structure
from .links import web_links
from .quality import measures, report, score
from .text import clipped, rounded, size_kb, slug, tokens, trimmed

__all__ = [
    "clean_content", "clean_finish", "clean_markdown", "clean_structure", "clipped", "extract", "measures", "report", "rounded", "score", "size_kb", "slug", "tokens", "trimmed", "web_links",
]
