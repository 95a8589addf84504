"""Operators from DataFrames to DataFrames: extraction, routing, the store, one-hop crawl."""

from .crawl import fetch_links
from .extract import extract_pages, with_extraction
from .route import fetch
from .store import delete, find_by_ref, find_by_url, list_references, promote, read_state, reference_links, save, write_state

__all__ = [
    "delete", "extract_pages", "fetch", "fetch_links", "find_by_ref", "find_by_url", "list_references", "promote", "read_state", "reference_links", "save", "with_extraction", "write_state",
]
