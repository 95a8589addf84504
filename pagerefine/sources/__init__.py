"""Where pages and stored files come from."""

from .tables import pages, stored_files, with_http_errors

__all__ = ["pages", "stored_files", "with_http_errors"]
