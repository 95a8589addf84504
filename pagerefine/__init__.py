"""pagerefine: web pages to clean, scored Markdown and a queryable reference store, on Spark DataFrames."""

__version__ = "0.1.0"
