"""Web-document curation on Spark: pages and plain text in, dated, ordered collections out."""

__version__ = "0.1.0"
