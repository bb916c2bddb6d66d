"""DataFrame-to-DataFrame operators; use them with ``df.transform(op, ...)``."""
