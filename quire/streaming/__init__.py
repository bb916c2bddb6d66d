"""The repeated run as a stream."""
