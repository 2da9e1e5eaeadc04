"""Structured Streaming operators: streaming DataFrame in, streaming DataFrame out."""
