"""Structured Streaming: file streams, and stateful steps on them."""
