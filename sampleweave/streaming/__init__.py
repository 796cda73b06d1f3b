"""Structured Streaming forms of the operators that keep state: samples arrive as rows (stream_id, idx, value[, ts])."""
