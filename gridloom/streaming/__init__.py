"""Streaming forms of the latency figures."""
