"""Structured Streaming: raw answers to records as they arrive, running run summaries."""
