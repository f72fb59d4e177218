"""Structured Streaming: job state, metered use, debounced batches and deltas."""
