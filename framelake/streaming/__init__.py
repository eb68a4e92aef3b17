"""Structured Streaming: causal folds with state, and event-time windows."""
