"""Structured Streaming: windows, keyed state, runtime settings and progress."""
