"""Operators over DataFrames: ordering, watermarks, windows, keyed state, store, control loops."""
