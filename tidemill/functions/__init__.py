"""Column builders: event time, aggregates, window assigners, statistics."""
