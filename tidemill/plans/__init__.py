"""The fluent interface and the catalogue of queries built with it."""
