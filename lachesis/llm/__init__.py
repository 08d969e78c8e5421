"""Operators of a training-data pipeline: each module holds one operator with a general interface and,
at its end, the thin query that applies it to the whole table it is meant for."""
