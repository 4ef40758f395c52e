"""Operators of a training-data pipeline, each over whole tables: see ``regrowth.llm.queries`` for the named queries."""
