"""Training-data operators: extraction, deduplication, scoring, mixing, formatting and packing.

Each module holds one operator; ``queries`` registers them and ``oracle`` has the DuckDB SQL of
those that SQL can express. Nothing outside this package imports it but ``__spark_entry__``.
"""
