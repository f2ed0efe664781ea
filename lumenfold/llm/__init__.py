"""Training-data operators: quality, dedup, decontamination, tokenising, scoring.

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries and ``__spark_entry__.py`` adds them when it can be imported.
"""
