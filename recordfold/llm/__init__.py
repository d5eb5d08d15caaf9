"""Training-data operators: one module per operator, plus their registered
queries (``queries.py``).  Nothing outside this package imports it, except the
guarded import in ``__spark_entry__.py``."""
