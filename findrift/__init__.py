"""A PySpark engine that compares snapshots of static-analysis findings, and its data operators."""
