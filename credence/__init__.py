"""A PySpark engine for maintained, revisable beliefs."""
